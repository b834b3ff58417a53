"""DataFrame -> DataFrame operators: histogram, statistics, location lookup, hexbin."""
