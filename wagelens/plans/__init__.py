"""Composed jobs: report runs, ingest/report jobs, the query catalogue and its oracles."""
