"""Readers and writers: positioned lines, stitching, payroll CSV, locations, TSV, test views."""
