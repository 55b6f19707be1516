"""Zonal statistics, filtered spatial aggregates, coverage, queueing and chart statistics as Spark jobs."""
