"""Radar interferometry time series, and the operations of a training-data pipeline, as Spark jobs."""
