"""Composed jobs (hourly ETL, bulk init, features, training) and the query registry."""
