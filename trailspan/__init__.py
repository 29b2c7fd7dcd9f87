"""Spark-first operators for network coverage, spatial ETL and event-sourced metrics."""
