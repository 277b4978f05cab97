"""Kilohour: hourly multi-entity time-series analytics as Spark DataFrame jobs."""
