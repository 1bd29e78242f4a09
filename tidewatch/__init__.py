"""Spark jobs over streaming telemetry and the measurements taken around it."""
