"""Sensor-fleet telemetry analytics as ordinary Spark DataFrames."""
