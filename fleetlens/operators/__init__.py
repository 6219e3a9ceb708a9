"""Relational building blocks over readings, devices, stages and anomalies."""
