"""Tallyloom: analytics over noisy, repeated observations of ordered entities, on Spark."""
