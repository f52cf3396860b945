"""Registered queries: each pairs a Spark plan with, where SQL can say it, its oracle."""
