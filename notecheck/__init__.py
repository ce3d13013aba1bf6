"""Fuel-delivery note checks as Spark DataFrame jobs."""
