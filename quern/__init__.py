"""Layered (bronze, silver, gold) analytics as plain Spark DataFrame programs."""
