"""Procurement analytics as composable Spark DataFrame operators."""
