"""Coordinated-account analytics as Spark DataFrame operators."""
