"""Kinloom: relationship intelligence as Spark DataFrame operators."""
