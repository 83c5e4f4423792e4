"""Scholarly text and graph analytics as Spark DataFrame operators."""
