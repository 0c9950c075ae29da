"""Typed JSON binding on Spark: text columns to typed columns and back."""
