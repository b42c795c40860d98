"""Lexigrid: clinical-text analytics as Spark DataFrame operators."""
