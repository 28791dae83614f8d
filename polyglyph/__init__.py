"""Measuring which languages places use on the web, as Spark DataFrame operators."""
