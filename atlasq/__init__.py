"""Spatial layers, rules and map queries expressed as Spark DataFrame plans."""
