"""Retail demand and replenishment analytics as Spark DataFrame plans."""
