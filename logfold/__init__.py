"""Fold duplicate-heavy logs by template signature and measure the cost, on Spark."""

__version__ = "0.1.0"
