"""Relational and time-series operators."""
