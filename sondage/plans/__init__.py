"""Operators composed into named queries over the driver's tables."""
