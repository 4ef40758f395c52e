"""Disturbance-and-recovery panel analytics as lazy Spark DataFrame operators."""

from regrowth.session import get_spark

__all__ = ["get_spark"]
