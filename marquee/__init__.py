"""Rental-store analytics as Spark DataFrame jobs."""

from marquee.sources.shop import Shop

__all__ = ["Shop"]
