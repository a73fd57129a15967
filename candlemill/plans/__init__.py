"""Whole jobs."""

from candlemill.plans.jobs import find_patterns, land, run_day, run_range, transform

__all__ = ["find_patterns", "land", "run_day", "run_range", "transform"]
