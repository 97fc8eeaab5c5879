"""Recipes (requests), the auto and manual cleaning plans, log, report, suggestions."""
