"""Errors of this package."""


class PointError(ValueError):
    """What a point or patch function refuses, found when a query is built or while it runs."""
