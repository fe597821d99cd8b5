"""Errors the library raises."""


class TidemarkError(Exception):
    """Any error of the library."""


class NotFound(TidemarkError):
    """A measurement, column or day that doesn't exist."""


class InvalidArgument(TidemarkError, ValueError):
    """An argument outside its domain."""


class Closed(TidemarkError):
    """A database that has been closed."""
