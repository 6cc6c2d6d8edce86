"""Exceptions of the package; all derive from ``ForecastError``."""


class ForecastError(Exception):
    """Base class."""


class InvalidInput(ForecastError, ValueError):
    """An argument that no request may carry."""


class InvalidCoordinates(InvalidInput):
    """A latitude or longitude out of range or not finite."""


class InvalidMembers(InvalidInput):
    """An ensemble vector that is empty or not finite."""


class InvalidGrid(ForecastError):
    """Axes that form no regular grid, or a field that doesn't fill it."""


class NotFound(ForecastError, LookupError):
    """An unknown model, variable, place, run or lead time."""


class OutsideGrid(NotFound):
    """A point that the grid doesn't cover."""


class UnitMismatch(ForecastError):
    """A source unit without a conversion."""


class StoreMismatch(ForecastError):
    """Data of another run, or of another shape, than the store holds."""


class LiveStore(ForecastError):
    """A full overwrite of a store that a ready run serves."""
