"""Errors of the library; all are ValueErrors."""


class DataError(ValueError):
    """The data can't be what the operation needs."""


class IrregularGranularityError(DataError):
    """Steps between times differ where they mustn't."""


class InsufficientDataError(DataError):
    """Too few points."""


class ParameterError(ValueError):
    """A parameter that doesn't exist or can't be."""
