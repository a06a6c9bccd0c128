"""Exceptions; each has a code that callers can test."""


class MensuraError(ValueError):
    code = "error"


class FormulaError(MensuraError):
    """A formula that cannot be parsed, differentiated or bound to its symbols."""

    code = "formula"


class DataError(MensuraError):
    """Values that an operator cannot accept: shapes, nulls, non-finite numbers."""

    code = "data"


class UnitError(MensuraError):
    """Unknown or incompatible units."""

    code = "unit"


class FormatError(MensuraError):
    """Files that do not have the format they claim."""

    code = "format"
