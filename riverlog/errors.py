"""Errors that callers can tell apart."""


class RiverlogError(Exception):
    """Any error of this package."""


class QuerySyntaxError(RiverlogError):
    """The text isn't a statement of the query language."""


class PlanError(RiverlogError):
    """A statement that parses but makes no valid plan."""


class FieldNotFoundError(RiverlogError):
    """A field that a scanned schema doesn't have."""


class FieldTypeError(RiverlogError):
    """An operator or a literal that a field's type doesn't allow."""


class TableNotFoundError(RiverlogError):
    """A topic of a producer that doesn't exist."""
