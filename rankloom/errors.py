"""Errors of the library."""


class RankloomError(Exception):
    """Base of all errors raised here."""


class MissingColumnError(RankloomError, ValueError):
    """A column that an operator needs is not in the table."""


class UnknownItemError(RankloomError, TypeError):
    """The log has labels that a given index lacks."""


class InsufficientRatingsError(RankloomError, ValueError):
    """No unit has two ratings or more."""


class UnknownDistanceError(RankloomError, ValueError):
    """No distance of that name."""


class ScoreShapeError(RankloomError, ValueError):
    """Scores are not one number an item."""


class TooLargeError(RankloomError, ValueError):
    """A bounded structure would exceed its documented bound."""


class NotConvergedError(RankloomError, ArithmeticError):
    """An iteration reached its limit before its tolerance."""
