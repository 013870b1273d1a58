"""Errors of the panel library."""


class PanelError(ValueError):
    """A malformed panel, window, fold or combination."""


class DataError(ValueError):
    """A file or table that cannot be loaded."""


class EventError(ValueError):
    """A malformed event or event window."""


class SignificanceError(ValueError):
    """Returns or trials that allow no statement."""


class PreregistrationError(RuntimeError):
    """Evidence without registration, or a journal that was altered."""


class CausalityViolation(AssertionError):
    """A signal read the future."""
