"""Column functions and static dimension data."""

from . import dims, text  # noqa: F401
