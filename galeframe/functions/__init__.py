"""Column-in, column-out expressions."""

from galeframe.functions.scalar import *  # noqa: F401,F403
