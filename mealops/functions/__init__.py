"""Column-level rules shared by the operators (all built-in expressions)."""

from .rules import *  # noqa: F401,F403
