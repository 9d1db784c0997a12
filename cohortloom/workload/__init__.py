"""Named queries over the test tables, each with its SQL check where SQL can express it."""

from . import analytic, files, relational
from .registry import QUERIES
from .roles import Roles

__all__ = ["QUERIES", "Roles", "analytic", "files", "relational"]
