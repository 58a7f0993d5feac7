"""Every registered query of the library, with its SQL where SQL can express it."""

from . import compared, evaluated, learned, prepared, profiled
from .flagship import flagship

QUERIES, SQL = {}, {}
for _m in (profiled, prepared, learned, evaluated, compared):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
QUERIES["flagship_accuracy_drops"] = flagship

__all__ = ["QUERIES", "SQL", "flagship"]
