"""Names that say nothing about a program: built by rule from the running Python, plus short lists."""

from __future__ import annotations

import builtins
import keyword
import sys
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variable names that are too general to be useful.
GENERIC = (
    "var variable val value item obj object data result temp tmp arg args kwarg kwargs param params elem element entry record row col column "
    "idx index i j k x y z n m p q r s t u v w a b c d e f g h l o helper util utils func fn cb callback"
).split()


#: Names of attributes, of what older Pythons had, and of variables that aren't useful.
ATTRIBUTES = "__init__ __main__ __name__ __file__ __doc__ __package__ __builtins__ __dict__ __class__ __module__ __qualname__ __future__".split()
RETIRED = "file reduce fpectl future macpath symbol parser lib2to3 distutils test xdrlib".split()
COMMON = "self cls args kwargs data result value item key val obj instance other x y z i j k n m p q r s t u v w".split()


def excluded(more: Iterable[str] = ()) -> frozenset[str]:
    """Keywords, builtins and modules of the standard library, the lists above, and ``more`` in lower case. Names are
    looked up in lower case, so entries with capitals exclude nothing."""
    modules = {m for m in sys.stdlib_module_names if not m.startswith("_")}
    names = {*keyword.kwlist, *(b for b in dir(builtins) if not b.startswith("_")), *modules, *ATTRIBUTES, *RETIRED, *COMMON}
    return frozenset(names | {n.lower() for n in more})


def is_generic(name: Column, kind: Column) -> Column:
    low = F.lower(F.trim(name))
    return ((F.length(low) <= 1) & kind.isin("var", "import")) | ((F.length(low) <= 2) & (kind == "var")) | low.isin(*GENERIC)
