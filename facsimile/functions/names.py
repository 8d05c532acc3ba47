"""Columns by their plain names, whatever characters these hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as one identifier: dots, spaces and back quotes are part of it."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def free_name(wanted: str, taken) -> str:
    """``wanted``, with underscores in front until no column of ``taken`` has it (Spark ignores case)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted
