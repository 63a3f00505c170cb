"""Reviews and issues: states of checks, blocks and paths in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import snippets as N

#: Conclusions that fail, those still to come, and marks of a trace in a block.
FAILING, PENDING = ["FAILURE", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED", "ERROR"], ["PENDING", "EXPECTED", "QUEUED", "IN_PROGRESS"]
TRACES = ["traceback (most recent call last)", "\tat ", "panic:", "goroutine "]


def check_state(status: Column, conclusion: Column) -> Column:
    """failing, pending or passing, of a check's status and its conclusion (or the older state)."""
    s, c = F.upper(F.coalesce(status, F.lit(""))), F.upper(F.coalesce(conclusion, F.lit("")))
    return F.when((s != "") & (s != "COMPLETED") & (c == ""), "pending").when(c.isin(FAILING), "failing").when(c.isin(PENDING), "pending").otherwise("passing")


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(N.FENCE), F.lit(2))


def is_trace(block: Column) -> Column:
    made = F.lit(False)
    for mark in TRACES:
        made = made | F.lower(block).contains(mark)
    return made


def mentioned(text: Column) -> Column:
    """Paths of source files that a message names, each once, in order of name."""
    found = F.regexp_extract_all(text, F.lit(N.MENTIONED), F.lit(1))
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: F.lower(F.substring_index(x, ".", -1)).isin(N.CODE_SUFFIXES))))


def suggestions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(N.SUGGESTION), F.lit(1))
