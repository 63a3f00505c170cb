"""Lines, branches and names of source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and operators that count as a branch, and the starts of lines that don't count.
BRANCH = r"\b(if|elif|else if|for|while|case|when|catch|except|rescue|match|switch)\b|&&|\|\||\?\s"
COMMENT = r"(#|//|\*|/\*|--|\"\"\"|\'\'\')"
#: White space other than line ends, for Spark's and DuckDB's expressions alike.
BLANK = r"[ \t\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"
#: What ends a line.
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """Lines as an array; a last line end begins no further line, and the empty text has no lines."""
    whole = unified(text)
    cut = F.split(whole, "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.when(whole.endswith("\n"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut))


def unified(text: Column) -> Column:
    """The text with one kind of line end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LINE_END, "\n")


def loc(text: Column) -> Column:
    """Lines with anything but white space; one pass over the text."""
    return F.regexp_count(unified(text), F.lit(f"(?md)^{BLANK}*+[^\\n][^\\n]*+"))


def code(text: Column) -> Column:
    """The text without lines that are comments."""
    return F.regexp_replace(unified(text), f"(?md)^{BLANK}*+{COMMENT}[^\\n]*+", "")


def branches(text: Column) -> Column:
    """Branch words and operators on lines that aren't comments; one pass over the text."""
    inside = BRANCH.replace(r"\?\s", r"\?" + BLANK)  # not the line's own end
    return F.regexp_count(code(text), F.lit(f"(?U){inside}"))


def max_indent(text: Column, deepest: int = 12) -> Column:
    """Greatest depth of indent of a line that is neither empty nor a comment: four blanks (or mixed white space) or a tab each, up to ``deepest``."""
    indents = F.regexp_extract_all(code(text), F.lit(f"(?md)^([ \\t]*+)(?={BLANK}*+[^\\n])"), F.lit(1))
    depth = lambda x: F.least(F.when(x.contains(" "), F.floor(F.length(x) / 4)).otherwise(F.length(x)), F.lit(deepest)).cast("int")
    return F.coalesce(F.array_max(F.transform(indents, depth)), F.lit(0))


def tokens(name: Column) -> Column:
    """Lower-cased camel-case and snake-case parts of a name."""
    return F.transform(F.regexp_extract_all(name, F.lit("([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"), F.lit(1)), F.lower)


def suffixes(path: Column) -> Column:
    """All suffixes of a path on part bounds, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: Column) -> Column:
    """Folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def normal_path(path: Column) -> Column:
    """A path without '.', and with 'x/..' folded away; '..' at the start stays."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def needle(text: str) -> str:
    """A pattern for a traced value that takes no part of a longer number or name."""
    import re

    return r"(?<![\w.])" + re.escape(text) + r"(?![\w]|\.\d)"
