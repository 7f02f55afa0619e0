"""Text functions as column expressions.  A null text gives null, or no tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def compact_blank(c: Column) -> Column:
    """Lines without white space at their ends, and every run of blank lines as one, at the beginning as well.

    Line ends of all kinds become a line feed, and the last one is dropped.
    """
    lines = F.regexp_replace(c, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    bare = F.regexp_replace(F.regexp_replace(lines, r"\n\z", ""), r"(?m)[^\S\n]+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"\A\n{2,}", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(inner, r"\n{2,}\z", "\n"), r"\A\n+\z", "")


def normalize_query(c: Column) -> Column:
    """A query string without outer white space, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def ref_handle(path: Column, start: Column, end: Column, body: Column) -> Column:
    """A short handle of a span of a file: ``ref:`` and eight hex digits."""
    whole = F.concat_ws(":", path, start.cast("string"), end.cast("string"), body)
    return F.concat(F.lit("ref:"), F.substring(F.sha1(whole), 1, 8))


def line_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of ``(start_line, end_line, body)`` windows of ``size`` lines.

    Consecutive windows share ``overlap`` lines; the last one ends at the last
    line.  A null text has no windows, an empty one a single empty line.
    """
    step = size - overlap
    lines = F.split(text, "\n")
    last = F.greatest(F.lit(1), F.size(lines) - F.lit(overlap))
    starts = F.sequence(F.lit(1), last, F.lit(step))
    return F.when(text.isNotNull(), F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start_line"),
            F.least(s + size - 1, F.size(lines)).alias("end_line"),
            F.array_join(F.slice(lines, s, F.lit(size)), "\n").alias("body"),
        ),
    ))
