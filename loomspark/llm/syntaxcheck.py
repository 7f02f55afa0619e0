"""Source files that do not parse, flagged per file and rated per repository.

A text is cut into stretches at line ends.  Each stretch becomes a lexer-state
map: for every state in which it may begin, the state at its end, the brackets
it leaves open on either side, and what the local grammars of its language leave
of it, which parse whatever stands in balanced brackets as soon as these are
closed.  Maps of neighbours compose associatively: those of up to ``FAN``
stretches in the task that scans the text, those of longer texts across
partitions.  Only faults and the maps of such longer texts leave the scan; no
text is shuffled or read twice.

Python is read by the running interpreter's own grammar, a file at a time, as
the balance of its statements hangs on indentation and nested f-strings.

Defined cases
-------------
* the language follows from the file ending; other endings are never flagged.
* a file without a current text, or with a null text, is not flagged.
* an empty text is valid; for Go it lacks its package clause and is flagged.
* where repeated rows of one version differ in text, one invalid text flags it.
* a text with a state that no map foresees (nested comments, templates across
  stretches) is read as a single stretch.
* tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import grammars as G
from loomspark.llm import lexing as L
from loomspark.session import cut
from loomspark.sources.tables import clean_project, current_files

STRETCH = 1 << 15
FAN = 64

_MAP = "map<string,array<string>>"
_FOUND = f"filepath string, sha256 string, text long, part long, fault string, map {_MAP}"
_IF = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b", re.M)


def language_of(path) -> F.Column:
    """Language by file ending; null where it is not one of those checked."""
    known = F.create_map(*[F.lit(x) for kv in L.LANGUAGE.items() for x in kv])
    return known[F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))]


def stretches(language: str, text: str, size: int = STRETCH) -> list[str]:
    """``text`` cut at line ends where neither a line nor a condition goes on."""
    if len(text) <= size:
        return [text]
    steps = [(m.start(), -1 if m[1] == "endif" else 1) for m in _IF.finditer(text)] if language in ("c", "cpp") else []
    out, begin, at, depth, k = [], 0, size, 0, 0
    while at < len(text):
        end = text.find("\n", at) + 1
        if not end or end >= len(text):
            break
        while k < len(steps) and steps[k][0] < end:
            depth += steps[k][1]
            k += 1
        # behind a line that ends a statement or a block, so that no statement is cut
        if depth or text[end - 2 : end - 1] not in (";", "{", "}", "\n") or text[end] == "/":
            at = end
            continue
        out.append(text[begin:end])
        begin, at = end, end + size
    out.append(text[begin:])
    return out


def _map_of(language: str, text: str) -> list[dict]:
    """The maps of a text's stretches, or of the whole where a state is unforeseen."""
    maps = [L.state_map(language, part, k == 0) for k, part in enumerate(stretches(language, text))]
    return maps if L.fold(maps) is not None else [L.state_map(language, text, True)]


def fault_of(language: str, text: str, known: L.Summary | None = None) -> str | None:
    """What is wrong with a whole file, or null; ``known`` is its folded summary."""
    if language == "python":
        return G.python(text)
    return L.verdict(known or L.fold(_map_of(language, text.replace("\r\n", "\n"))))


def _scan(batches):
    for pdf in batches:
        out = []
        for path, sha, lang, key, text in zip(pdf["filepath"], pdf["sha256"], pdf["language"], pdf["key"], pdf["content"]):
            if lang == "python":
                maps, fault = [], G.python(text)
            else:
                maps = _map_of(lang, text.replace("\r\n", "\n"))
                maps = [L.chain(lang, maps[k : k + FAN]) for k in range(0, len(maps), FAN)]
                fault = L.verdict(L.fold(maps)) if len(maps) == 1 else None
            if len(maps) > 1:
                out += [(path, sha, key, k, None, m) for k, m in enumerate(maps)]
            elif fault:
                out.append((path, sha, key, 0, fault, None))
        yield pd.DataFrame(out, columns=["filepath", "sha256", "text", "part", "fault", "map"])


def _folded(batches):
    for pdf in batches:
        faults = [L.verdict(L.fold([{s: list(r) for s, r in p["map"]} for p in parts])) for parts in pdf["parts"]]
        yield pd.DataFrame({"filepath": pdf["filepath"], "sha256": pdf["sha256"], "fault": faults}).dropna()


def invalid_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``(filepath, fault)`` of every file whose current text is not valid."""
    texts = sources.where("filepath IS NOT NULL AND sha256 IS NOT NULL AND content IS NOT NULL")
    texts = texts.withColumn("language", language_of(F.col("filepath"))).where("language IS NOT NULL")
    found = texts.select("filepath", "sha256", "language", F.xxhash64("content").alias("key"), "content").mapInPandas(_scan, _FOUND)
    # as texts are scanned once, what the scan has found is kept
    found = cut(found, "syntax-found")
    parts = F.array_sort(F.collect_list(F.struct("part", "map")), lambda a, b: (a["part"] - b["part"]).cast("int"))
    long = found.where("map IS NOT NULL").dropDuplicates(["filepath", "sha256", "text", "part"])
    long = long.groupBy("filepath", "sha256", "text").agg(parts.alias("parts")).select("filepath", "sha256", "parts")
    faults = found.where("map IS NULL").select("filepath", "sha256", "fault").unionByName(long.mapInPandas(_folded, "filepath string, sha256 string, fault string"))
    now = current_files(files).where("sha256 IS NOT NULL").select("filepath", "sha256")
    return faults.groupBy("filepath", "sha256").agg(F.min("fault").alias("fault")).join(now, ["filepath", "sha256"], "left_semi").select("filepath", "fault")


def rates(files: DataFrame, chunks: DataFrame, invalid: DataFrame) -> DataFrame:
    """``(project, language, n_files, n_invalid, rate)`` over current files.

    The language is the commonest of the file's chunks, lower case, else null.
    """
    language = F.lower(F.trim("language"))
    spoken = (
        chunks.where(F.col("filepath").isNotNull() & (language != ""))
        .groupBy("filepath", language.alias("language"))
        .agg(F.count("*").alias("k"))
        .groupBy("filepath")
        .agg(F.max(F.struct("k", "language"))["language"].alias("language"))
    )
    return (
        current_files(files)
        .select("filepath", "project")
        .join(spoken, "filepath", "left")
        .join(invalid.select("filepath", F.lit(1).alias("bad")), "filepath", "left")
        .groupBy("project", "language")
        .agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"), (F.count("bad") / F.count("*")).alias("rate"))
    )


def hinted(invalid: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Flagged files with the number of stored diagnostics that agree.

    Paths are compared without leading ``./`` or ``/`` and with forward slashes.
    """
    key = F.regexp_replace(F.regexp_replace("filepath", r"\\", "/"), r"^(?:\./|/)+", "")
    hints = diagnostics.where("filepath IS NOT NULL AND message IS NOT NULL").groupBy(key.alias("key")).agg(F.countDistinct("line", "message").alias("n_hints"))
    return (
        invalid.withColumn("key", key)
        .join(hints, "key", "left")
        .select("filepath", "fault", F.coalesce("n_hints", F.lit(0)).alias("n_hints"))
    )
