"""Functions paired with their documentation.

Two kinds of span are extracted on their own.  One scanner finds every comment
(comments, documentation attributes, statements that are nothing but a string);
another, which does not see comments, finds every statement and, among them, the
signature of the function that the chunk is named after.  Blank lines are
statements without words.  An as-of interval join, a window over the positions
of a chunk, attaches to each function the nearest span: the one that ends just
above the signature or, in Python, the one that begins just below it.  A
statement or blank line that stands between wins the match, which rejects the
comment.  Annotations and tool directives are no spans and are seen through.

A description is real if, without entries for parameters and results, notices,
separators and disabled code, it holds at least ``min_words`` different words
that are not words of the function's own name.

Defined cases
-------------
* rows with a null id, content, name or file path are no functions.
* repeated rows of an id count once; functions in parts count by their first
  part, and their code is put together from all parts.
* an unterminated comment or docstring runs to the end of its chunk.
* Chinese and Japanese signs count as words of their own.
* several signatures of one symbol: the one on the nearest line is taken.
* an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import inspect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_WORDS = 4

_SPANS = "id long, at int, until int, kind string, text string, below boolean"
_PART = re.compile(r"\(part (\d+)/\d+\)\s*$")
_PART_LINE = re.compile(r"\s*(?:#|//)\s.*\(part \d+/\d+\)\s*$")
_STRING = re.compile(r"([A-Za-z]{0,2})('''|\"\"\"|'|\")")
_PY_BLANK = re.compile(r"[ \t\r\n\f]+|#[^\n]*|\\\n")
_PY_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)")
_PY_TOKEN = re.compile(r"#[^\n]*|[A-Za-z]{0,2}('''|\"\"\"|'|\")|[()\[\]{}:;\n]|\\\n")
_ENDS = {q: re.compile(r"(?:[^\\]|\\.)*?" + re.escape(q), re.S) for q in ("'''", '"""')} | {
    q: re.compile(rf"(?:[^\\\n{q}]|\\.)*{q}", re.S) for q in ("'", '"')
}

# Comments that steer a tool; they may stand between a comment and its function.
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint[-\w]*|tslint|prettier-ignore|jshint|jslint|istanbul|c8 ignore|webpack\w*|@ts-\w+|@flow|@formatter|"
    r"NOLINT\w*|clang-(?:format|tidy)|cppcheck|IWYU|NOSONAR|CHECKSTYLE|noinspection|spotless|sonar|"
    r"go:\w+|nolint|\+build|lint:|rustfmt|clippy|#?\[?(?:inline|allow)\b|pragma\b|region\b|endregion\b|"
    r"noqa|type:\s*ignore|pylint|flake8|mypy|pyright|fmt:\s*(?:on|off)|isort|ruff|coverage|pragma:|editorconfig)(?=\W|$)",
    re.I,
)
_RULE = re.compile(r"^[\W_]*$|^[-=#*~_+/\\|<>. ]{3,}.*[-=#*~_+/\\|<>. ]{3,}$")
_NOTICE = re.compile(
    r"^\W*(?:(?:TODO|FIXME|XXX|TBD|HACK)\b|placeholder\b|docstring\b|n/a\b|"
    r"(?:add|insert|write)\s+(?:a\s+)?(?:description|documentation|docs?|docstring|comment)\b|"
    r"(?:missing|no)\s+(?:documentation|docs|description)\b|"
    r"(?:documentation|docs?|description)\s+(?:is\s+|are\s+|still\s+)*(?:to be|will be|missing|pending|needed|follows|goes here)|"
    r"(?:this\s+(?:code|file|method|function|class|stub)\s+(?:was|is|has been)\s+)?(?:auto(?:matically)?[- ]?)?generated\b.*|@generated\b|"
    r"do not (?:edit|modify)\b|inherit-?doc|\{@inheritDoc\})",
    re.I,
)
_LICENCE = re.compile(
    r"copyright\b|\(c\)\s|©|all rights reserved|spdx-license|licen[cs]ed under|governed by .{0,40}licen[cs]e|permission is hereby granted|"
    r"without warrant(?:y|ies)|redistribution and use",
    re.I,
)
_ENTRY = re.compile(r"^\s*(?:[@\\](?:params?|arg|args|argument|returns?|retval|result|throws?|exception|raises?|type|rtype|tparam|yields?|see|since|author|deprecated)\b|:(?:param|parameter|arg|type|returns?|rtype|raises?|yields?|keyword)\b[^:]*:)")
_SECTION = re.compile(r"^\s*(?:#+\s*|\*\*)?(?:parameters?|params|args|arguments?|other parameters|returns?|results?|yields?|raises|throws|errors|panics|keyword args)(?:\*\*)?\s*:?\s*$", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*#\s*(?:if|ifdef|ifndef|else|elif|endif|define|undef|include)\b|^\s*[}\])]|^\s*(?:case\b.*|default|else|try|finally)\s*:\s*$|^\s*(?:let|const|var|auto|int|char|return|defer|assert|import|from|raise|yield|await)\b.*[=()]"
    r"|^[\w.\[\]>:*&-]+\s*(?::=|[-+*/|&]?=)\s*\S|^\s*[\w.>:-]+\((?:.*\)\s*[;,]?\s*|\s*)$|^\s*(?:for|if|while|switch|match|with)\b.*[({:]\s*$|^\s*[\w.]+\s*[:=]\s*[\w.]+\s*[/+*-]\s*[\w.]+,?$|^\s*\.\.\.\w+",
)
_MANY = re.compile(r"[A-Za-z]{2,}[ ,]+[A-Za-z]{2,}[ ,]+[A-Za-z]{2,}[ ,]+[A-Za-z]{2,}")


def _is_code(line: str) -> bool:
    if not _CODE.search(line):
        return False
    # prose that merely ends in a semicolon or names a call
    return not (_MANY.search(line) and not re.search(r"[={}\[\]]|\w\(", line))


def describe(comment: str) -> str:
    """The describing words of a comment's text, its marks already taken off."""
    kept: list[str] = []
    block: list[str] = []
    section = False

    def close() -> None:
        if block:
            if not (_NOTICE.search(block[0]) or _LICENCE.search(" ".join(block))):
                kept.extend(x for x in block if not _NOTICE.search(x))
            block.clear()

    entry = False
    for line in inspect.cleandoc(comment).splitlines():
        flat = line.strip()
        if not flat:
            close()
            entry = section = False
        elif _SECTION.match(line):
            close()
            section = True
        elif _ENTRY.match(line):
            close()
            entry = True
        elif section or entry or _RULE.match(flat) or _DIRECTIVE.match(flat):
            continue
        elif _is_code(flat):
            close()
        else:
            block.append(re.sub(r"^[@\\](?:brief|short|summary|details|description|desc|note)\b", "", flat))
    close()
    return " ".join(kept)


def _string(text: str, at: int) -> tuple[int, str, str] | None:
    """End, prefix and body of the string literal at ``at``."""
    m = _STRING.match(text, at)
    if not m:
        return None
    end = _ENDS[m[2]].match(text, m.end())
    if end:
        return end.end(), m[1].lower(), text[m.end() : end.end() - len(m[2])]
    return (len(text), m[1].lower(), text[m.end() :]) if len(m[2]) == 3 else None


def _python_lines(text: str) -> list[tuple[int, int, bool]]:
    """Logical lines, and whether each is a signature; what follows a signature's colon is a line of its own."""
    out: list[tuple[int, int, bool]] = []
    begin, depth, at, signature = -1, 0, 0, False
    while True:
        t = _PY_TOKEN.search(text, at)
        stop = t.start() if t else len(text)
        if begin < 0:
            rest = text[at:stop].lstrip(" \t\f\r")
            if rest or (t and t[0][0] not in "#\n\\;"):
                begin = stop - len(rest)
                signature = bool(_PY_DEF.match(text, begin))
        if not t:
            break
        at, c = t.end(), t[0]
        if t[1]:
            s = _string(text, t.start())
            at = s[0] if s else at
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif depth == 0 and begin >= 0 and (c in "\n;" or c == ":" and signature):
            out.append((begin, at if c == ":" else stop, c == ":"))
            begin, signature = -1, False
    if begin >= 0:
        out.append((begin, len(text), False))
    return out


def _literal(text: str, begin: int, end: int) -> str | None:
    """The string that a logical line consists of, or null."""
    at, inside, parts = begin, 0, []
    while at < end:
        if text[at] == "(" and not parts:
            inside, at = inside + 1, at + 1
        elif s := _string(text, at):
            if set(s[1]) - set("ru"):
                return None
            parts.append(s[2])
            at = s[0]
        elif m := _PY_BLANK.match(text, at):
            at = m.end()
        elif inside and text[at] == ")":
            inside, at = inside - 1, at + 1
        else:
            return None
    return "".join(parts) if parts and not inside else None


def _python_comments(text: str) -> list[tuple]:
    """Every statement that is nothing but a string."""
    return [
        (a, b, "comment", body)
        for a, b, _ in _python_lines(text)
        if text[a] in "rRuU'\"(" and (body := _literal(text, a, b)) is not None
    ]


def _python_statements(text: str, name: str) -> list[tuple]:
    """Every statement but strings, and the signature of ``name``, or else the first one, as the function."""
    out = []
    for a, b, signature in _python_lines(text):
        if signature or not (text[a] in "rRuU'\"(" and _literal(text, a, b) is not None):
            out.append((a, b, "statement", text[a:b] if signature else None))
    heads = [k for k, s in enumerate(out) if s[3]]
    own = [k for k in heads if _PY_DEF.match(out[k][3])[1] == name]
    return [(*s[:2], "function" if [k] == (own or heads)[:1] else "statement", s[3]) for k, s in enumerate(out)]


_LINE_MARK = re.compile(r"^\s*(?:///?!?|//!|\*(?!/)|#+)\s?")
_ATTR = r"#!?\[\s*doc\s*=\s*r?#*\"((?:[^\"\\]|\\.)*)\"#*\s*\]"
_COMMENT = rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{_ATTR}"
#: Comments and literals; a single quote holds one character outside of scripts.
_BRACE_TOKEN = re.compile(rf"({_COMMENT})|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'", re.S)
_SCRIPT_TOKEN = re.compile(rf"({_COMMENT})|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_LINE_ENDS = (".go", ".js", ".jsx", ".mjs", ".ts")
_NOTE_AT = re.compile(r"^[ \t]*(?:#!?\[|\[\[|#(?:[^\n\\]|\\\n|\\)*)|@[\w.$]+[ \t]*\(?", re.M)
_STEP = re.compile(r"[()\[\]{};]|\n[ \t\r]*(?=\n)|\n")
_GOES_ON = re.compile(r"\s*[{.?:=&|+*/<>,)\]-]")
_MODIFIER = re.compile(r"\b(?:export|default|async|static|public|private|protected|abstract|readonly|override|declare|get|set)\s*\Z")


def _strip_block(raw: str) -> str:
    body = re.sub(r"^\s*/\*[*!]?|\*/\s*$", "", raw)
    return "\n".join(re.sub(r"^\s*\*\s?", "", x) for x in body.split("\n"))


def _brace_comments(text: str, script: bool) -> list[tuple]:
    """Every comment that begins its line, line comments and documentation attributes in runs; directives are none."""
    out: list[tuple] = []
    run: list[tuple[int, int, str]] = []
    until = 0

    def close() -> None:
        if run:
            out.append((run[0][0], run[-1][1], "comment", "\n".join(x[2] for x in run)))
            run.clear()

    for m in (_SCRIPT_TOKEN if script else _BRACE_TOKEN).finditer(text):
        raw = m[1]
        if raw is None or text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            continue  # a literal, or a comment behind code
        block = raw.startswith("/*")
        body = _strip_block(raw) if block else m[2].replace('\\"', '"') if m[2] is not None else _LINE_MARK.sub("", raw)
        if run and (block or text[until : m.start()].strip() or text.count("\n", until, m.start()) > 1):
            close()
        if _DIRECTIVE.match(body.strip() if block else body):
            until = m.end() if run else until
        elif block:
            out.append((m.start(), m.end(), "comment", body))
        else:
            run.append((m.start(), m.end(), body))
            until = m.end()
    close()
    return out


def _masked(text: str, script: bool) -> str:
    """``text`` with comments, literals, annotations and directives blanked, every sign at its place."""
    blank = lambda raw, sign: re.sub(r"[^\n]", sign, raw)
    flat = (_SCRIPT_TOKEN if script else _BRACE_TOKEN).sub(lambda m: blank(m[0], "\x01" if m[1] is not None else '"'), text)
    parts, at = [], 0
    while m := _NOTE_AT.search(flat, at):
        end = m.end()
        if m[0][-1] in "([":
            depth, begin = 1, end
            for b in _BRACKET.finditer(flat, begin):
                depth += 1 if b[0] in "([{" else -1
                if not depth:
                    end = b.end()
                    break
            if m[0].lstrip().startswith("[[") and flat[end : end + 1] == "]":
                end += 1
        parts += [flat[at : m.start()], blank(flat[m.start() : end], "\x01")]
        at = end
    return "".join([*parts, flat[at:]])


_BRACKET = re.compile(r"[()\[\]{}]")


def _brace_statements(text: str, name: str, script: bool, line_ends: bool) -> list[tuple]:
    """Every statement outside of brackets, that which names ``name`` as the function, and the blank lines between."""
    flat = _masked(text, script)
    out: list[tuple[int, int]] = []
    blanks: list[tuple] = []
    begin, depth, at = -1, 0, 0

    def reach(stop: int) -> None:
        nonlocal begin
        if begin < 0:
            rest = flat[at:stop].lstrip(" \t\r\n\f\x01")
            if rest:
                begin = stop - len(rest)

    for t in _STEP.finditer(flat):
        reach(t.start())
        c = t[0]
        at = t.end()
        if c in "([{":
            begin = t.start() if begin < 0 else begin
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
            if c == "}" and not depth and begin >= 0 and not _GOES_ON.match(flat, at):
                out.append((begin, at))
                begin = -1
        elif depth:
            continue
        elif c == ";":
            if begin >= 0:
                out.append((begin, at))
            begin = -1
        elif begin < 0:
            if len(c) > 1 or not flat[flat.rfind("\n", 0, t.start()) + 1 : t.start()].strip():
                blanks.append((t.start(), t.start(), "statement", None))
        elif line_ends and flat[t.start() - 1].isalnum() | (flat[t.start() - 1] in "_)]}\"") and not _GOES_ON.match(flat, at) and not _MODIFIER.search(flat[begin : t.start()]):
            out.append((begin, t.start()))
            begin = -1
    reach(len(flat))
    if begin >= 0:
        out.append((begin, len(flat)))
    named = re.compile(rf"(?<![\w$]){re.escape(name)}\s*(?:<[^;{{]*>\s*)?(?:\[[^\]]*\]\s*)?[(=:?]") if name else None
    own = [k for k, (a, b) in enumerate(out) if named and named.search(flat, a, b)] or [k for k, (a, b) in enumerate(out) if "(" in flat[a:b]] or [0]
    spans = [(a, b, "function" if k == own[0] else "statement", text[a:b].split("\n", 1)[0] if k == own[0] else None) for k, (a, b) in enumerate(out)]
    return spans + blanks


def _name_of(name: str) -> str:
    """The bare name of a function chunk."""
    return re.split(r"\.|::|#", _PART.sub("", name.removeprefix("def ")).strip())[-1].strip()


def _spans(batches):
    for pdf in batches:
        ids, a, b, kinds, texts, below = [], [], [], [], [], []
        for id_, path, name, text in zip(pdf["id"], pdf["filepath"], pdf["name"], pdf["content"]):
            text = text.replace("\r\n", "\n")
            head = text.split("\n", 1)
            if len(head) == 2 and _PART_LINE.match(head[0]):
                text = head[1]
            own, python, script = _name_of(name), path.endswith((".py", ".pyi")), path.endswith(_LINE_ENDS[1:])
            comments = _python_comments(text) if python else _brace_comments(text, script)
            comments = [(*s[:3], describe(s[3])) for s in comments]
            if not any(s[3] for s in comments):
                continue  # nothing here can describe a function
            found = _python_statements(text, own) if python else _brace_statements(text, own, script, path.endswith(_LINE_ENDS))
            for s in comments + found:
                ids.append(id_)
                a.append(s[0])
                b.append(s[1])
                kinds.append(s[2])
                texts.append(s[3])
                below.append(python)
        if ids:  # columns without rows have no type that fits
            yield pd.DataFrame({"id": ids, "at": a, "until": b, "kind": kinds, "text": texts, "below": below})


def first_parts(chunks: DataFrame) -> DataFrame:
    """Chunks that are functions, without the later parts of long ones."""
    part = F.regexp_extract("name", r"\(part (\d+)/\d+\)\s*$", 1)
    return chunks.where(
        F.col("id").isNotNull()
        & F.col("content").isNotNull()
        & F.col("filepath").isNotNull()
        & (F.col("chunk_type") == "code")
        & F.col("name").startswith("def ")
        & part.isin("", "1")
    )


def spans(functions: DataFrame) -> DataFrame:
    """Comment, function and statement spans of every chunk that holds a description at all."""
    return functions.select("id", "filepath", "name", "content").mapInPandas(_spans, _SPANS)


def attach_nearest(spans: DataFrame) -> DataFrame:
    """As-of interval join: the nearest span next to each function span.

    ``below`` says on which side a language keeps its comments.  The nearest
    span may be a statement, and then no comment is attached.
    """
    # above a signature the end of a span tells how near it is, below it the beginning
    is_function = F.col("kind") == "function"
    near_at = F.when(F.col("below") | is_function, F.col("at")).otherwise(F.col("until"))
    place = W.partitionBy("id").orderBy(near_at, is_function, "at")
    other = F.when(F.col("kind") != "function", F.struct("kind", "text"))
    above = F.last(other, ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, -1))
    under = F.first(other, ignorenulls=True).over(place.rowsBetween(1, W.unboundedFollowing))
    near = F.when(F.col("below"), under).otherwise(above)
    return (
        spans.withColumn("near", near)
        .where("kind = 'function' AND near.kind = 'comment'")
        .select("id", F.col("text").alias("header"), F.col("near.text").alias("description"))
    )


def _words(c) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+)"), F.lit(1))


def _name_words(name) -> F.Column:
    split = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.concat(_words(split), _words(name))


def documented(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, description)``: functions with real documentation, each once."""
    functions = first_parts(chunks)
    own = F.regexp_extract("qualified_name", r"([^.:]+)\s*$", 1)
    names = functions.select("id", _name_words(F.coalesce(own, F.lit(""))).alias("own"))
    # repeated rows have equal spans, so that the nearest one is the same; the window has already spread them by id
    found = attach_nearest(spans(functions)).dropDuplicates(["id"])
    return (
        names.dropDuplicates(["id"])
        .join(found, "id")
        .where(F.size(F.array_except(F.array_distinct(_words(F.col("description"))), F.col("own"))) >= min_words)
        .select("id", "header", "description")
    )


def pairs(chunks: DataFrame, symbols: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per documented function: its whole code and its description.

    Columns: ``id, qualified_name, filepath, signature`` (null where ``symbols``
    has none), ``description, code``.
    """
    docs = documented(chunks, min_words).select("id", "description")
    rows = chunks.where("chunk_type = 'code' AND id IS NOT NULL AND content IS NOT NULL AND name LIKE 'def %'")
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(name, '\\(part (\\d+)/\\d+\\)\\s*$', 1) AS INT)"), F.lit(1))
    lines = F.split("content", "\n")
    n = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    # a later part repeats a heading line and the signature above its own lines
    own = F.when(part == 1, F.regexp_replace("content", r"\A[ \t]*(?:#|//) [^\n]*\(part \d+/\d+\)[ \t]*\n", "")).otherwise(
        F.when(F.size(lines) > n, F.array_join(F.slice(lines, -n, n), "\n")).otherwise(F.col("content"))
    )
    code = (
        rows.select(F.when(part == 1, F.col("id")).otherwise(F.col("parent_id")).alias("id"), part.alias("part"), own.alias("own"), "qualified_name", "filepath", "start_line", "symbol_name")
        .join(docs.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(
            F.array_sort(F.collect_set(F.struct("part", "own"))).alias("parts"),
            F.min(F.when(F.col("part") == 1, F.struct("qualified_name", "filepath", "start_line", "symbol_name"))).alias("f"),
        )
        .select("id", "f.*", F.array_join(F.transform("parts", lambda p: p["own"]), "\n").alias("code"))
    )
    named = symbols.where("signature IS NOT NULL AND symbol_type = 'def'").select(
        "filepath", F.col("name").alias("symbol_name"), F.col("line"), "signature"
    ).distinct()
    # signatures are looked up by place, so that no code travels but by id
    near = F.when(F.col("line") >= F.col("start_line"), F.struct(F.col("line") - F.col("start_line"), "signature"))
    places = rows.where(part == 1).select("id", "filepath", "start_line", "symbol_name").join(docs.select("id"), "id", "left_semi")
    signed = places.join(named, ["filepath", "symbol_name"]).groupBy("id").agg(F.min(near)["signature"].alias("signature"))
    full = code.join(docs, "id").join(signed, "id", "left")
    return full.select("id", "qualified_name", "filepath", "description", "code", "signature")
