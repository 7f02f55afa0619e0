"""Lexer-state maps and bracket summaries of stretches of source text.

``advance`` reads a stretch from a given lexer state.  Its summary holds the
state at the end, the brackets that the stretch leaves open on either side, its
fault, and what is left of its code and of its token classes once balanced
brackets have been looked at by the local grammars and emptied.  ``state_map`` holds the summaries for every state in
which a stretch may begin; ``compose`` joins the summaries of neighbours and is
associative, so that the stretches of a file can be reduced in any grouping.
"""

from __future__ import annotations

import re

from loomspark.llm import grammars as G
from loomspark.llm import shapes as H

CODE = "code"
OPAQUE = "opaque"

# File endings by language.
LANGUAGE = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
}

_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?\*/"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"

_TOKENS = {
    "c": rf"({_LINE}|{_BLOCK})|((?:u8|[uUL])?{_DQ}|(?:u8|[uUL])?{_SQ})|(/\*|[\"'])",
    "cpp": rf"({_LINE}|{_BLOCK})|((?:u8|[uUL])?R\"([^()\\\s]{{0,16}})\(.*?\)\3\"|(?:u8|[uUL])?{_DQ}|(?<![0-9a-fA-F])(?:u8|[uUL])?{_SQ})|(/\*|R\"[^()\\\s]{{0,16}}\(|[\"']|(?<=[0-9a-fA-F])'(?=[0-9a-fA-F]))",
    "java": rf'({_LINE}|{_BLOCK})|("""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""|(?!"""){_DQ}|{_SQ})|(/\*|"""|["\'])',
    "go": rf"({_LINE}|{_BLOCK})|(`[^`]*`|{_DQ}|{_SQ})|(/\*|[`\"'])",
    "rust": r"(//[^\n]*)|(b?c?r(#*)\".*?\"\3|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'|'[A-Za-z_]\w*(?!'))|(/\*|b?c?r#*\"|[\"'])",
    "javascript": rf"({_LINE}|{_BLOCK})|({_DQ}|{_SQ})|([`{{}}]|/\*|[\"']|/)",
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_TOKENS = {k: re.compile(v, re.S) for k, v in _TOKENS.items()}
_REGEX = re.compile(_REGEX, re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_TEMPLATE_LEFT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*\Z", re.S)
_NESTED = re.compile(r"/\*|\*/")
# a slash behind these begins a regular expression
_REGEX_AFTER = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await))\s*\Z")
_HEAD_AFTER = re.compile(r"\b(?:if|while|for)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*\Z")
_FAULTS = {"'": "unterminated character or string", '"': "unterminated string"}
_BRACKETS = str.maketrans("", "", "".join(chr(c) for c in range(128) if chr(c) not in "()[]{}"))

#: How the states other than code end.
_CLOSE = {
    "comment": re.compile(r"\*/"),
    "template": _TEMPLATE,
    "raw": re.compile(r"`"),
    "textblock": re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
    "rstring": re.compile(r'(?:[^"\\]|\\.)*"', re.S),
}
STATES = {
    "c": ["comment"],
    "cpp": ["comment", 'raw:)"'],
    "java": ["comment", "textblock"],
    "go": ["comment", "raw"],
    "rust": ["comment:1", "rstring", 'raw:"', 'raw:"#'],
    "javascript": ["comment"],
    "typescript": ["comment"],
}


class Summary:
    """What a stretch does: end state, brackets closed and opened, fault, and what is left of code and token classes."""

    __slots__ = ("language", "end", "closes", "opens", "fault", "code", "flat")

    def __init__(self, language: str, end: str, closes: str = "", opens: str = "", fault: str | None = None, code: str = "", flat: str = ""):
        self.language, self.end, self.closes, self.opens, self.fault, self.code, self.flat = language, end, closes, opens, fault, code, flat

    def row(self) -> list:
        return [self.language, self.end, self.closes, self.opens, self.fault, self.code, self.flat]


_MISMATCH = "mismatched bracket"
_BROKEN = "malformed statement in brackets"


def _worse(*faults: str | None) -> str | None:
    """The one fault that is told, the same in whatever grouping it was found."""
    found = [f for f in faults if f]
    return _MISMATCH if _MISMATCH in found else min(found, default=None)


_PAIR = {"(": ")", "[": "]", "{": "}"}


def brackets(code: str) -> tuple[str, str, bool]:
    """Unmatched closing and opening brackets, and whether pairs are mismatched."""
    left = code.translate(_BRACKETS) if code.isascii() else re.sub(r"[^()\[\]{}]+", "", code)
    while True:
        n = len(left)
        left = left.replace("()", "").replace("[]", "").replace("{}", "")
        if len(left) == n:
            break
    m = re.fullmatch(r"([)\]}]*)([(\[{]*)", left)
    return (m[1], m[2], False) if m else ("", "", True)


def compose(a: Summary, b: Summary) -> Summary:
    """The summary of two neighbours, ``b`` read from the end state of ``a``."""
    n = min(len(a.opens), len(b.closes))
    if _MISMATCH in (a.fault, b.fault) or any(_PAIR[a.opens[-1 - k]] != b.closes[k] for k in range(n)):
        return Summary(a.language, b.end, fault=_MISMATCH)
    flat, bad = H.reduce(a.language, a.flat + b.flat)
    fault = _worse(a.fault, b.fault, _BROKEN if bad else None)
    return Summary(a.language, b.end, a.closes + b.closes[n:], a.opens[: len(a.opens) - n] + b.opens, fault, G.reduced(a.code + b.code), flat)


def _leave(state: str, text: str) -> tuple[int, str]:
    """Where a stretch that begins in ``state`` comes back to code, if it does."""
    if state == CODE:
        return 0, CODE
    kind, _, arg = state.partition(":")
    if kind == "comment" and arg:
        depth = int(arg)
        for m in _NESTED.finditer(text):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end(), CODE
        return -1, f"comment:{depth}"
    if arg:
        at = text.find(arg)
        return (at + len(arg), CODE) if at >= 0 else (-1, state)
    m = _CLOSE[kind].match(text) if kind in ("textblock", "rstring") else _CLOSE[kind].search(text)
    return (m.end(), CODE) if m else (-1, state)


def _open_state(language: str, token: str) -> str:
    if token == "/*":
        return "comment:1" if language == "rust" else "comment"
    if language == "go" and token == "`":
        return "raw"
    if language == "java" and token == '"""':
        return "textblock"
    if language == "rust" and token == '"':
        return "rstring"
    if language == "rust" and "r" in token:
        return "raw:" + '"' + "#" * token.count("#")
    if language == "cpp" and token.startswith("R"):
        return "raw:)" + token[2:-1] + '"'
    return ""


def _strip(language: str, text: str) -> tuple[str, str, str | None]:
    """Code with comments and literals taken out, the end state, the first fault."""
    out: list[str] = []
    at, find = 0, _TOKENS[language].search
    while m := find(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            out.append("\n" if "\n" in m[1] else " ")
            continue
        if m[2] is not None:
            out.append("'x" if language == "rust" and m[2][0] == "'" and m[2][-1] != "'" else '"')
            continue
        token = m[0]
        if token == "'" and language == "cpp" and m.start() and text[m.start() - 1].isalnum() and at < len(text) and text[at].isalnum():
            continue  # digit separator
        if token == "/*" and language == "rust":
            end, state = _leave("comment:1", text[at:])
            if end < 0:
                return "".join(out), state, None
            at += end
            out.append(" ")
            continue
        state = _open_state(language, token)
        if state:  # a literal that goes on stands where it begins
            return "".join(out) + ("" if state.startswith("comment") else '"'), state, None
        return "".join(out), CODE, _FAULTS.get(token, "unterminated string")
    out.append(text[at:])
    return "".join(out), CODE, None


def _strip_script(language: str, text: str) -> tuple[str, str, str | None]:
    """As ``_strip``, with template strings and regular expressions."""
    out: list[str] = []
    stack: list[str] = []
    at, find = 0, _TOKENS[language].search
    while m := find(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        token = m[0]
        if m[1] is not None:
            out.append("\n" if "\n" in token else " ")
        elif m[2] is not None:
            out.append('"')
        elif token == "{":
            stack.append("{")
            out.append("{")
        elif token == "`" or (token == "}" and stack and stack[-1] == "`"):
            if token == "}":
                stack.pop()
                out.append(")")
            t = _TEMPLATE.match(text, at)
            if not t:
                return "".join(out) + '"', OPAQUE if stack else "template", "unterminated template" if not _TEMPLATE_LEFT.match(text, at) else None
            at = t.end()
            if t[1] == "${":
                stack.append("`")
                out.append('"+(' if token == "`" else "+(")
            else:
                out.append('"' if token == "`" else "")
        elif token == "}":
            if stack:
                stack.pop()
            out.append("}")
        elif token == "/":
            before = "".join(out[-6:])[-40:]
            r = _REGEX.match(text, m.start()) if _REGEX_AFTER.search(before) or before.rstrip().endswith(")") and _HEAD_AFTER.search("".join(out[-20:])[-300:]) else None
            if r:
                at = r.end()
                out.append('"')
            else:
                out.append("/")
        elif token == "/*":
            return "".join(out), "comment", None
        else:
            # an apostrophe in the text of an element is no string
            return "".join(out), CODE, _FAULTS[token]
    out.append(text[at:])
    return "".join(out), OPAQUE if "`" in stack else CODE, None


def strip(language: str, text: str) -> tuple[str, str, str | None]:
    """Code of ``text`` read from the code state; the end state; the first fault."""
    return (_strip_script if language in ("javascript", "typescript") else _strip)(language, text)


_DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*(?:\\\r?\n[^\n]*)*", re.M)
_DEAD = re.compile(r"^[ \t]*#[ \t]*if[ \t]+0\b.*?^[ \t]*#[ \t]*(?:endif|else)\b[^\n]*|^[ \t]*#[ \t]*(?:else|elif)\b.*?(?=^[ \t]*#[ \t]*endif\b)", re.M | re.S)


_PROSE = re.compile(r"(^[ \t]*#[ \t]*if[ \t]+0\b[^\n]*\n)(?:(?![ \t]*#)[^\n]*\n)*|(^[ \t]*#[ \t]*(?:error|warning))\b[^\n]*", re.M)


def preprocess(text: str) -> tuple[str, str | None]:
    """C text without directives and branches that are not taken."""
    depth, fault = 0, None
    for m in re.finditer(r"^[ \t]*#[ \t]*([A-Za-z_]\w*|[^\s\w][^\n]*|\d[^\n]*)?", text, re.M):
        name = m[1] or ""
        if name in ("if", "ifdef", "ifndef"):
            depth += 1
        elif name == "endif":
            depth -= 1
            if depth < 0:
                fault = fault or "#endif without #if"
        elif name in ("else", "elif", "elifdef", "elifndef"):
            if not depth:
                fault = fault or "#else without #if"
        elif name and name not in ("define", "undef", "include", "include_next", "import", "error", "warning", "pragma", "line", "ident", "embed"):
            fault = fault or "unknown directive"
    if depth > 0:
        fault = fault or "unterminated #if"
    return _DIRECTIVE.sub("", _DEAD.sub("", text)), fault


def advance(language: str, state: str, text: str) -> Summary:
    """The summary of one stretch that begins in ``state``."""
    begin, state = _leave(state, text)
    if begin < 0:
        return Summary(language, state)
    text = text[begin:] if begin else text
    code, end, fault = strip(language, text)
    if fault and language in ("c", "cpp") and _PROSE.search(text):
        # prose in lines that are not compiled may hold apostrophes
        code, end, fault = strip(language, _PROSE.sub(r"\1\2", text))
    if fault:
        return Summary(language, end, fault=fault)
    if language in ("c", "cpp"):
        code, fault = preprocess(code)
    closes, opens, mixed = brackets(code)
    if mixed:
        return Summary(language, end, fault=_MISMATCH)
    flat, bad = H.reduce(language, H.letters(language, code))
    fault = _worse(fault, G.patterns(language, code), _BROKEN if bad else None)
    return Summary(language, end, closes, opens, fault, G.reduced(code), flat)


def verdict(total: Summary) -> str | None:
    """What is wrong with a file that a summary stands for, or null where it is valid."""
    if total.fault:
        return total.fault
    if total.end != CODE:
        return "unterminated " + total.end.partition(":")[0]
    if total.closes or total.opens:
        return "unbalanced bracket"
    return G.outline(total.language, total.code) or ("malformed statement" if H.top(total.language, total.flat) else None)


def state_map(language: str, text: str, first: bool) -> dict[str, list]:
    """Summaries by start state; the first stretch begins in code for certain."""
    starts = [CODE] if first else [CODE, *STATES[language]]
    return {s: advance(language, s, text).row() for s in starts}


def fold(maps: list[dict[str, list]], state: str = CODE) -> Summary | None:
    """Neighbouring maps from ``state``; null where a map does not know a state."""
    part = maps[0].get(state)
    total = Summary(*part) if part is not None else None
    for m in maps[1:]:
        part = m.get(total.end) if total else None
        if part is None:
            return None
        total = compose(total, Summary(*part))
    return total


def chain(language: str, maps: list[dict[str, list]]) -> dict[str, list]:
    """The map of neighbouring stretches taken together."""
    return {s: t.row() for s in maps[0] if (t := fold(maps, s)) is not None}
