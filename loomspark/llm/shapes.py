"""Local grammars over token classes.

Code without comments is turned into one letter per token.  A pair of brackets
is looked at as soon as it is closed, together with the letters just before it,
and then stands as one letter itself, so that what is left of a stretch is its
statements outside of balanced brackets and the brackets that it leaves open.
Reducing what is left of neighbours, put together, is the same as reducing both
at once.

Letters: ``i`` name, ``n`` number, ``s`` string, ``P B Y`` closed round, square
and curly brackets (``Q`` round ones that hold two names in a row, ``M`` those
of a macro), ``o`` operator between operands, ``p q`` one that may also stand
before an operand, ``u`` one that stands before, ``x`` one that stands on either
side, ``= , ; : ? . < >`` themselves, ``A`` ``=>``, ``R`` ``->``, ``G`` ``::``,
``E`` an ellipsis or range, ``N`` a line end where it may end a statement, and
``#`` what a rule should not judge.  Words with a part in a rule have a letter
of their own, other reserved words are ``w``, names of built-in types ``V``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from loomspark.llm import grammars as G

_TOKEN = re.compile(
    r"[A-Za-z_$\x80-\U0010ffff][\w$]*|\d(?:[\w.]|(?<=[eEpP])[+-](?=\d))*|\"|=>|->|::|\+\+|--|&&=?|\|\|=?|\?\?=?|\?\.|<<=?|>>?>?=(?!=)|[=!]==?|<=|&\^=?|[-+*/%&|^]=|:=|<-|\.\.\.?=?|##|[()\[\]{}]|\n|[^\s\w]"
)
_SAME = {c: c for c in "()[]{},;:?.<>="} | {'"': "s", "=>": "A", "->": "R", "::": "G", "++": "x", "--": "x", "...": "E", "..": "E", "..=": "E", "?.": ".", "!": "u", "~": "u", "+": "q", "-": "q", "*": "p", "&": "p"}
_ASSIGN = ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&^=", "<<=", ">>=", ">>>=", "&&=", "||=", "??=", ":=")
_BETWEEN = ("&^", "/", "%", "|", "^", "==", "!=", "===", "!==", "<=", "&&", "||", "??", "<<")
_WORDS = {"if": "f", "else": "e", "for": "F", "while": "W", "do": "d", "return": "r", "case": "c", "switch": "S", "try": "t", "catch": "k", "finally": "K", "break": "b", "continue": "b", "extends": "X", "func": "U", "const": "v", "let": "l", "var": "l", "impl": "m", "struct": "T", "union": "T", "class": "T", "enum": "J", "instanceof": "I", "throw": "r", "goto": "b"}
_LANGUAGE_WORDS = {"c": G._C, "cpp": G._CPP, "java": G._JAVA, "go": G._GO, "rust": G._RUST, "javascript": G._JS, "typescript": G._JS}
_CONTEXTUAL = set("record sealed permits non yield when module requires exports opens provides uses to with async get set from as of using static auto raw union safe box macro final override import".split())
_TYPES = {
    "c": "char double float int long short signed unsigned void bool".split(),
    "java": "boolean byte char double float int long short void".split(),
}
_TYPES["cpp"] = _TYPES["c"]


def _table(language: str) -> dict[str, str]:
    own = dict.fromkeys(_ASSIGN, "=") | dict.fromkeys(_BETWEEN, "o") | _SAME
    own |= {w: "w" for w in _LANGUAGE_WORDS[language]} | {w: "#" for w in _CONTEXTUAL if w in _LANGUAGE_WORDS[language]}
    own |= {w: "V" for w in _TYPES.get(language, ())}
    own |= {w: x for w, x in _WORDS.items() if w in _LANGUAGE_WORDS[language]}
    own |= {"true": "i", "false": "i", "null": "i", "nullptr": "i", "this": "i", "super": "i", "self": "i"}
    if language in ("java", "javascript", "typescript"):
        own |= {"*": "o"}
    if language in ("javascript", "typescript"):
        own |= {"\n": "N", "in": "O", "of": "O", "instanceof": "O", "let": "l", "*": "#"} | {w: "#" for w in G._TS if language == "typescript" and w not in ("boolean", "number", "string", "any", "unknown", "never", "undefined", "symbol", "object")}
    elif language == "go":
        own |= {"\n": "N", "<-": "#", "~": "#"}
    else:
        own["\n"] = ""
    if language in ("c", "cpp"):
        own |= {"##": "#", "#": "#", "class": "T"}
    if language == "rust":
        own |= {"|": "#", "||": "#", "_": "#", "!": "!", "@": "#", "<-": "o", "const": "w"}
    return own


class _Letters(dict):
    """Letters of tokens; a name, a number or an unknown sign is found out once."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        found = "n" if c.isdigit() else "i" if c.isalpha() or c in "_$" else "#"
        if len(self) < 200_000:
            self[token] = found
        return found


_LETTERS = {x: _Letters(_table(x)) for x in _LANGUAGE_WORDS}
_KEY = {x: re.compile(r"(?<=\.)[a-zA-Z#]") for x in _LETTERS}
# Go ends a statement at a line end behind these
_GO_ENDS = re.compile(r"(?<=[insbrxPBYQ)\]}])N")


def letters(language: str, code: str) -> str:
    """One letter per token of code without comments."""
    found = "".join(map(_LETTERS[language].__getitem__, _TOKEN.findall(code)))
    found = _KEY[language].sub("i", found)  # a member may be named like a reserved word
    if language == "go":
        return _GO_ENDS.sub(";", found).replace("N", "")
    if language in ("javascript", "typescript"):
        found = re.sub(r"N+", "N", found)
        return re.sub(r"(?<=[,{(\[:;Y}])N|N(?=[)\]},;:])", "", found) if "N" in found else found
    return found


_OPERAND = "insBx"
_END = r"(?=[;,)\]}])"
#: Rules on a closed pair of brackets with the letters before it; ``\A`` to the bracket is context.
_RULES = {
    "any": r"n[ins]|(?<![#wG.])in|o[;)\]]|(?<!\[)=[;)\],]|o,|\(,|(?<![=(,:\[{])=o|[opq]o(?!\))|\.[;)\]},]|q[;)\],}]|p;",
    "commas": r",,",
    "script commas": r"\([^()]*,,",
    "heads": r"[fFWS][insBY]",
    "semicolons": r"(?<![GE#])[nsx][rbFS]|[ns]V|=iV|=[^;,YVTI#wQM?Rr:<>(){}\[\]]*[iB]i(?!\()|(?<![^;{}Y])r[^;,YVTI#wQM?<>(){}\[\]]*[in]i|(?:\A|(?<=[;{Y]))(?:i\.)*iQ;",
    "for": r"F\((?![^()]*[:O])(?![^;]*;[^;]*;[^;]*\))|[Wf]\(\)",
    "else": r"\{e|(?<=[SFWtkKTd])[PQ]?Ye",
    "do": r"dY(?!N?W)",
    "case": r"c[^:;YRA]*[;}]",
    "question": r"\?[^:;,?<>(){}\[\]]*[;)\]](?<!<\?.)",
}


def _rules(*names: str, more: str = "") -> re.Pattern:
    return re.compile("|".join([*(_RULES[n] for n in names), *([more] if more else [])]))


_BAD = {
    "c": _rules("any", "commas", "heads", "semicolons", "for", "else", "do", "case", "question", more=r"(?:[PQde]|T[iP]*)\{[^{}]*;[^{}]*[insBxV]\}|[PQde]\{(?:r[^;{}]*|i=[^;,{}]*)\}|T[iP]*\{[^{};,]*[iB]\}|TiY[}VT]"),
    "cpp": _rules("any", "commas", "heads", "for", "else", "do", "case", more=r"(?<![GE#])[nsx][rbFS]|[Pde]\{[^{}]*;[^{}]*[insBx]\}|[Pde]\{(?:r[^;{}]*|i=[^;,{}]*)\}|Ti\{[^{}]*[insBx]\}|TiY[}VT]"),
    "java": _rules("any", "commas", "heads", "semicolons", "for", "else", "do", "case", more=r"s[ins]|is|(?:[PQde]|T[iX<>,.w]*)\{[^{}]*;[^{}]*[insBxV]\}|[PQde]\{[^{};Y,]*[insBxPQ]\}|T[iX<>,.w]*\{[^{}]*(?:=[^;{}]*|V)\}|tY(?!N?[kK])|V[PQ]|XY"),
    "go": _rules("any", "commas", more=r"s[in]|[{;]e|f[^;Y{}()\[\]]*r|F[^;Y{}]*;[^;Y{}]*Y|\{(?:[^{}]*;)?Ui|(?<![^;{}Y])r[^;,Y{}()\[\]wUTI#M]*[in]i|=[^;,YUwTI#QMV{}BPp<>(]*ii"),
    "rust": _rules("any", "commas", more=r"s[isn]|(?<![#wGm!])ii(?![!])|\{e|n[lr]|fi[<>]\{|A[,}]|mY|:=|(?<![<>])RY|li?;?[=;](?<=l=)"),
    "javascript": _rules("any", "script commas", "heads", "else", "do", "case", more=r"F\((?![^()]*O)(?![^;]*;[^;]*;[^;]*\))|[Wf]\(\)|[nB]i(?!\()(?<!Bi)|s[n]|tY(?!N?[kK])|[vl][YB](?![=:ON])|[vl][;,)]|:,|[(,]:|:\)|XY|\?[^:;,?(){}\[\]]*[;)\]]"),
    "typescript": _rules("any", "script commas", "heads", "else", "do", "case", more=r"F\((?![^()]*O)(?![^;]*;[^;]*;[^;]*\))|[Wf]\(\)|s[n]|tY(?!N?[kK])|[vl][YB](?![=:ON])|[vl][;,)]|[{,;(]i:[),]|:i[B]*i:|XY|=[;]|o="),
}
_CLOSED = {"(": "P", "[": "B", "{": "Y"}
_SHUT = {"(": ")", "[": "]", "{": "}"}
_PAIRS = re.compile(r"[()\[\]{}]")


@lru_cache(maxsize=1 << 16)
def _judged(language: str, before: str, sign: str, inner: str) -> tuple[bool, str]:
    """Whether a closed pair of brackets breaks a rule, and the letter that stands for it."""
    if language == "rust" and before[-1:] == "!" or before[-2:] == "!i" or language in ("c", "cpp") and before[-1:] == "#":
        return False, "M"
    found = _BAD[language].search(f"{before}{sign}{inner}{_SHUT[sign]}")
    # the rule must touch the pair itself; what stands before is judged with what holds it
    bad = bool(found) and found.end() > len(before)
    return bad, "Q" if sign == "(" and "ii" in inner else _CLOSED[sign]


def reduce(language: str, flat: str) -> tuple[str, bool]:
    """What is left of ``flat`` once closed brackets are letters, and whether one of them breaks a rule."""
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    at, bad = 0, False
    for m in _PAIRS.finditer(flat):
        c = m[0]
        parts.append(flat[at : m.start()])
        at = m.end()
        if c in "([{":
            stack.append((c, parts))
            parts = []
        elif not stack:
            parts.append(c)
        else:
            sign, outer = stack.pop()
            inner = "".join(parts)
            if any(b in inner for b in ")]}"):
                outer += [sign, inner, c]  # held open by what an earlier stretch began
            else:
                before = "".join(outer[-3:])[-6:]
                fault, letter = _judged(language, before, sign, inner)
                bad = bad or fault
                outer.append(letter)
            parts = outer
    parts.append(flat[at:])
    while stack:
        sign, outer = stack.pop()
        outer += [sign, *parts]
        parts = outer
    return "".join(parts), bad


def top(language: str, flat: str) -> bool:
    """Whether the statements of a file outside of brackets break a rule."""
    return bool(_BAD[language].search(flat if language == "go" else f"{{{flat}}}"))
