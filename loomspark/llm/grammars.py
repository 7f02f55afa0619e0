"""Local grammars of balanced statements, language by language.

They work on code without comments and with literals replaced by ``"``, bottom
up: pairs of brackets are reduced once what they hold has been looked at, until
only the statements of the file itself are left.  Python statements are parsed
by the running interpreter.
"""

from __future__ import annotations

import re
import warnings


class _Any:
    """Alternatives that are looked for one by one.

    Each begins with a sign or a word of its own, which a search can jump to;
    one that cannot comes with a wider test that does, and must hold first.
    """

    __slots__ = ("parts",)

    def __init__(self, *parts: str | tuple[str, str]):
        self.parts = [tuple(re.compile(x, re.M) for x in ((p,) if isinstance(p, str) else p)) for p in parts]

    def search(self, text: str) -> bool:
        return any(all(x.search(text) for x in p) for p in self.parts)


def _led(words: str, before: str, rest: str) -> list[str]:
    """Patterns of words that do not follow ``before``, one each."""
    return [rf"{w}(?<!{before}{w}){rest}" for w in words.split()]


_MARKS = ("<<<<<<<", "=======", ">>>>>>>", "|||||||", "@@")
_MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t\r]|$)|@@ ?-\d", re.M)
_ALIEN = _Any(r"[\x00-\x08\x0e-\x1f\x7f�‘-‟…–—]", "<%", "%>", r"\{%", r"%\}", r"\$\{", r"#\{")
_HOLE = re.compile(r"(?:^|(?<=[\s(.]))\{\{\s*[\w.]+\s*\}\}(?=[ \t]*[\w(.=:])", re.M)
_NUMBER = {
    "javascript": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)n?",
    "go": r"(?:0[xX][\da-fA-F_.pP+-]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)i?",
    "java": r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)[lLfFdD]?",
    "rust": r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:_*[iu](?:8|16|32|64|128|size)|_*f(?:32|64))?",
    "c": r"(?:0[xX][\da-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|\d[\d']*(?:\.[\d']*)?(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]|bf16|[fF]\d+)*(?:_\w+)?",
}
_NUMBER["typescript"], _NUMBER["cpp"] = _NUMBER["javascript"], _NUMBER["c"]
# a search can jump to a first digit; what may follow it is looked at behind it
_BEHIND_DIGIT = {k: re.sub(r"(?<![.\w])0(?=\[?[xXbBoO])", "(?<=0)", v).replace(r"|\d[\d", r"|[\d") for k, v in _NUMBER.items()}
_BAD_NUMBER = {k: re.compile(rf"\d(?<![\w$.]\d)(?!{v}(?![\w$]))") for k, v in _BEHIND_DIGIT.items()}

# Reserved and contextual words.
_JS = "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async of get set from as null true false using".split()
_TS = "abstract accessor any asserts bigint boolean declare enum global implements infer interface is keyof module namespace never number object out override private protected public readonly require satisfies string symbol type undefined unique unknown".split()
_JAVA = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits non yield when module requires exports opens provides uses to with null true false".split()
_GO = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_RUST = "as async await break const continue crate default dyn else enum extern fn for if impl in let loop macro match mod move mut pub ref return safe static struct super trait type union unsafe use where while yield box raw auto".split()
_C = "alignas alignof auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static static_assert struct switch typedef typeof union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local thread_local bool constexpr nullptr true false".split()
_CPP = _C + "and asm bitand bitor catch class co_await co_return co_yield compl concept const_cast consteval constinit decltype delete dynamic_cast explicit export final friend import module mutable namespace new noexcept not operator or override private protected public reinterpret_cast requires static_cast template this throw try typeid typename using virtual wchar_t xor char8_t char16_t char32_t".split()


def _not(words: list[str]) -> str:
    return r"(?!(?:" + "|".join(words) + r")\b)"


_W, _S = r"[A-Za-z_$][\w$]*", r"[ \t]+"
_BETWEEN = "in of instanceof as from extends".split()
_RUN = {
    # two words in a row of which neither joins expressions
    "javascript": re.compile(rf"(?<![\w$.#]){_not(_JS)}{_W}{_S}{_not(_BETWEEN)}[A-Za-z_$\"]"),
    "typescript": re.compile(rf"(?<![\w$.#]){_not(_JS + _TS)}{_W}{_S}{_not([*_BETWEEN, 'is', 'implements', 'satisfies', 'keyof', 'readonly'])}[A-Za-z_$\"]"),
    "rust": re.compile(rf"(?<![\w'#!.]){_not(_RUST)}[A-Za-z_]\w*{_S}{_not(_RUST)}[A-Za-z_\"]"),
    # three where a type and a name may follow each other
    "java": re.compile(rf"(?<![\w$.@]){_not(_JAVA)}{_W}{_S}{_not(_JAVA)}{_W}{_S}{_not(_JAVA)}{_W}"),
    "go": re.compile(rf"(?<![\w.]){_not(_GO)}[A-Za-z_]\w*{_S}{_not(_GO)}[A-Za-z_]\w*{_S}{_not(_GO)}[A-Za-z_]\w*"),
    "c": re.compile(rf"(?<![\w.]){_not(_C)}(?![A-Z_0-9]+\b)[A-Za-z_]\w*{_S}{_not(_C)}[A-Za-z_]\w*{_S}{_not(_C)}[A-Za-z_]\w*"),
    "cpp": re.compile(rf"(?<![\w.]){_not(_CPP)}(?![A-Z_0-9]+\b)[A-Za-z_]\w*{_S}{_not(_CPP)}[A-Za-z_]\w*{_S}{_not(_CPP)}[A-Za-z_]\w*"),
}
_SIGNS = {
    "javascript": _Any(
        ("#", r"(?<![.\w$])#(?![A-Za-z_$])|[)\]\"+>,=*/-][ \t]*#|\w#|(?<!static)(?<!async)(?<!get)(?<!set)(?<=\w)[ \t]+#|^[ \t]*#[\w-]+[^\n;={(]*$"),
        r"\\(?!u)", (r"<[!/?]", r"^[ \t]*<[!/?]"), r"</\w", (r"-[ \t]+\w+:", r"^[ \t]*-[ \t]+\w+:"), "@@",
    ),
    "go": re.compile(r"[#@$?\\`]"),
    "java": _Any(r"[#`\\]", "@@", r"<[/!]"),
    "rust": _Any(r"[`\\]", r"@(?<![\w\s(,&|]@)", "@@", r"<[/!]\w", r"#(?<!r#)(?![!\[]|\w)"),
    "c": _Any(r"[`@]", r"\\(?!\r?\n|u)", "</", r"#(?!#)(?=\S*\s*\{)"),
}
_SIGNS["typescript"], _SIGNS["cpp"] = _SIGNS["javascript"], _SIGNS["c"]

_KEY = r"(?![ \t]*[:,=}?;.)\]])"
_SHAPE = {
    "javascript": _Any(
        *_led("if while switch", r"[\w$.#]", rf"\b{_KEY}(?!\s*\()"),
        *_led("for", r"[\w$.#]", rf"\b{_KEY}(?!\s*(?:await\s*)?\()"),
        *_led("function", r"[\w$.#]", rf"\b(?!\s*\*?\s*(?:{_W}\s*(?:<[^(]*>\s*)?)?\()(?![ \t]*[:,=}}?;.)])"),
        *_led("class", r"[\w$.#]", rf"\b{_KEY}(?!\s*(?:{_W}\s*)?(?:<[^{{]*>\s*)?(?:extends\b[^{{]+|implements\b[^{{]+)?\{{)"),
        *_led("import", r"[\w$.#]", rf"\b(?!\s*(?:[(.\"{{*]|type\b|defer\b|source\b|{_W}))"),
        *_led("const let var", r"[\w$.#]", r"\s+[\[{(]?\s*[=;)\]]"),
        (r"\{\s*\"\s*:", r"(?:\A|(?<=[;}]))\s*\{\s*\"\s*:"),
        r"=>[ \t]*[;)\],]",
    ),
    "java": re.compile(r"(?<![\w$.])(?:if|while|switch|catch)\b(?!\s*\()|(?<![\w$.])(?:for)\b(?!\s*\()|(?<![\w$.])class\b(?!\s*[\w$;.)])"),
    "go": re.compile(r"(?<![\w.])func\b(?!\s*(?:\(|[A-Za-z_]\w*\s*[\[(]))"),
    "rust": re.compile(r"(?<![\w.#'])fn\b(?!\s*(?:\(|(?:r#)?[A-Za-z_]\w*\s*[<(]))|(?<![\w.#])let\b(?!\s*[\w(&\[{'\"_])|(?<![\w.#])match\s*\{\}"),
    "c": re.compile(r"(?<![\w.>])(?:if|while|switch)\b(?!\s*(?:\(|constexpr|consteval|!))|(?<![\w.>])for\b(?!\s*(?:\(|co_await))"),
}
_SHAPE["typescript"], _SHAPE["cpp"] = _SHAPE["javascript"], _SHAPE["c"]
_END = r"\s*[;)\]}]"
_PLUS = r"(?:(?<!\+)\+|(?<!-)-)"
_LOOSE = [rf"\+(?<!\+\+){_END}", rf"-(?<!--){_END}", rf"=>{_END}", rf"\.(?<![\d.]\.){_END}", r"[,&|=]\s*;", r"[(\[=]\s*[%^*]", r"=(?<![=!<>]=)\s+=", *(rf"{w}(?<![\w$.#]{w})(?<!as {w}){_END}" for w in "new typeof instanceof extends".split())]
_DANGLING = {
    "javascript": _Any(rf"[=%&|^<*!?]{_END}", *_LOOSE, *_led("const", r"[\w$.#]", rf"\s+{_W}\s*;")),
    "typescript": _Any(rf"[=%&|^<*]{_END}", *_LOOSE),
    "java": re.compile(rf"(?:[=%&|^<!~/]|(?<!\.)\*|{_PLUS}|->|(?<![\d.])\.){_END}|,\s*[)\]]|\?\s*[;)\]}}]|[(\[=]\s*[%^*/]"),
    "go": re.compile(rf"(?:[=%&|^<!*/]|{_PLUS}|(?<![\d.])\.){_END}|[(\[=]\s*[%/]"),
    "rust": re.compile(rf"\w\s*(?:[*+/%^-]|&&?){_END}|(?<![.\w$:)])=\s*;|\w\s*[-+*/%^&|<>=!]?=\s*;|\blet\b[^;{{}}=]*=\s*[)\]}}]"),
    "c": re.compile(rf"(?<!operator)(?:(?<!\[)=|[%|^<!~/?]|{_PLUS}|(?<![\d.])\.){_END}|\*\s*[;\]}}]|(?<!\[)&\s*[;}}]|,\s*;|[(=]\s*[%/]"),
}
_DANGLING["cpp"] = re.compile(_DANGLING["c"].pattern.replace(r"(?<!operator)", r"(?<!operator)(?<!operator[-+*/%^&|<>=!])"))
# lines that need a semicolon where a statement ends
_ASSIGN = r"^[ \t]*(?!(?:if|while|for|else|case|template|using|enum|return)\b)[A-Za-z_][\w.\[\]]*\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)[^;{}\n,]*[\w)\]\"]"
_TYPE_NAME = r"(?:[A-Za-z_][\w.<>?]*(?:\[\])*[ \t]+)?[A-Za-z_]"
_BEFORE = r"[ \t]*\n\s*(?:return|break|continue|throw|goto|if|for|while|switch)\b"
_OPEN_LINE = {
    "java": re.compile(rf"{_ASSIGN.replace('[A-Za-z_]', _TYPE_NAME, 1)}(?:{_BEFORE}|[ \t]*\n\s*\}})|(?<![\w$.@])(?:return|throw)\b[^;{{}}\n]*[\w)\]\"][ \t]*\n\s*\}}|^[ \t]*[a-z]\w*\.[\w.]+\([^;{{}}\n]*\)[ \t]*\n\s*(?:\}}|return\b)", re.M),
    "c": re.compile(rf"{_ASSIGN}{_BEFORE}|^[ \t]*(?!return\b)\w+[\s*]+\w+[ \t]*=(?!=)[^;{{}}\n,]*[\w)\]\"](?:{_BEFORE}|[ \t]*\n\s*\}})|(?<![\w.])return\b[^;{{}}\n]*[\w)\]\"][ \t]*\n\s*\}}", re.M),
    "rust": re.compile(rf"^[ \t]*let\b[^;{{}}\n=]*=(?!=)[^;{{}}\n,]*[\w)\]\"][ \t]*\n\s*(?:return|break|continue|let|for|while|\}})(?!\w)", re.M),
}
_OPEN_LINE["cpp"] = _OPEN_LINE["c"]
# what operators of the other languages that have nothing behind them cannot do without
_MAY_END = _Any(r"[-=%&|^<*!?+/~.,>]\s*[;)\]}]", r"[(\[=]\s*[%^*/]")
# a test wider than the patterns above
_MAY_DANGLE = {k: re.compile(r"[-=%&|^<*!?+/~.,>]\s*[;)\]}]|[(\[=,]\s*[%^*/]|=\s+=|\b(?:new|typeof|instanceof|extends)\s*[;)\]}]|\bconst\s+[\w$]+\s*;") for k in _DANGLING}
_MAY_DANGLE["javascript"] = _MAY_DANGLE["typescript"] = re.compile(rf"(?:[=%&|^<*!?]|{_PLUS}|=>|(?<![\d.])\.){_END}|,\s*;|[(\[=]\s*[%^*]|=\s+=|\b(?:new|typeof|instanceof|extends){_END}|\bconst\s+[\w$]+\s*;")
_MAY_OPEN = re.compile(r"[\w)\]\"][ \t]*\n\s*(?:\}|(?:return|break|continue|throw|goto|if|for|while|switch|let)\b)")

# What only typed scripts may hold.
_TYPED = _Any(
    *_led("const let var", r"[\w$.]", rf"\s+{_W}\s*[!?]?:\s*[\w\[({{\"]"),
    *_led("function", r"[\w$.]", rf"\b[^()]*\(\s*(?:\.\.\.)?{_W}\s*\??:"),
    *_led("function", r"[\w$.]", r"\b[^()]*\([^()]*\)\s*:\s*\w"),
    (r"\)\s*:\s*[\w\[<>| ,{}()\]]+\{\s*$", rf"^[ \t]*(?:(?:static|async|get|set)\s+)*{_W}\s*\([^()]*\)\s*:\s*[\w\[<>| ,{{}}()\]]+\{{\s*$"),
    (rf"\(\s*{_W}\s*\??:\s*[\w{{\[]", rf"^[ \t]*(?:(?:static|async)\s+)*{_W}\s*\(\s*{_W}\s*\??:\s*[\w{{\[][^()]*\)[^;]*\{{"),
    rf"=\s*(?:async\s*)?\(\s*{_W}\s*\??:\s*[\w{{\[\"(][^()]*\)\s*(?::[^=]*)?=>",
    r"=\s*(?:async\s*)?\([^()]*\)\s*:\s*[\w<>\[\]| ,{}]+=>",
    *_led("as", r"\w", r"\s+(?:unknown|any|const|string|number|boolean|[A-Z]\w*[<\[])"),
    r"!(?<=[\w$)\]]!)[.)\];,]",
    (r"\[\]\s*>", r"[A-Za-z_$][\w$]*\[\]\s*>"),
    r"<(?:string|number|boolean|any|unknown|void)\s*[,>\[]",
)
_OTHER_C = re.compile(r"(?<![\w.>])(?:namespace\s+\w+\s*\{|class\s+\w+\s*[:{;]|template\s*<|using\s+\w+|public\s*:|private\s*:|protected\s*:|virtual\s|constexpr\s+auto\b|new\s+[A-Za-z_])|\w::~?\w|\[[&=]?\]\s*\(|\boperator\s*[^\w\s]|\bfor\s*\([^();]*[^:();?]:[^:();]*\)|static_cast\s*<|(?<![\w.])auto\s*&|[A-Za-z_]\w*\s*<\s*[A-Za-z_]\w*\s*>\s+\w|(?<![&|\w)\]\"'])\s&\s*\w+\s*=(?!)")

_CLOSE_ALL = [(re.compile(r"\([^()\[\]{}]*\)"), "\x01"), (re.compile(r"\[[^()\[\]{}]*\]"), "\x02"), (re.compile(r"\{[^()\[\]{}]*\}"), "\x03")]


def reduced(code: str) -> str:
    """``code`` with every outer pair of brackets empty."""
    while True:
        n = len(code)
        code = code.replace("()", "\x01").replace("[]", "\x02").replace("{}", "\x03")
        for pattern, sign in _CLOSE_ALL:
            code = pattern.sub(sign, code)
        if len(code) == n and not any(b in code for b in "()[]{}"):
            return code.replace("\x01", "()").replace("\x02", "[]").replace("\x03", "{}")
        if len(code) == n:
            return code.replace("\x01", "()").replace("\x02", "[]").replace("\x03", "{}")


_ANN = r"@[\w.]+(?:\s*\(\))?"
_VIS = r"(?:pub(?:\s*\(\))?\s+)?"
_ITEMS = {
    "java": re.compile(
        rf"\s*(?:;|(?:{_ANN}\s*)*package\s+[\w.]+\s*;|import\s+(?:static\s+|module\s+)?[\w.$]+(?:\.\*)?\s*;|(?:open\s+)?module\s+[\w.]+\s*\{{\}}"
        rf"|(?:{_ANN}\s*|(?:public|private|protected|static|abstract|final|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+[\w$]+[^;{{}}=]*\{{\}})\s*"
    ),
    "go": re.compile(
        r"\s*(?:;|import\b[ \t]*(?:\(\)|(?:[\w.]+[ \t]+)?\")|func\b[ \t]*(?:\(\)[ \t]*)?\w+[ \t]*(?:\[\][ \t]*)?\(\)(?:[ \t]*[\w.*\[\]<()-]+|[ \t]*(?:interface|struct)[ \t]*\{\}|[ \t]*<?-?chan\b)*[ \t]*(?:\{\})?"
        r"|(?:type|var|const)\b[ \t]*(?:\(\)|[A-Za-z_](?:[^\n;]*(?:[-+*/%&|^<>=!,.(]|&&)[ \t]*\n)*[^\n;]*))[ \t]*(?=[;\n\r]|\Z)"
    ),
    "rust": re.compile(
        rf"\s*(?:;|#!\s*\[\]|(?:#\s*\[\]\s*)*(?:{_VIS}(?:use\s+[^;]+;|extern\s+crate\s+[^;]+;|mod\s+\w+\s*(?:;|\{{\}})|(?:unsafe\s+)?extern\s*\"?\s*\{{\}}"
        rf"|(?:(?:const|async|unsafe|safe|extern|default)\s+|\"\s*)*fn\s+(?:r#)?\w+\s*[^;{{}}]*(?:\{{\}}|;)|(?:struct|union)\s+\w+[^;{{}}]*(?:\{{\}}|;)|enum\s+\w+[^;{{}}]*\{{\}}|(?:unsafe\s+|auto\s+)*trait\s+\w+[^;{{}}]*\{{\}}"
        rf"|(?:unsafe\s+|default\s+)*impl\b[^;{{}}]*\{{\}}|type\s+\w+[^;]*;|static\s+(?:mut\s+)?\w+\s*:[^;]+;|const\s+\w+\s*:[^;]+;|macro\s+\w+\s*(?:\(\)\s*)?\{{\}})|[\w:]+!\s*\w*\s*(?:\(\)\s*;|\[\]\s*;|\{{\}}\s*;?)))\s*"
    ),
}
_C_ITEM = re.compile(r"([^;{}]*)(;|\{\})")
_C_BEGIN = re.compile(r"\s*(?:import|export|package|use|func|fn|def|let|var|function|pub|impl|interface|const\s+\w+\s*=|static\s+\w+\s*=)(?=[\s=]|$)")
_C_CALL = re.compile(r"[\w>)\]]\s*\(\)\s*")
_C_LEAD = re.compile(r"[\w:<>,*&~\s\"\[\].()+/|=!-]*")
_C_TAIL = re.compile(
    r"(?:(?:const|volatile|override|final|mutable|try)\b\s*|noexcept\b(?:\s*\(\))?\s*|&{1,2}\s*|->\s*[\w:<>,*&\s]+|[A-Z_][A-Z0-9_]*\b(?:\s*\(\))?\s*|__\w+(?:\s*\(\))?\s*|\[\]\s*|requires\b[^{};]*|:[^;]*)*+"
)
_C_TYPE = re.compile(r"(?:\[\]|\w++(?:\s*\(\))?|template\s*<[^;{}]*>|\"|[<>,:*&\s])*?\b(?:struct|union|enum|class|namespace|extern|concept)\b[^;()=]*(?:\(\)[^;()=]*)*")


def _c_function(head: str) -> bool:
    """Whether a declaration head ends as that of a function with a body."""
    return any(_C_TAIL.fullmatch(head, m.end()) and _C_LEAD.fullmatch(head, 0, m.end()) for m in _C_CALL.finditer(head))


_C_OPERATOR = re.compile(r"\boperator\s*(?:\(\)|\[\]|[^\w\s();{}]{1,3})(?=\s*\(\))")
_C_INITIAL = re.compile(r"([:,]\s*[\w:<>]+\s*)\{\}(?=\s*(?:,|\{\}))")


def _c_items(flat: str, cpp: bool) -> str | None:
    at = 0
    if cpp:
        flat = _C_INITIAL.sub(r"\1()", _C_OPERATOR.sub("operator_", flat))
    while at < len(flat):
        m = _C_ITEM.match(flat, at)
        if not m:
            return None if not flat[at:].strip() else "unfinished declaration"
        head, sign = m[1], m[2]
        at = m.end()
        if not head.strip():
            if sign == "{}":
                return "block without declaration"
            continue
        if _C_BEGIN.match(head) and not (cpp and re.match(r"\s*(?:export|import)\b", head)):
            return "no declaration"
        if not re.match(r"[\s\[(~:\"]*[A-Za-z_:~\[(]", head):
            return "no declaration"
        if sign == "{}":
            if _C_TYPE.fullmatch(head) or "=" in head:
                continue
            if cpp and re.search(r":\s*[\w:<>]+\s*\Z|,\s*[\w:<>]+\s*\Z", head):
                continue
            if not _c_function(head) or (not cpp and not re.search(r"\w[\s*]+\w+\s*\(\)|\)\s*\(\)", head)):
                return "block without declaration"
    return None


def _script(language: str, flat: str) -> str | None:
    end = flat.rstrip()
    if re.search(r"(?:[=.,:?&|^%(\[*/<]|(?<!\+)\+|(?<!-)-|=>|\b(?:import|export|const|let|var|function|class|extends|from|new|typeof|async|default|if|else|for|while|do|try|switch|catch|case|in|of|type|interface|enum))\Z", end):
        return "unfinished statement"
    if re.search(rf"(?<![\w$.])(?:function\b\s*\*?\s*(?:{_W})?\s*(?:<[^()]*>)?\s*\(\)\s*(?::[^{{}};=]*)?|(?:class|interface|enum|namespace)\s+{_W}[^{{}};()=]*)\s*\Z", flat) and not re.search(r"\bdeclare\b", flat):
        return "declaration without body"
    if re.search(rf"(?<![\w$.])try\s*\{{\}}(?!\s*(?:catch|finally)\b)|(?<![\w$.])function\s+{_W}\s*\(\)\s*(?=(?:export|function|class|const)\b)" if language == "javascript" else r"(?!)", flat):
        return "unfinished statement"
    if re.search(r"\bimport\s*(?:\{\}|\*\s*as\s+\w+|\w+)\s*(?:;|\Z|(?=import))", flat):
        return "import without source"
    return None


def patterns(language: str, code: str) -> str | None:
    """What is wrong with the lines of a stretch of code, or null."""
    if any(x in code for x in _MARKS) and (m := _MARKER.search(code)):
        return "conflict or patch marker" if m[0][0] != "@" else "patch marker"
    if _ALIEN.search(code) or "{{" in code and _HOLE.search(code):
        return "alien sign"
    if language == "java" and "@" in code:
        plain = re.sub(_ANN, " ", re.sub(r"([=,({]\s*)@[\w.]+(?=\s*[,)}])", r"\1x", code))
    else:
        plain = code
    if _SIGNS[language].search(plain):
        return "alien sign"
    if not code.isascii() and re.search(r"[^\x00-\x7f\w\s]" if language in ("javascript", "typescript") else r"[^\x00-\x7f\w]", code.lstrip("﻿")):
        return "alien sign"
    if _BAD_NUMBER[language].search(plain):
        return "malformed number"
    if _RUN[language].search(plain if language != "rust" else re.sub(r"\w+!\s*(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\})", " ", plain)):
        return "words in a row"
    if _SHAPE[language].search(plain):
        return "malformed statement"
    quick = language in ("javascript", "typescript") or _MAY_END.search(plain)
    if quick and _DANGLING[language].search(plain) and _MAY_DANGLE[language].search(plain):
        return "operator without operand"
    if language in _OPEN_LINE and _MAY_OPEN.search(plain) and _OPEN_LINE[language].search(plain):
        return "missing semicolon"
    if language == "javascript" and _TYPED.search(code):
        return "types in an untyped language"
    if language == "c" and _OTHER_C.search(code):
        return "construct of another language"
    return None


def outline(language: str, flat: str) -> str | None:
    """What is wrong with the statements of a file, whose brackets are all empty, or null."""
    if language in ("javascript", "typescript"):
        return _script(language, flat)
    if language in ("c", "cpp"):
        return _c_items(flat, language == "cpp")
    at = 0
    if language == "go":
        m = re.match(r"\s*package[ \t]+[A-Za-z_]\w*[ \t]*(?=[;\r\n]|\Z)", flat)
        if not m:
            return "no package clause"
        at = m.end()
    item = _ITEMS[language]
    while at < len(flat):
        m = item.match(flat, at)
        if not m or m.end() == at:
            return None if not flat[at:].strip() else "no declaration"
        at = m.end()
    return None


def python(text: str) -> str | None:
    """What the interpreter says of a module, or null."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text.removeprefix("﻿"), "module", "exec", dont_inherit=True)
        except SyntaxError as fault:
            return f"{type(fault).__name__}: {fault.msg}"
        except (ValueError, RecursionError, MemoryError, OverflowError) as fault:
            return f"{type(fault).__name__}"
    return None
