"""Tolerant lexers of the indexed languages.

One compiled pattern per language splits a source into tokens without a
grammar. A token is ``(kind, text, start)``; kinds are the one-letter names
below. Broken input never raises: what fits nothing comes out as ``BAD``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

COMMENT, STRING, NUMBER, NAME, OP, NEWLINE, BAD, MARKER = "CSNIOLBM"


def _nested_comment(depth: int = 4) -> str:
    """Block comments that may hold block comments, to ``depth`` levels."""
    body = r"(?:[^*/]|\*(?!/)|/(?!\*))"
    out = rf"/\*{body}*\*/"
    for _ in range(depth):
        out = rf"/\*(?:{body}|{out})*?\*/"
    return out


_LINE, _BLOCK = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_BQ = r"`[^`]*`"
_CHAR = r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|u\{[0-9a-fA-F_]+\}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|[0-7]{1,3}|[^\n]))'"
_NUMBER = r"0[xXbBoO][0-9a-fA-F_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?\w*"
_TEXT3 = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
_RAW3 = r'"""(?:[^"]|"(?!""))*"""+'
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};>] )|(?<=return ))/(?![/*\n ])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_NAME_PATTERN = r"[^\W\d]\w*"
_OPS = r"===|!==|>>>=|\*\*=|\.\.\.|\.\.=|<<=|>>=|=>|->|<-|:=|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\^=|&=|\|=|\?\.|\?:|\?\?|\*\*|//|!!|\.\.|[-+*/%=<>!&|^~?:;,.@(){}\[\]]"
_MARKER = r"^(?:<{7}|>{7}|\|{7})(?:[ \t][^\n]*)?$|^={7}[ \t]*\r?$"

#: Language -> (comments, literals, names, operators besides the common ones).
_PARTS = {
    "python": (r"\#[^\n]*", [r'(?i:[rbu]|[rb]r|br|f|t|rf|fr|rt|tr)?(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''" + rf"|{_DQ}|{_SQ})"], _NAME_PATTERN, r"\\\r?\n"),
    "javascript": (f"{_LINE}|{_BLOCK}", [_DQ, _SQ, _TEMPLATE, _REGEX], r"\#?(?:[^\W\d]|\$)[\w$]*", ""),
    "java": (f"{_LINE}|{_BLOCK}", [_TEXT3, _DQ, _CHAR], r"(?:[^\W\d]|\$)[\w$]*", ""),
    "go": (f"{_LINE}|{_BLOCK}", [_DQ, _BQ, _CHAR], _NAME_PATTERN, ""),
    "rust": (f"{_LINE}|{_nested_comment()}", [r'(?:b|c)?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)(?!\#)', r'(?:b|c)?"(?:[^"\\]|\\[\s\S])*"', rf"b?{_CHAR}", r"'[^\W\d]\w*(?!')"], r"(?:r\#)?[^\W\d]\w*", r"\#|\$"),
    "kotlin": (f"{_LINE}|{_nested_comment()}", [_RAW3, _DQ, _CHAR], rf"{_NAME_PATTERN}|{_BQ}", r"\#"),
    "toml": (r"\#[^\n]*", [_TEXT3, r"'''(?:[^']|'(?!''))*'''", r'"(?:[^"\\\n]|\\[^\n])*"', r"'[^'\n]*'"], r"[A-Za-z0-9_\-+:.]+", ""),
    "json": ("", [r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'], r"[A-Za-z_]\w*", ""),
}
_PARTS["typescript"] = _PARTS["javascript"]


def _compile(language: str) -> re.Pattern:
    comment, literals, name, more = _PARTS[language]
    kinds = [(MARKER, _MARKER), (COMMENT, comment), (STRING, "|".join(literals)), (NUMBER, r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])" if language == "json" else _NUMBER), (NAME, name), (NEWLINE, r"\n"), (OP, f"{more}|{_OPS}" if more else _OPS), (BAD, r"[^\s]")]
    if language == "toml":
        kinds = [k for k in kinds if k[0] != NUMBER]
    if language == "rust":
        kinds[3] = (NUMBER, r"0[xXbBoO][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*")
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds if p), re.MULTILINE)


PATTERNS = {language: _compile(language) for language in _PARTS}


def tokenize(language: str, text: str) -> Iterator[tuple[str, str, int]]:
    for m in PATTERNS[language].finditer(text):
        yield m.lastgroup if m.lastgroup != "hash" else STRING, m.group(), m.start()


#: Reserved words, by language. Fixed values of the languages.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while",
    "go": "break case chan const continue default defer else fallthrough false for func go goto if import interface iota map nil package range return select struct switch true type var",
    "rust": "as async await bool break char const continue crate dyn else enum extern f32 f64 false fn for i128 i16 i32 i64 i8 if impl in isize let loop match mod move mut pub ref return self static str struct super trait true type u128 u16 u32 u64 u8 unsafe use usize where while",
    "kotlin": "abstract as break catch class companion const constructor continue data do else enum false final finally for fun if import in init inline interface internal is it lateinit null object open operator out override package private protected public return sealed super suspend this throw true try typealias val var vararg when while",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " abstract any as boolean declare enum implements interface is keyof module namespace never number object private protected public readonly string symbol type unknown"
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

#: Keywords that are names wherever the grammar has no use for them as keywords. Fixed values of the languages.
_CONTEXTUAL = {
    "javascript": "async from get let of set static",
    "typescript": "async from get let of set static abstract as declare implements interface is keyof module namespace private protected public readonly type",
    "kotlin": "abstract catch companion constructor data enum final finally import init inline inner internal it lateinit open operator out override private protected public sealed suspend vararg",
}
_CONTEXTUAL = {k: frozenset(v.split()) for k, v in _CONTEXTUAL.items()}
#: Languages whose members may be named by any keyword, and the operators before a member.
_MEMBERS = {"javascript": (".", "?."), "typescript": (".", "?."), "kotlin": (".", "?.", "::")}
#: What follows a name but not a modifier.
_AFTER_NAME = frozenset(". ?. , ) ] } = == === != !== : ? ?: ; += -= *= /= + - * / < > <= >= && || ?? !! [ ++ --".split())
_OPENS_OBJECT = frozenset("= ( , : [ => ? ?? || && return default".split())


def _is_name(language: str, tok: str, before: list[str], after: str, new_line: bool) -> bool:
    """Whether a keyword is a name where it stands. ``before``: the two tokens before, the nearer one last."""
    members = _MEMBERS.get(language)
    if not members:
        return False
    last = before[1]
    if last in members:
        return not (language == "kotlin" and tok == "class" and last == "::")
    contextual = tok in _CONTEXTUAL[language]
    if language == "kotlin":
        return tok == "it" or contextual and after in _AFTER_NAME and last not in ("as", "is")
    # A key of an object, a field or a parameter.
    if after in (":", "?:") and (last in ("(", ",") or last == "{" and (before[0] in _OPENS_OBJECT or tok != "default") or tok != "default" and (last in (";", "}") or new_line)):
        return last != "case"
    if contextual and after == "(":
        return tok not in ("async", "as", "is") and last != "function"
    # A method or shorthand named by a reserved word, and other uses as a name.
    return contextual and (after in _AFTER_NAME or after in ("as", "in", "instanceof") and tok not in ("as", "is")) and last not in ("import", "export")


_HOLES = {"python": re.compile(r"\{([^{}]*)\}"), "javascript": re.compile(r"\$\{([^{}]*)\}"), "typescript": re.compile(r"\$\{([^{}]*)\}"), "kotlin": re.compile(r"\$\{([^{}]*)\}|\$([^\W\d]\w*)")}
_XML_SKIP = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>")
_XML_TAG = re.compile(r"<[/?]?([^\W\d][\w:.\-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|&([^\W\d#][\w.\-]*);")
_XML_ATTRIBUTE = re.compile(r"([^\W\d][\w:.\-]*)\s*=\s*(?:\"[^\"]*\"|'[^']*')")


def identifiers(language: str, text: str) -> Counter:
    """Name-like tokens with their counts; keywords and literals are left out.

    An approximation of a grammar's identifier nodes, see the README. JSON
    gives none here: its keys come from ``functions.text.json_keys``.
    """
    if language == "xml":
        return _xml_names(text)
    if language == "toml":
        return Counter(_toml_keys(text))
    out: Counter = Counter()
    keywords, holes = KEYWORDS.get(language, frozenset()), _HOLES.get(language)
    held = [(kind, tok) for kind, tok, _ in tokenize(language, text) if kind != COMMENT]
    before, new_line = ["", ""], True
    for at, (kind, tok) in enumerate(held):
        if kind == NEWLINE:
            new_line = True
            continue
        if kind == NAME and tok not in keywords:
            out[tok] += 1
        elif kind == NAME:
            after = next((t for k, t in held[at + 1 : at + 9] if k != NEWLINE), "")
            if _is_name(language, tok, before, after, new_line):
                out[tok] += 1
        elif kind == STRING and holes and (language != "python" or "f" in tok[: min(tok.find('"') % 99, tok.find("'") % 99)].lower()) and (language == "kotlin" or language == "python" or tok[0] == "`"):
            for hole in holes.finditer(tok):
                out += identifiers(language, next(filter(None, hole.groups()), ""))
        before, new_line = [before[1], tok], False
    return out


def _xml_names(text: str) -> Counter:
    out: Counter = Counter()
    for m in _XML_TAG.finditer(_XML_SKIP.sub(" ", text)):
        out[m.group(1) or m.group(3)] += 1
        out.update(_XML_ATTRIBUTE.findall(m.group(2) or ""))
    return out


def _toml_keys(text: str) -> Iterator[str]:
    """Bare and quoted keys of tables, pairs and inline tables; quotes stay part of a quoted key."""
    line, depth, header = [], [], False
    for kind, tok, _ in [*tokenize("toml", text), (NEWLINE, "\n", 0)]:
        if kind == COMMENT:
            continue
        if kind == NEWLINE and not depth or tok in ("{", ",") and depth[-1:] != ["["]:
            if tok == "{":
                depth.append("{")
            line, header = [], False
        elif tok == "[" and not line and not depth:
            header = True
        elif tok == "]" and header:
            yield from (x for t in line for x in (t.split(".") if t[0] not in "\"'" else [t]) if x)
            line, header = [], False
        elif tok in ("[", "{"):
            depth.append(tok)
        elif tok in ("]", "}"):
            depth[-1:] = []
            line = []
        elif tok == "=" and not header:
            yield from (x for t in line for x in (t.split(".") if t[0] not in "\"'" else [t]) if x)
            line = ["="]
        elif kind in (NAME, STRING) and line[:1] != ["="]:
            line.append(tok)
