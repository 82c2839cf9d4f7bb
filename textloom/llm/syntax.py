"""Source files that do not parse: lexing with a pushdown stack.

Each language has one pattern for comments and literals. A pass over it blanks
the comments, reduces the literals to a placeholder and reports those that do
not end; what is left is walked with a stack of open delimiters. On top of that lie automata over the tokens:

* json, toml and xml: the whole grammar, with the stack holding what is open;
* python: the stack of indentations, the parts of compound statements, operators and operands taking turns;
* the other languages: what may stand at the top level and at the end of a file, and shapes of
  another language (a wrong extension).

For python, json, toml and xml the exact parser of the standard library has the last word: a fault that it does not see
is none, and one that only it sees has the reason ``grammar``. Nesting too deep for the parser is judged by the automaton alone.

Results per file: ``status`` is ``valid``, ``invalid``, ``unreadable`` (null
content) or ``no syntax`` (other extensions, md, txt); ``reason`` names what was found.
Empty content is valid where an empty file is: not in json, xml and go.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexers, text

_CLOSE = {")": "(", "]": "[", "}": "{"}
_DELIMITER = re.compile(r"[()\[\]{}]")
_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?\r?$|^={7}\r?$", re.MULTILINE)
#: Placeholder of a literal, a character that no name, operator or delimiter has.
_LITERAL = "\x01"


def _skipper(language: str, opens: str) -> re.Pattern:
    """Comments as group 1, literals as the second, what opens either without its end as the last."""
    comment, literals, _, _ = lexers._PARTS[language]
    return re.compile(rf"(?P<c>{comment})|(?P<s>{'|'.join(literals)})|(?P<x>{opens})", re.MULTILINE)


_SKIP = {
    "python": _skipper("python", r"[\"']"),
    "javascript": _skipper("javascript", r"[\"'`]|/\*"),
    "java": _skipper("java", r"[\"']|/\*"),
    "go": _skipper("go", r"[\"'`]|/\*"),
    "rust": _skipper("rust", r"[\"']|/\*"),
    "kotlin": _skipper("kotlin", r"[\"']|/\*"),
}
_SKIP["typescript"] = _SKIP["javascript"]


def _words(language: str, more: str = "", less: str = "") -> str:
    return "|".join(sorted((lexers.KEYWORDS[language] | set(more.split())) - set(less.split())))


def _adjacent(keywords: str, name: str = r"[^\W\d]\w*") -> str:
    """Two names on one line with only blanks between, neither a keyword."""
    return rf"(?<![\w$.#@\x01])(?!(?:{keywords})\b){name}[ \t]+(?!(?:{keywords})\b){name}"


_JS_WORDS = _words("javascript", "as of accessor enum implements interface package private protected public using target meta")
_TS_WORDS = _words("typescript", "of asserts infer out accessor unique require global override satisfies using")
_RUST_WORDS = _words("rust", "auto raw safe union default macro_rules try yield box", "bool char str f32 f64 i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize")
_KT_WORDS = _words("kotlin", "actual annotation by crossinline expect external field file get infix noinline param property reified set tailrec where value")

#: A condition without parentheses, and the heads of Python's statements.
_BARE_IF = r"(?<![.\w$])(?:if|while)[ \t]+[\w$\x01!]"
_PYTHON_HEAD = r"^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import\b|(?:async[ \t]+)?def[ \t]+\w+[ \t]*\([^\n]*:[ \t]*$|(?:if|for|with|while|elif|except)\b[^\n{]*:[ \t]*$)"

#: Shapes that no valid file of the language has, over its text without comments and with literals as placeholders.
FOREIGN = {
    "javascript": [
        _adjacent(_JS_WORDS, r"[^\W\d][\w$]*"),
        r"\b(?:var|let|const)\s+[\w$]+\s*:|^(?!\s*(?:import|export)\b)[^\n{}*]*[\w$)\]]\s+as\s+[\w$<]|\)\s*:\s*[\w$.<>\[\]| ]+\s*(?:\{|=>)(?<!\? )",
        _BARE_IF,
        r"\A\s*\{\s*\x01\s*:|:=|^\s*(?:import|from|def|class)\b[^\n;{(]*:[ \t]*$",
    ],
    "typescript": [_adjacent(_TS_WORDS, r"[^\W\d][\w$]*"), _BARE_IF, r"\A\s*\{\s*\x01\s*:|:="],
    "java": [
        _BARE_IF,
        _PYTHON_HEAD,
        r":=|\?:|\?\.(?!\d)|=>|\([ \t]*[\w$]+[ \t]*:(?!:)|\b(?:return|throw|import|package)\b[^;{}()]{0,400}(?:\}|\Z)|^[ \t]*(?:fun|func|def|fn|val|let)[ \t]+\w+[ \t]*[(:]",
        r"\b(?:import|package)\s+[\w.*]+\s*\n\s*(?:import|package|public|class|private|fun|func|abstract|final|@)\b",
        r"\A\s*[{\[<#]|\A\s*\x01",
    ],
    "go": [r"\A(?!\s*(?:package\s+\w+\s*(?:;|\n|\Z)))", r"^[ \t]*(?:import|package)\b[^\n;(]*[.;][^\n]*;[ \t]*$|^\s*(?:public|private|class|fn|def|fun)\s+\w"],
    "rust": [_adjacent(_RUST_WORDS), r":=|\A\s*[{\[<]|\A\s*\x01"],
    "kotlin": [
        _BARE_IF,
        _PYTHON_HEAD,
        rf"^[ \t]*(?!(?:{_KT_WORDS})\b)[\w.]+(?:<[\w<>, ?]*>)?[ \t]+(?!(?:{_KT_WORDS})\b)\w+[ \t]*=(?!=)",
        rf"\bfor[ \t]*\([ \t]*\w+[ \t]+(?!in\b)\w+[ \t]*:|:=|\bimport[ \t]+static\b|\bnew[ \t]+\w+[ \t]*[(<]|^[ \t]*(?:(?:public|private|protected)[ \t]+)+(?:static[ \t]+)?(?!(?:{_KT_WORDS})\b)[\w<>]+[ \t]+\w+[ \t]*\(",
        r"\A\s*[{\[<]|\A\s*\x01",
    ],
}
FOREIGN = {k: re.compile("|".join(f"(?:{p})" for p in v), re.MULTILINE) for k, v in FOREIGN.items()}


def fault(language: str, source: bytes) -> str | None:
    """Why ``source`` is not valid, None if nothing was found. Never raises."""
    if language == "json":
        return _json_fault(source)
    if language == "xml":
        return _xml_fault(source)
    try:
        body = source.decode("utf-8")
    except UnicodeDecodeError:
        return "not UTF-8"
    body = body.removeprefix("﻿")
    if language == "toml":
        return _toml_fault(body)
    return _code_fault(language, body)


class _Unterminated(Exception):
    pass


def _reduce(m: re.Match) -> str:
    """Comments as blanks, literals as the placeholder; ends the pass at the first that does not end."""
    if m.lastgroup == "c":
        return "\n" * m.group().count("\n") or " "
    if m.lastgroup == "x":
        raise _Unterminated("unterminated comment" if m.group() == "/*" else "unterminated literal")
    return _LITERAL


def _code_fault(language: str, body: str) -> str | None:
    try:
        bare = _SKIP[language].sub(_reduce, body)
    except _Unterminated as e:
        return str(e)
    if _MARKER.search(bare):
        return "conflict marker"
    stack: list[str] = []
    for d in _DELIMITER.findall(bare):
        if d in "([{":
            stack.append(d)
        elif not stack or stack.pop() != _CLOSE[d]:
            return "unbalanced delimiter"
    if stack:
        return "premature end"
    foreign = FOREIGN.get(language)
    if foreign and foreign.search(bare):
        return "not of this language"
    if language == "python":
        return _confirmed(_python_fault(bare), _python_parses(body))
    return _end_fault(language, bare)


def _confirmed(found: str | None, parses: bool | None) -> str | None:
    """The automaton's fault if the parser agrees, ``grammar`` for one that only the parser sees. ``parses``: None if it could not tell."""
    if parses is None:
        return found
    return None if parses else found or "grammar"


def _python_parses(body: str) -> bool | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(body, "", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (RecursionError, MemoryError):
        return None
    except SyntaxError as e:
        return None if "too many nested" in str(e.msg) or "too many levels" in str(e.msg) else False
    except ValueError:
        return False
    return True


_PY_WORDS = _words("python")
_PY_TOKEN = re.compile(r"\\\r?\n|\n|[()\[\]{}]")
_PY_HEAD = re.compile(r"(?:async[ \t]+)?(if|elif|else|for|while|try|except|finally|with|def|class)\b")
_PY_HEAD_SHAPE = {
    "def": re.compile(r"(?:async[ \t]+)?def[ \t]+[^\W\d]\w*[ \t]*[(\[]"),
    "class": re.compile(r"class[ \t]+[^\W\d]\w*[ \t]*[(\[:]"),
    "else": re.compile(r"else[ \t]*:"),
    "try": re.compile(r"try[ \t]*:"),
    "finally": re.compile(r"finally[ \t]*:"),
    "for": re.compile(r"(?:async[ \t]+)?for\b.*\bin\b", re.DOTALL),
}
#: The clauses that a clause may follow at its indentation.
_PY_AFTER = {
    "elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"), "finally": ("try", "except", "else"),
}
_NO_OPERAND = r"(?:and|or|not|in|is|if|elif|else|for|while|with|as|import|from|lambda|return|yield|raise|del|assert|global|nonlocal|class|def|async|await|except|try|finally|print|exec|match|case|type)"
#: Two operands without an operator between, and an operator without its right operand.
_PY_TURNS = re.compile(
    rf"(?<![\w\x01.])(?!(?:{_PY_WORDS}|match|case|type|_)\b)[\w\x01]+[ \t]+(?!(?:{_PY_WORDS})\b)[^\W\d]\w*|[\])}}][ \t]*(?!(?:{_PY_WORDS})\b)[\w]|"
    r"(?:[-+%&|^=<>@]|\b(?:and|or|not|is|lambda|import|as|in|del|assert|global|nonlocal)\b|(?<![\d.])\.)[ \t\n]*(?:[)\]}]|\Z)|\blambda\b[^:]*\Z"
)


def _python_fault(bare: str) -> str | None:
    """The automaton over logical lines: indentation, heads of compound statements and their clauses, operands and operators."""
    levels: list[tuple[int, int]] = [(0, 0)]
    clauses: list[str] = [""]
    needs_block = False
    for line in _logical_lines(bare):
        body = line.strip(" \t\f\r\n")
        if not body:
            continue
        indent = line[: len(line) - len(line.lstrip(" \t\f"))].rpartition("\f")[2]
        at = (len(indent.expandtabs(8)), len(indent.expandtabs(1)))
        if needs_block:
            if not (at[0] > levels[-1][0] and at[1] > levels[-1][1]):
                return "indentation"
            levels.append(at)
            clauses.append("")
        else:
            while len(levels) > 1 and at[0] < levels[-1][0]:
                levels.pop()
                clauses.pop()
            if at != levels[-1]:
                return "indentation"
        needs_block = False
        head = _PY_HEAD.match(body)
        if head:
            kind = head.group(1)
            shape = _PY_HEAD_SHAPE.get(kind)
            if shape and not shape.match(body):
                return "statement head"
            if kind in _PY_AFTER and clauses[-1] not in _PY_AFTER[kind]:
                return "clause without its statement"
            rest = _after_colon(body)
            if rest is None:
                return "statement head"
            needs_block = not rest
            clauses[-1] = kind
        else:
            clauses[-1] = ""
            if body[-1] == ":" and re.match(r"(?:match|case)\b", body):
                needs_block = True
        if _PY_TURNS.search(body.rstrip("\\ ;")):
            return "operands and operators"
    return "indentation" if needs_block else None


def _logical_lines(bare: str) -> Iterator[str]:
    """Lines as the stack of delimiters joins them."""
    start = depth = 0
    parts: list[str] = []
    for m in _PY_TOKEN.finditer(bare):
        t = m.group()
        if t[0] == "\\":
            parts.append(bare[start : m.start()])
            start = m.end()
        elif t == "\n":
            if not depth:
                yield "".join(parts) + bare[start : m.start()] if parts else bare[start : m.start()]
                parts, start = [], m.end()
        else:
            depth += 1 if t in "([{" else -1
    yield "".join(parts) + bare[start:]


def _after_colon(body: str) -> str | None:
    """What follows the colon that ends a statement's head, None without one. Those in delimiters and of lambdas are not it."""
    depth = lambdas = 0
    for m in re.finditer(r"[()\[\]{}]|\blambda\b|:=?", body):
        t = m.group()
        if t in ("(", "[", "{"):
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
        elif not depth:
            if t == "lambda":
                lambdas += 1
            elif t == ":":
                if not lambdas:
                    return body[m.end() :].strip()
                lambdas -= 1
    return None


_OPEN_OPERATOR = r"(?:[=*/%&|^<?:,.~(\[{]|(?<!\+)\+|(?<!-)-)"
#: How no file of the language ends, over its text without comments and trailing blanks.
_ENDS = {
    "rust": r"[^;}\]\s]\Z",
    "java": r"[^;}\s]\Z",
    "javascript": rf"{_OPEN_OPERATOR}\Z|\b(?:import|export|from|const|let|var|function|class|new|extends|typeof|case|throw|await|in|of|instanceof|if|else|for|while|do|switch|try|async|default)\Z|\bimport\s+[^;\x01()]*\Z|(?<![.\w$])function\b[^{{}}]*\Z|(?<![.\w$])class\s[^{{}}]*\Z|\bconst\s+[\w$]+\Z|\bif\s*\([^()]*\)\Z",
    "go": r"(?:[=*/%&|^<?:,.~(\[{!]|(?<!\+)\+|(?<!-)-)\Z|\b(?:func|import|package|var|const|type|return|go|defer|range|case|map|chan|struct|interface|if|for|switch|select)\Z|\bfunc\s+(?:\([^()]*\)\s*)?\w*\Z|\bimport\s+\w*\Z|^(?:type|var)\s+\w+\Z",
    "kotlin": r"(?:[=*/%&|^?:,.~(\[{]|(?<!\+)\+|(?<!-)-|(?<!\w)<)\Z|\b(?:import|package|fun|val|var|class|object|interface|typealias|private|public|internal|protected|override|data|sealed|abstract|open|suspend|inline|const|lateinit)\Z|^(?:\w+[ \t]+)*fun[ \t]+[\w.]*\Z|^typealias\s+\w+\Z",
}
_ENDS["typescript"] = _ENDS["javascript"].replace(r"(?<![.\w$])function\b[^{}]*\Z", r"(?<![.\w$])(?<!declare )function\b[^{};]*\Z")
_ENDS = {k: re.compile(v, re.MULTILINE) for k, v in _ENDS.items()}
#: What a declaration at the top level starts with.
_TOP = {
    "go": frozenset("package import func var const type".split()),
    "kotlin": frozenset("package import fun val var class object interface typealias private public internal protected override data sealed abstract open suspend inline const lateinit enum annotation external expect actual infix operator tailrec value inner companion final fun get set by where noinline crossinline vararg context".split()),
}
_LINE_START = re.compile(r"[()\[\]{}]|^[ \t]*([^\s()\[\]{}][^\s()\[\]{}.:=<,;]*)", re.MULTILINE)


def _end_fault(language: str, bare: str) -> str | None:
    """A premature end with all delimiters closed, and a line at the top level that starts no declaration."""
    held = bare.rstrip()
    ends = _ENDS.get(language)
    if held and ends and ends.search(held, max(0, held.rfind("\n", 0, max(0, len(held) - 400)))):
        return "premature end"
    top = _TOP.get(language)
    if top:
        depth = 0
        for m in _LINE_START.finditer(bare):
            word = m.group(1)
            if word is None:
                depth += 1 if m.group() in "([{" else -1
            elif not depth and word not in top and word[0] not in "@,.?:=+-*/&|<>!;" and not word.startswith(_LITERAL):
                before = bare[: m.start()].rstrip()[-1:]
                if before in ("", "}", ";") or before not in ",.=+-*/&|<>(:?" and word.isidentifier():
                    return "not a declaration"
    return None


_JSON_TOKEN = re.compile(r'[ \t\r\n]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w))|([{}\[\]:,])|(")|(<{7}|={7}|>{7})|(.)', re.DOTALL)


def _walk(lex: re.Pattern, body: str) -> str | None:
    """Stack walk for the data formats: group 1 delimiters, 2 open literals, 3 markers."""
    stack: list[str] = []
    for d, opened, marker in lex.findall(body):
        if opened:
            return "unterminated literal"
        if marker:
            return "conflict marker"
        if d in ("{", "["):
            stack.append(d)
        elif d and (not stack or stack.pop() != _CLOSE[d]):
            return "unbalanced delimiter"
    return "premature end" if stack else None


def _no_constant(name: str):
    raise ValueError(name)


def _json_fault(source: bytes) -> str | None:
    try:
        body = source.decode("utf-8")
    except UnicodeDecodeError:
        return "not UTF-8"
    found = _json_automaton(body)
    try:
        json.loads(body, parse_constant=_no_constant)
    except RecursionError:
        return found
    except ValueError:
        return found or "grammar"
    return None


def _json_automaton(body: str) -> str | None:
    """``stack``: what is open; ``wants``: v a value, e a value or the end of an array, k a key or the end of an object, K a key, : and , as they are, . nothing."""
    stack: list[str] = []
    wants = "v"
    for text_, scalar, mark, opened, marker, other in _JSON_TOKEN.findall(body):
        if text_:
            if wants in "kK":
                wants = ":"
            elif wants in "ve":
                wants = "," if stack else "."
            else:
                return "missing comma" if wants == "," else "grammar of json"
        elif scalar:
            if wants not in "ve":
                return "missing comma" if wants == "," else "grammar of json"
            wants = "," if stack else "."
        elif mark:
            if mark in "{[":
                if wants not in "ve":
                    return "missing comma" if wants == "," else "grammar of json"
                stack.append(mark)
                wants = "k" if mark == "{" else "e"
            elif mark in "}]":
                if not stack or stack[-1] != _CLOSE[mark]:
                    return "unbalanced delimiter"
                if wants not in (("k", ",") if mark == "}" else ("e", ",")):
                    return "trailing comma" if wants in "Kv" else "grammar of json"
                stack.pop()
                wants = "," if stack else "."
            elif mark == ":":
                if wants != ":":
                    return "grammar of json"
                wants = "v"
            else:
                if wants != "," or not stack:
                    return "grammar of json"
                wants = "K" if stack[-1] == "{" else "v"
        elif opened:
            return "unterminated literal"
        elif marker:
            return "conflict marker"
        elif other:
            return "not a token"
    return None if wants == "." else "premature end"


_TOML_LEX = re.compile(r"\#[^\n]*|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"+|'''(?:[^']|'(?!''))*'''+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|([{}\[\]])|([\"'])|(^(?:<{7}|={7}|>{7}))", re.MULTILINE)


def _toml_fault(body: str) -> str | None:
    found = _walk(_TOML_LEX, body) or _toml_automaton(body)
    try:
        tomllib.loads(body)
    except tomllib.TOMLDecodeError as e:
        # Names defined twice are not a matter of syntax.
        return None if re.match(r"Cannot (?:overwrite|declare|mutate|redefine)|Duplicate", str(e)) else found or "grammar"
    except RecursionError:
        return found
    except ValueError:
        return found or "grammar"
    return None


_TOML_STRING = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"+|'''(?:[^']|'(?!''))*'''+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'"
_TOML_TOKEN = re.compile(
    rf"(?P<blank>[ \t\r]+|\#[^\n]*)|(?P<line>\n)|(?P<string>{_TOML_STRING})|(?P<mark>[\[\]{{}}=,.])|(?P<bare>[+\-A-Za-z0-9_][+\-A-Za-z0-9_:.]*(?:(?<=\d\d\d\d-\d\d-\d\d) \d[\d:.+\-Z]*)?)|(?P<other>.)"
)
_TOML_VALUE = re.compile(r"true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?")
_TOML_KEY = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?")


def _toml_automaton(body: str) -> str | None:
    """``wants``: s a statement, h the key of a table, H its end, k a key, = its sign or a dot, v a value, , a comma or end inside something, n the end of the line."""
    stack: list[str] = []
    wants = "s"
    for m in _TOML_TOKEN.finditer(body):
        kind, t = m.lastgroup, m.group()
        if kind == "blank":
            continue
        if kind == "line":
            if stack and "{" not in stack[-1]:
                continue
            if wants not in "sn":
                return "premature end of line"
            wants = "s"
        elif kind in ("string", "bare"):
            if wants in ("s", "k", "K"):
                if kind == "bare" and not _TOML_KEY.fullmatch(t):
                    return "not a key"
                wants = "k" if t.endswith(".") else "="
            elif wants == "h":
                if kind == "bare" and not _TOML_KEY.fullmatch(t):
                    return "not a key"
                wants = "h" if t.endswith(".") else "H"
            elif wants == "v" or wants == "e":
                if kind == "bare" and not _TOML_VALUE.fullmatch(t):
                    return "not a value"
                wants = "," if stack else "n"
            else:
                return "missing sign"
        elif kind == "mark":
            if t == "[" and wants == "s":
                wants = "h"
            elif t == "[" and wants == "h" and body[m.start() - 1] == "[":
                continue
            elif t == "]" and wants == "H":
                wants = "n" if body[m.end() : m.end() + 1] != "]" else "H"
            elif t == "=" and wants == "=":
                wants = "v"
            elif t == "." and wants in "=H":
                wants = "k" if wants == "=" else "h"
            elif t in "[{" and wants in "ve":
                stack.append(t)
                wants = "e" if t == "[" else "K"
            elif t in "]}" and stack and stack[-1] == _CLOSE[t] and (wants == "," or wants == "e" and t == "]" or wants == "K"):
                stack.pop()
                wants = "," if stack else "n"
            elif t == "," and wants == "," and stack:
                wants = "e" if stack[-1] == "[" else "k"
            else:
                return "grammar of toml"
        else:
            return "not a token"
    return None if wants in "sn" and not stack else "premature end"


_XML_LEX = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<!DOCTYPE(?:[^\[>]|\[[\s\S]*?\])*>|<(/?)([^\s<>/!?]+)(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?(/?)>|(<)|(^(?:<{7}|>{7})[ \n])", re.MULTILINE)


_XML_NAME = r"[^\W\d][\w:.\-]*"
_XML_ATTRIBUTES = re.compile(rf"(?:\s+{_XML_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*")
_XML_BARE = re.compile(r"&(?!(?:\w[\w.\-]*|#\d+|#x[0-9A-Fa-f]+);)|\]\]>|[\x00-\x08\x0b\x0c\x0e-\x1f]")
_XML_TAG = re.compile(r"<!--(?:(?!--)[\s\S])*-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<!DOCTYPE(?:[^\[>]|\[[\s\S]*?\])*>|<(/?)([^\s<>/!?]+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?)(/?)>|(<{7}|>{7}|^={7}$)|(<)", re.MULTILINE)


def _xml_fault(source: bytes) -> str | None:
    found = _xml_automaton(source.decode("utf-8", "replace"))
    parser = expat.ParserCreate()
    try:
        parser.Parse(source, True)
    except expat.ExpatError as e:
        # Undeclared entities are names.
        return None if e.code == 11 else found or "grammar"
    return None


def _xml_automaton(body: str) -> str | None:
    """The stack holds the open elements; one root, text only inside it, attributes and references in their form."""
    stack: list[str] = []
    roots = at = 0
    body = body.removeprefix("\ufeff")
    for m in _XML_TAG.finditer(body):
        text_ = body[at : m.start()]
        at = m.end()
        if text_ and (not stack and not text_.isspace() or _XML_BARE.search(text_)):
            return "text outside" if not stack else "bare mark"
        closing, name, attributes, alone, marker, opened = m.groups()
        if marker:
            return "conflict marker"
        if opened:
            return "unterminated literal"
        if name is None:
            if m.group().startswith("<![CDATA[") and not stack or m.group().startswith("<?xml ") and m.start():
                return "text outside"
        elif closing:
            if not stack or stack.pop() != name:
                return "unbalanced delimiter"
        else:
            roots += not stack
            if roots > 1:
                return "two roots"
            names = re.findall(rf"({_XML_NAME})\s*=", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes))
            if not re.fullmatch(_XML_NAME, name) or not _XML_ATTRIBUTES.fullmatch(attributes) or len(set(names)) < len(names) or _XML_BARE.search(attributes):
                return "attributes"
            if not alone:
                stack.append(name)
    if stack:
        return "premature end"
    return None if roots and not body[at:].strip() else "text outside"


def check_files(files: DataFrame, file_id: str = "file_id", path: str = "rel_path", content: str = "content") -> DataFrame:
    """``file_id, language, status, reason``, one row per file however often it is repeated.

    A file of several differing rows is invalid if one of them is. Files are judged where
    they are read; only the small results are shuffled.
    """
    language = text.language(text.extension(F.col(path)))
    held = files.select(F.col(file_id).cast("bigint").alias("file_id"), language.alias("language"), F.col(content).cast("binary").alias("content"))
    judged = held.filter("language is not null and content is not null").mapInArrow(_judge, "file_id bigint, language string, status string, reason string")
    rest = held.filter("language is null or content is null").select(
        "file_id", "language", F.when(F.col("language").isNull(), "no syntax").otherwise("unreadable").alias("status"), F.lit(None).cast("string").alias("reason")
    )
    worst = F.max_by(F.struct("language", "status", "reason"), F.struct((F.col("status") == "invalid").alias("i"), (F.col("status") == "valid").alias("v"), "reason"))
    return judged.union(rest).groupBy("file_id").agg(worst.alias("w")).select("file_id", "w.language", "w.status", "w.reason")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, languages, contents = b.columns
        reasons = [fault(x, c) for x, c in zip(languages.to_pylist(), contents.to_pylist())]
        status = ["valid" if r is None else "invalid" for r in reasons]
        yield pa.RecordBatch.from_arrays([ids, languages, pa.array(status, pa.string()), pa.array(reasons, pa.string())], ["file_id", "language", "status", "reason"])


def invalid_rates(checked: DataFrame, docs: DataFrame) -> DataFrame:
    """``project, language, files, invalid, rate`` over the files with a syntax and content; files without a project come under null."""
    project = docs.filter("file_id is not null").groupBy("file_id").agg(F.max_by("project", "indexed_at").alias("project"))
    judged = checked.filter(F.col("status").isin("valid", "invalid")).join(project, "file_id", "left")
    bad = F.sum((F.col("status") == "invalid").cast("bigint"))
    return judged.groupBy("project", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
