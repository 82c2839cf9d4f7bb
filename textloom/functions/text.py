"""Column expressions over text, paths and raw bytes; all JVM-side."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language. The indexed formats.
LANGUAGE_OF = {
    "rs": "rust",
    "go": "go",
    "java": "java",
    "kt": "kotlin",
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "toml": "toml",
    "xml": "xml",
    "json": "json",
}
#: Formats that are split into words instead. Fixed values.
WORD_EXTENSIONS = ("txt", "md")
#: Names left out of every walk. Fixed values.
DEFAULT_EXCLUDES = ("out", "build", "system", "config", "target", "node_modules", ".git")

_WORD_GAP = r"[^\p{IsAlphabetic}\p{N}_]+"
_JSON_STRING = r'"(?:[^"\\\n]|\\.)*"\s*:?'
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of alphabetic or numeric characters and underscores; null gives null."""
    return F.filter(F.split(text, _WORD_GAP), lambda w: w != "")


def json_keys(text: Column) -> Column:
    """Keys of all objects at every depth, escapes dropped, empty keys left out.

    Works on the token level, so a truncated document still yields the keys
    that were written before its end.
    """
    strings = F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(0))
    keyed = F.filter(strings, lambda s: s.endswith(":"))
    bare = F.transform(keyed, lambda s: F.regexp_replace(F.regexp_replace(s, r'^"|"\s*:$', ""), r"\\.", ""))
    return F.filter(bare, lambda s: s != "")


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part, '' without one.

    Only ASCII letters are folded. A leading dot starts a name, not an extension.
    """
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.translate(F.regexp_extract(name, r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1), _UPPER, _LOWER)


def language(ext: Column) -> Column:
    """Language of an extension; null for the word formats and unknown ones."""
    pairs = [F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


def is_indexed(ext: Column) -> Column:
    return ext.isin(*LANGUAGE_OF, *WORD_EXTENSIONS)


def is_excluded(path: Column, names=DEFAULT_EXCLUDES) -> Column:
    """True where a part of the path is an excluded name or matches an excluded glob.

    A pattern that starts with '!' means the same as without it.
    """
    names = [n.removeprefix("!").strip("/") for n in names]
    bare = [n for n in names if not any(c in n for c in "*?[/")]
    parts = F.split(path, "/")
    hit = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in bare])) if bare else F.lit(False)
    for g in (n for n in names if n not in bare):
        hit = hit | path.rlike(_glob_pattern(g))
    return hit


def _glob_pattern(glob: str) -> str:
    """An ignore-file glob as a pattern over a relative path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            if c == "[" and "]" in glob[i + 2 :]:
                end = glob.index("]", i + 2)
                body = glob[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
                continue
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c == "_" else "\\" + c)
            i += 1
    anchored = "/" in glob
    return ("^" if anchored else "(?:^|/)") + out + "(?:/|$)"


#: Bytes looked at to tell binary content, byte order marks of text, and beginnings of binary formats. Fixed values.
SNIFFED = 1024
BYTE_ORDER_MARKS = (b"\xef\xbb\xbf", b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff", b"\xff\xfe", b"\xfe\xff")
BINARY_MAGIC = (b"%PDF", b"\x89PNG")


def is_binary(content: Column) -> Column:
    """Without a byte order mark: a NUL among the first bytes, or the beginning of a binary format."""
    starts = lambda marks: reduce(or_, [F.startswith(content, F.lit(m)) for m in marks])
    zero = F.expr(f"position(X'00' in substring({_name(content)}, 1, {SNIFFED})) > 0")
    return ~starts(BYTE_ORDER_MARKS) & (zero | starts(BINARY_MAGIC))


def looks_binary(content: bytes) -> bool:
    """The twin of ``is_binary`` for single files."""
    return not content.startswith(BYTE_ORDER_MARKS) and (b"\0" in content[:SNIFFED] or content.startswith(BINARY_MAGIC))


def lossy_text(content: Column) -> Column:
    """Bytes to text; every bad sequence becomes U+FFFD."""
    return F.expr(f"make_valid_utf8(cast({_name(content)} as string))")


def _name(c: Column) -> str:
    return "`" + c._jc.toString().replace("`", "``") + "`"
