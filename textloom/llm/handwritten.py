"""Generated, minified, vendored and data-only source files.

One pass over the contents takes each file's different names, its literal shares, and what
it states about itself. From the names a character 4-gram model per language is counted, with
conditional probabilities that back off to shorter contexts. Then each file is scored:

* minified: mangled names, whose cross-entropy per character under the language's model is far above the language's own;
* generated: names of low diversity, few templates with running numbers; or a tool's notice in the leading
  comments, a tool's file name or output folder, a lock file;
* vendored: names joined in a style foreign to the file's project and language; or a notice of origin, a folder for
  third-party code, the same body as a file so marked;
* data: nothing but number lists or long encoded literals.

``evidence`` says which of these spoke, so a caller can leave statements (``notice``, ``path``,
``lock``, ``copy``) out. A file may have several kinds. Null content, and md and txt files, have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize

_LANGUAGES = tuple(text.LANGUAGE_OF.values())
#: Bits of the hashed tables of grams of 2, 3 and 4 characters and of contexts of 2 and 3. The model has 10 x CELLS counts at any input size.
_BITS = {"g2": 13, "g3": 15, "g4": 16, "c2": 13, "c3": 15}
_START = {"g1": 0, "c1": 256}
for _k, _b in _BITS.items():
    _START[_k] = _START.get("_end", 512)
    _START["_end"] = _START[_k] + (1 << _b)
CELLS = _START.pop("_end")
#: What a longer context must outweigh: the pseudo-count given to the next shorter one.
BACKOFF = 4.0

_NAMES = re.compile(rb"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*")
_STRINGS = re.compile(rb"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_LEAD = re.compile(r"(?:\s|//[^\n]*|\#[^\n]*|/\*.*?\*/|<!--.*?-->|<\?.*?\?>|\"\"\".*?\"\"\"|--[^\n]*)*", re.DOTALL)

#: Notices by which tools mark their output. Each is a statement about this file, not a mention of generated code. Fixed values.
GENERATED_NOTICE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b(?! (?:files?|code|sources?|names?) (?:is|are))|"
    r"^\W*(?:this (?:file|code|class|module) (?:is|was|has been) |code |file )?(?:automatically |machine[- ]?)?generated (?:by|from|with|using|on|via)\b|"
    r"\bproduced automatically\b|\bautomatically (?:produced|generated|created|written)\b|\bmachine[- ]written\b|\bwritten out by\b|"
    r"^\W*this file is (?:the |an )?(?:output|product) of\b|^\W*(?:please )?(?:do not|don't) (?:edit|modify|change)\b|"
    r"\bfichier (?:a été )?généré\b|\bne pas modifier\b|\bnicht bearbeiten\b|\bautomatisch (?:von .{1,60})?(?:erzeugt|generiert|erstellt)\b|"
    r"автоматически (?:создан|сгенерирован)|сгенерирован(?:о|ный)? автоматически|自动生成|自動生成|automáticamente|"
    r"\b(?:manual changes|edits here) (?:will be|are) (?:lost|overwritten)\b|\bchange the template, not this file\b",
    re.IGNORECASE | re.MULTILINE,
)
#: Notices of origin. Fixed values.
VENDORED_NOTICE = re.compile(
    r"\bcopied (?:verbatim|unchanged) from\b|\bthird[- ]party (?:code|library|source|software)\b|^\W*vendored (?:from|copy of)\b|\bimported (?:snapshot|copy|from upstream)\b|"
    r"\bupstream (?:owns|maintains)\b|\bsend (?:fixes|patches|changes) upstream\b|\bno local changes\b|\bforked? (?:from|of) https?://",
    re.IGNORECASE | re.MULTILINE,
)
#: Names that tools give to their output. Fixed values.
TOOL_NAME = re.compile(
    r"(?:_pb2?(?:_grpc)?|_stubs|_bindings|_generated|\.generated|\.gen|_gen|\.g|\.pb|\.pb2|\.designer|[a-z0-9]GrpcStub|[a-z0-9]AutoBean|[a-z0-9]Stub|[._-]lock|\.min|[._-]min|\.bundle|\.packed)\.\w+$|(?:^|/)(?:zz_generated[_.]|package-lock\.|composer\.lock|cargo\.lock|yarn\.lock|poetry\.lock)[^/]*",
)
#: Folders that only hold tools' output, and folders of third-party code. Fixed values.
OUTPUT_FOLDER = re.compile(r"(?:^|/)(?:build/generated|src/generated|generated-sources|generated_src|gen/src|__generated__)/", re.IGNORECASE)
VENDOR_FOLDER = re.compile(r"(?:^|/)(?:vendor|vendored|node_modules|bower_components|third[_-]?party|3rd[_-]?party|external|externals|godeps|deps|site-packages)/", re.IGNORECASE)
#: Names that minifiers give. Fixed values.
_MINIFIED_NAME = re.compile(r"(?:\.min|[._-]min|\.bundle|\.packed)\.\w+$")
_DIGEST = re.compile(r"\"(?:sha\d+[-:])?[0-9a-f]{32,}\"|\"sha\d{3}-[\w+/=]{40,}\"")
_ENTRY = re.compile(r"\"v?\d+(?:\.\d+)+[\w.+-]*\"")
_RUNNING = re.compile(rb"\d+")

#: Decision bounds over the scores; all are parameters of ``kinds``. ``bits``: times the usual cross-entropy of the language. ``diversity``: templates
#: per name. ``names``: fewer tell nothing. ``numbers``, ``encoded``: shares of the file. ``style``: share of the foreign style,
#: ``style_bits``: what it takes to say that it is not its project's.
BOUNDS = {"bits": 2.5, "diversity": 0.6, "names": 20, "numbers": 0.45, "encoded": 0.45, "style": 0.9, "style_bits": 40.0}
#: Evidence that is a statement, not a statistic.
STATED = ("notice", "path", "lock", "copy")


def names_of(content: bytes) -> list[bytes]:
    """Identifiers outside of literals."""
    return _NAMES.findall(_STRINGS.sub(b" ", content))


def _grams(names: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """For each character of each name and its end mark the cells of its grams and contexts, and where each name starts."""
    c = np.frombuffer(b"\x02\x02\x02" + b"\x03\x02\x02\x02".join(names) + b"\x03", np.uint8).astype(np.uint32)
    at = np.flatnonzero(c != 2)
    c0, c1, c2, c3 = (c[at - i] for i in range(4))
    k2, k3 = c1 << 8 | c2, c1 << 16 | c2 << 8 | c3
    cell = lambda v, name: (v * np.uint32(0x9E3779B1) >> np.uint32(32 - _BITS[name])).astype(np.int64) + _START[name]
    mixed = k3 * np.uint32(0x85EBCA77) ^ k3 >> np.uint32(15)
    cells = {
        "g1": c0.astype(np.int64),
        "c1": c1.astype(np.int64) + _START["c1"],
        "g2": cell(c0 << 8 | c1, "g2"),
        "c2": cell(k2, "c2"),
        "g3": cell((c0 << 16 | k2) * np.uint32(0x85EBCA77), "g3"),
        "c3": cell(mixed, "c3"),
        "g4": cell(mixed + c0 * np.uint32(0xC2B2AE3D), "g4"),
    }
    return cells, np.concatenate([[0], np.flatnonzero(c0 == 3)[:-1] + 1])


def styles(names: list[bytes]) -> tuple[int, int]:
    """How many names are joined by underscores, and how many by capitals."""
    snake = sum(b"_" in n[1:] for n in names)
    return snake, sum(n.lower() != n != n.upper() and b"_" not in n for n in names)


@dataclass
class NameModel:
    """``counts``: languages x ``CELLS``."""

    counts: np.ndarray

    def bits(self, language: str, names: list[bytes]) -> np.ndarray:
        """Bits per character of each name, its end included."""
        t = self.counts[_LANGUAGES.index(language)]
        g, starts = _grams(names)
        p = (t[g["g1"]] + 0.5) / (t[:256].sum() + 128)
        for gram, context in (("g2", "c1"), ("g3", "c2"), ("g4", "c3")):
            p = (t[g[gram]] + BACKOFF * p) / (t[g[context]] + BACKOFF)
        b = -np.log2(np.minimum(p, 1))
        return np.add.reduceat(b, starts) / np.diff(np.append(starts, len(b)))


def name_model(found: DataFrame) -> NameModel:
    """The model of the names in ``features``: each name of at least 3 characters once per file.

    Shorter names say nothing about a language's words, and so mangled ones do not teach the model. Each
    task adds up one table and hands on its non-zero cells; the shuffle
    combines them, and the driver gets at most 10 x CELLS rows.
    """
    summed = found.select("language", "names").mapInArrow(_count_grams, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(_LANGUAGES), CELLS), np.float32)
    counts.ravel()[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float32)
    return NameModel(counts)


def _by_language(b: pa.RecordBatch) -> Iterator[tuple[str, list[list[bytes]], list[int]]]:
    by: dict[str, list[int]] = {}
    languages, blobs = b.column(0).to_pylist(), b.column(1).to_pylist()
    for i, language in enumerate(languages):
        by.setdefault(language, []).append(i)
    for language, rows in by.items():
        yield language, [blobs[i].split(b"\n") if blobs[i] else [] for i in rows], rows


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(_LANGUAGES), CELLS), np.int64)
    for b in batches:
        for language, files, _ in _by_language(b):
            names = [n for f in files for n in f if len(n) > 2]
            if names:
                cells = np.concatenate(list(_grams(names)[0].values()))
                total[_LANGUAGES.index(language)] += np.bincount(cells, minlength=CELLS)
    flat = total.ravel()
    cells = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "n"])


def file_features(path: str, language: str, content: bytes, bounds: dict = BOUNDS) -> dict:
    """What one file shows without the model: its different names, its shares, and the evidence in them."""
    size = len(content)
    code = language not in ("json", "toml", "xml")
    strings = _STRINGS.findall(content)
    bare = _STRINGS.sub(b" ", content)
    names = sorted(set(_NAMES.findall(bare)))
    found: list[str] = []
    diversity = len({_RUNNING.sub(b"0", n) for n in names}) / len(names) if names else 1.0
    if code and len(names) >= bounds["names"] and diversity < bounds["diversity"]:
        found.append("generated:diversity")
    blanks = sum(map(bare.count, (b" ", b"\n", b"\t", b"\r")))
    digits = sum(map(bare.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9", b",", b".", b"-")))
    numbers = digits / max(1, len(bare) - blanks) * (len(bare) / max(1, size))
    encoded = sum(len(s) for s in strings if len(s) > 60 and b" " not in s and b"\\" not in s) / max(1, size)
    if code and (numbers > bounds["numbers"] or encoded > bounds["encoded"]):
        found.append("data:literals")
    body = content.decode("utf-8", "replace")
    lead = _json_note(body) if language == "json" else _LEAD.match(body).group()
    if GENERATED_NOTICE.search(_statements(lead)):
        found.append("generated:notice")
    if language in ("json", "toml") and len(_DIGEST.findall(body)) >= 3 and len(_ENTRY.findall(body)) >= 3:
        found.append("generated:lock")
    minified = code and _MINIFIED_NAME.search(path)
    if OUTPUT_FOLDER.search(path) or TOOL_NAME.search(path) and not _MINIFIED_NAME.search(path):
        found.append("generated:path")
    if minified:
        found.append("minified:path")
    if VENDORED_NOTICE.search(lead):
        found.append("vendored:notice")
    if VENDOR_FOLDER.search(path):
        found.append("vendored:path")
    snake, camel = styles(names)
    return {"size": size, "names": names, "diversity": diversity, "snake": snake, "camel": camel, "numbers": numbers, "encoded": encoded, "evidence": found}


def _statements(lead: str) -> str:
    """The comments without their marks; quoted words are mentions, not statements."""
    return re.sub(r"'[^'\n]*'|\"[^\"\n]*\"", "", lead)


_NOTE = re.compile(r"\A\s*\{\s*\"(?:_+\w*|//|\$?comment|@\w+|generated\w*|note)\"\s*:\s*(\"(?:[^\"\\]|\\.)*\")", re.IGNORECASE)


def _json_note(body: str) -> str:
    m = _NOTE.match(body)
    return m.group(1).strip('"') if m else ""


_FEATURES = {
    "file_id": "bigint", "language": "string", "size": "bigint", "names": "binary", "n_names": "int", "diversity": "double", "snake": "int", "camel": "int",
    "numbers": "double", "encoded": "double", "evidence": "array<string>", "digest": "binary",
}


def features(files: DataFrame, file_id: str = "file_id", path: str = "rel_path", content: str = "content", bounds: dict = BOUNDS) -> DataFrame:
    """A row per row of ``files`` with a syntax and content, written to the shared folder: the only pass over the contents."""
    ext = text.language(text.extension(F.col(path)))
    held = files.select(F.col(file_id).cast("bigint").alias("file_id"), F.col(path).alias("path"), ext.alias("language"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            rows = []
            for fid, p, language, body in zip(*(c.to_pylist() for c in b.columns)):
                f = file_features(p, language, body, bounds)
                digest = blake2b(body, digest_size=16).digest() if len(body) > 200 else None
                rows.append((fid, language, f["size"], b"\n".join(f["names"]), len(f["names"]), *(f[k] for k in ("diversity", "snake", "camel", "numbers", "encoded", "evidence")), digest))
            columns = list(zip(*rows)) or [[]] * len(_FEATURES)
            types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(_FEATURES))

    some = held.filter("language is not null and content is not null")
    return materialize(some.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in _FEATURES.items())), "features")


def _scored(found: DataFrame, model: NameModel) -> DataFrame:
    """``bits``: the median over a file's names of their bits per character. The names themselves stay behind."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kept = [k for k in _FEATURES if k not in ("language", "names")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits: list[float | None] = [None] * b.num_rows
            for language, files, rows in _by_language(b):
                names = [n for f in files for n in f]
                if not names:
                    continue
                each, at = shared.value.bits(language, names), 0
                for i, f in zip(rows, files):
                    if f:
                        bits[i] = float(np.median(each[at : at + len(f)]))
                        at += len(f)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(bits, pa.float64())], ["language", *kept, "bits"])

    return found.select("language", "names", *kept).mapInArrow(run, ", ".join(["language string", *[f"{k} {_FEATURES[k]}" for k in kept], "bits double"]))


def kinds(files: DataFrame, docs: DataFrame | None = None, file_id: str = "file_id", path: str = "rel_path", content: str = "content", bounds: dict = BOUNDS) -> DataFrame:
    """``file_id, language, kinds, evidence`` and the scores, one row per file with a syntax and content; ``kinds`` may be empty.

    ``docs``: ``file_id, project, doc_length, indexed_at``; without it all files are one project. A file's style is
    weighed against the other files of its project and language, each counting with its terms' number (``doc_length``) at most, since
    an outlying file with few indexed terms is no measure of a project. Copies of a marked third-party file count as
    vendored wherever they lie: bodies are compared by a 128-bit digest, first combined per digest.
    """
    found = features(files, file_id, path, content, bounds)
    small = [k for k in _FEATURES if k not in ("file_id", "names")] + ["bits"]
    rows = _scored(found, name_model(found))
    one = rows.groupBy("file_id").agg(F.max_by(F.struct(*small), F.struct(F.size("evidence"), "size", "digest")).alias("f")).select("file_id", "f.*")
    if docs is None:
        one = one.withColumn("project", F.lit("")).withColumn("weight", F.col("n_names").cast("bigint"))
    else:
        valid = docs.filter("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct("project", "doc_length"), F.struct("indexed_at", "doc_length")).alias("d"))
        one = one.join(valid, "file_id", "left").withColumn("project", F.coalesce("d.project", F.lit(""))).withColumn("weight", F.coalesce("d.doc_length", F.col("n_names").cast("bigint"))).drop("d")
    one = materialize(one, "kinds")
    # The quarter of a language's files with the lowest cross-entropy stands for it, so mangled files do not shift it before they are three quarters. Ten rows.
    usual = one.groupBy("language").agg(F.percentile_approx("bits", 0.25, 10_000).alias("usual"))
    ratio = one.join(F.broadcast(usual), "language", "left").withColumn("ratio", F.col("bits") / F.greatest("usual", F.lit(0.1))).drop("usual")
    styled = _styled(ratio, bounds)
    code = ~F.col("language").isin("json", "toml", "xml")
    said = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    mangled = code & (F.col("n_names") >= bounds["names"]) & (F.col("ratio") > bounds["bits"])
    foreign = code & (F.col("diversity") >= bounds["diversity"]) & F.coalesce("foreign", F.lit(False))
    told = styled.withColumn("evidence", F.concat("evidence", said(mangled, "minified:entropy"), said(foreign, "vendored:style")))
    marks = one.filter("digest is not null and exists(evidence, e -> e like 'vendored:%')").select("digest").distinct().withColumn("copied", F.lit(True))
    # Rows without a digest stay out of the join, where they would all meet in one task.
    marked = told.filter("digest is not null").join(marks, "digest", "left").unionByName(told.filter("digest is null").withColumn("copied", F.lit(None).cast("boolean")))
    copied = F.coalesce("copied", F.lit(False)) & ~F.exists("evidence", lambda e: e.startswith("vendored:"))
    done = marked.withColumn("evidence", F.concat("evidence", said(copied, "vendored:copy")))
    return done.select("file_id", "language", F.array_distinct(F.transform("evidence", lambda e: F.substring_index(e, ":", 1))).alias("kinds"), "evidence", "bits", "ratio", "diversity", "numbers", "encoded", "style_bits")


def _styled(one: DataFrame, bounds: dict) -> DataFrame:
    """Adds ``foreign`` and ``style_bits``: by how many bits a file's joined names speak against the style of its project's other files.

    The profiles have one row per project and language, combined before the shuffle; they come back by a join
    of small rows. Projects with under 200 other joined names are weighed against their language.
    """
    joined = F.col("snake") + F.col("camel")
    scale = F.least(F.lit(1.0), F.col("weight") / F.greatest(joined, F.lit(1)))
    weighed = one.withColumn("_s", F.col("snake") * scale).withColumn("_c", F.col("camel") * scale)
    sums = [F.sum("_s").alias("ps"), F.sum("_c").alias("pc")]
    by_project = weighed.groupBy("project", "language").agg(*sums)
    by_language = weighed.groupBy("language").agg(F.sum("_s").alias("ls"), F.sum("_c").alias("lc"))
    held = weighed.join(by_project, ["project", "language"]).join(F.broadcast(by_language), "language")
    others = (F.col("ps") + F.col("pc") - F.col("_s") - F.col("_c")) >= 200
    snake, camel = (F.when(others, F.col(p)).otherwise(F.col(g)) - F.col(own) for p, g, own in (("ps", "ls", "_s"), ("pc", "lc", "_c")))
    expected = (snake + 1) / (snake + camel + 2)
    share = F.col("snake") / F.greatest(joined, F.lit(1))
    part = lambda p, q: F.when(p > 0, p * F.log2(p / q)).otherwise(0.0)
    bits = joined * (part(share, expected) + part(1 - share, 1 - expected))
    rare = F.when(expected < 0.5, share).otherwise(1 - share)
    return held.withColumn("style_bits", bits).withColumn("foreign", (joined >= bounds["names"]) & (rare >= bounds["style"]) & (bits >= bounds["style_bits"])).drop("_s", "_c", "ps", "pc", "ls", "lc", "project", "weight")


def stated_out(found: DataFrame) -> DataFrame:
    """``kinds`` by the statistics of names and literals alone."""
    kept = F.filter("evidence", lambda e: ~F.substring_index(e, ":", -1).isin(*STATED))
    return found.withColumn("evidence", kept).withColumn("kinds", F.array_distinct(F.transform("evidence", lambda e: F.substring_index(e, ":", 1))))
