"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every executor, and the file used; both are parameters.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizing pattern of that vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Words at which a text counts half for its length in ``text_quality``.
HALF_LENGTH = 10
#: Longest run handed to the tokenizer at once; its time grows faster than the length of a run without a boundary.
PIECE = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of the whole text; strings that look like special tokens are ordinary text."""
    encode = _encoding(path).encode_ordinary
    total = at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            # Cut before a blank that follows a word, where the pattern has a boundary in any case.
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            while cut > at + 1 and text[cut - 1].isspace():
                cut -= 1
            end = cut if cut > at else end
        total += len(encode(text[at:end]))
        at = end
    return total


def text_quality(text: str) -> float:
    """From 0 to 1, the geometric mean of three: the share of letters and digits among the visible characters, the share of lines not
    seen before in the text, and a length that saturates, words / (words + HALF_LENGTH). 0 for a text without words."""
    runs = _LETTERS.findall(text)
    visible = len(text) - sum(map(text.count, " \n\t\r"))
    if not runs or visible <= 0:
        return 0.0
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return (sum(map(len, runs)) / visible * len(set(lines)) / len(lines) * len(runs) / (len(runs) + HALF_LENGTH)) ** (1 / 3)


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY, rated: bool = False) -> DataFrame:
    """``doc_id, tokens, quality`` and the columns of ``keep``: one row per document, without the text.

    ``quality``: that of ``text_quality`` if ``rated``, else 0. Null and empty texts have
    0 tokens and quality 0. Of repeated rows of a document the one with most tokens counts.
    """
    path = str(Path(folder) / vocabulary)
    held = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *[F.col(k).cast("string").alias(f"keep_{i}") for i, k in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, quality = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                tokens.append(count_tokens(t, path))
                quality.append(text_quality(t) if rated else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(quality, pa.float64()), *b.columns[2:]], ["doc_id", "tokens", "quality", *b.schema.names[2:]])

    kept = [f"keep_{i}" for i in range(len(keep))]
    counted = held.mapInArrow(run, ", ".join(["doc_id bigint, tokens bigint, quality double", *[f"{k} string" for k in kept]]))
    best = counted.groupBy("doc_id").agg(F.max_by(F.struct("tokens", "quality", *kept), F.struct("tokens", "quality", *[F.coalesce(k, F.lit("")) for k in kept])).alias("r"))
    return best.select("doc_id", "r.tokens", "r.quality", *[F.col(f"r.{k}").alias(name) for k, name in zip(kept, keep)])
