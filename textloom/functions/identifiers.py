"""Identifier extraction from source files, as one Arrow-batched pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexers, text


def code_identifiers(files: DataFrame, file_id: str = "file_id", path: str = "rel_path", content: str = "content", key: str = "bigint") -> DataFrame:
    """``file_id, term, tf`` for the files of the nine grammar languages.

    Null content and other extensions give no rows. Bytes that are not UTF-8
    become U+FFFD, which ends a name. ``key``: the type of the ids.
    """
    chosen = files.select(F.col(file_id).cast(key).alias("file_id"), text.language(text.extension(F.col(path))).alias("language"), F.col(content).alias("content"))
    chosen = chosen.filter("language is not null and language <> 'json' and content is not null")
    return chosen.mapInArrow(_extract, f"file_id {key}, term string, tf bigint")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, counts = [], [], []
        for fid, language, content in zip(*(c.to_pylist() for c in batch.columns)):
            found = lexers.identifiers(language, content.decode("utf-8", "replace"))
            ids += [fid] * len(found)
            names += found
            counts += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file_id", "term", "tf"])
