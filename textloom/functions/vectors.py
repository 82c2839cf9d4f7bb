"""Vector functions: norms and pooling JVM-side, half floats through Arrow."""

from __future__ import annotations

import json
import math
import struct
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: Added to a norm before dividing. Fixed value.
NORM_FLOOR = 1e-32
#: Text given to the tokenizer: this many times the median token length. Fixed value.
MAX_TOKENS = 512


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + F.lit(NORM_FLOOR)


def normalized(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero, null stays null."""
    # The norm is bound once, as the one element of an array; inside the inner lambda it would be computed per component.
    return F.get(F.transform(F.array(l2_norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


@F.pandas_udf(BinaryType())
def to_f16(v: pd.Series) -> pd.Series:
    """Little-endian half floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").astype("<f2").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_f16(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype("f4"))


def mean_by(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Elementwise mean per key: ``key, pos, mean``; sums in double, combined before the shuffle."""
    return df.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def upper_median(values: list[int]) -> int:
    """Middle value, the upper one of an even count, at least 1."""
    return max(1, sorted(values)[len(values) // 2]) if values else 1


class TokenTable:
    """A static token-embedding table: mean of a text's token rows, unit length."""

    def __init__(self, table: np.ndarray, tokenizer, unknown: int | None, truncate: int):
        self.table, self.tokenizer, self.unknown, self.truncate = table.astype("f4"), tokenizer, unknown, truncate

    @classmethod
    def load(cls, folder: str) -> TokenTable:
        """Reads ``config.json``, ``tokenizer.json`` and ``model.safetensors``; raises ValueError on a wrong tensor."""
        from tokenizers import Tokenizer

        at = Path(folder)
        json.loads((at / "config.json").read_text())
        tokenizer = Tokenizer.from_file(str(at / "tokenizer.json"))
        raw = (at / "model.safetensors").read_bytes()
        (size,) = struct.unpack_from("<Q", raw)
        tensors = {k: v for k, v in json.loads(raw[8 : 8 + size]).items() if k != "__metadata__"}
        if len(tensors) != 1:
            raise ValueError("one tensor expected")
        (spec,) = tensors.values()
        if spec["dtype"] != "F16" or len(spec["shape"]) != 2:
            raise ValueError("a 2-D half-float tensor expected")
        begin, end = spec["data_offsets"]
        if end - begin != 2 * math.prod(spec["shape"]):
            raise ValueError("the tensor's length does not fit its shape")
        table = np.frombuffer(raw, "<f2", math.prod(spec["shape"]), 8 + size + begin).reshape(spec["shape"])
        vocab = tokenizer.get_vocab()
        return cls(table, tokenizer, vocab.get("[UNK]"), MAX_TOKENS * upper_median([len(t) for t in vocab]))

    def pool(self, ids) -> np.ndarray:
        """Unknown and out-of-range ids are left out; nothing left gives zeros."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.table))]
        if self.unknown is not None:
            ids = ids[ids != self.unknown]
        if not len(ids):
            return np.zeros(self.table.shape[1], "f4")
        mean = self.table[ids].astype("f8").mean(axis=0)
        return (mean / (math.sqrt(float(mean @ mean)) + NORM_FLOOR)).astype("f4")

    def embed(self, text: str) -> np.ndarray:
        return self.pool(self.tokenizer.encode((text or "")[: self.truncate], add_special_tokens=False).ids)


def embed_udf(spark, model: TokenTable):
    """A pandas UDF text -> vector. The table's size is fixed by the model, not by the data."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(shared.value.embed)

    return embed
