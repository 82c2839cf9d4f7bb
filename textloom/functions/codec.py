"""Byte formats of the exported index, as JVM expressions that yield hex text.

Hex keeps them usable inside higher-order functions; ``unhex`` gives the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits: offset basis and prime. Fixed values.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def varint_hex(v: Column) -> Column:
    """Unsigned LEB128 of a non-negative bigint, as upper-case hex."""
    v = v.cast("bigint")
    used = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i == 0) | (_shift(v, i) > 0))
    byte = lambda i: F.lpad(F.hex(_shift(v, i).bitwiseAND(F.lit(127)) + F.when(_shift(v, i + 1) > 0, 128).otherwise(0)), 2, "0")
    return F.array_join(F.transform(used, byte), "")


def varint_size(v: Column) -> Column:
    """Bytes of the unsigned LEB128 of a non-negative bigint."""
    v = v.cast("bigint")
    return F.lit(1) + sum(((v >= (1 << 7 * i)).cast("int") for i in range(1, 9)), F.lit(0))


def _shift(v: Column, groups: Column) -> Column:
    """``v`` without its lowest groups of seven bits."""
    return F.when(groups > 8, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", v, (groups * 7).cast("int")))


def text_hex(s: Column) -> Column:
    """Byte length as varint, then the UTF-8 bytes."""
    return F.concat(varint_hex(F.octet_length(s)), F.hex(F.encode(s, "utf-8")))


def fnv1a64_hex(s: Column) -> Column:
    """FNV-1a over the UTF-8 bytes as 16 lower-case hex digits.

    Two 32-bit halves, as the 64-bit product overflows a bigint, which ANSI
    mode refuses.
    """
    raw = F.hex(F.encode(s, "utf-8"))
    n = F.octet_length(s)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    byte = F.transform(at, lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    mask, low_prime = 0xFFFFFFFF, FNV_PRIME & 0xFFFFFFFF
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("bigint").alias("hi"), F.lit(FNV_BASIS & mask).cast("bigint").alias("lo"))

    def step(acc, b):
        lo = acc["lo"].bitwiseXOR(b)
        product = lo * low_prime
        hi = acc["hi"] * low_prime + F.shiftright(product, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(F.lit(mask)).alias("hi"), product.bitwiseAND(F.lit(mask)).alias("lo"))

    done = F.aggregate(byte, start, step)
    digits = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    return F.concat(digits(done["hi"]), digits(done["lo"]))


def postings_block_hex(postings: Column) -> Column:
    """Count, then per posting the id's distance to the one before and its tf.

    ``postings``: array of (file_id, tf), ascending by file_id.
    """
    one = lambda p, i: F.concat(varint_hex(p["file_id"] - F.when(i > 0, F.get(postings, i - 1)["file_id"]).otherwise(0)), varint_hex(p["tf"]))
    return F.concat(varint_hex(F.size(postings)), F.array_join(F.transform(postings, one), ""))


def forward_block_hex(terms: Column) -> Column:
    """Count, then every term with its tf. ``terms``: array of (term, tf), ascending; null counts as empty."""
    body = F.coalesce(F.array_join(F.transform(terms, lambda t: F.concat(text_hex(t["term"]), varint_hex(t["tf"]))), ""), F.lit(""))
    return F.concat(varint_hex(F.coalesce(F.size(terms), F.lit(0))), body)


def docs_entry_hex(path: Column, doc_length: Column) -> Column:
    return F.concat(text_hex(path), varint_hex(doc_length))


def encode_varint(v: int) -> bytes:
    """Driver-side twin of ``varint_hex``, for readers and tests."""
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out) + bytes([v])


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The value at ``at`` and the position after it."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at
