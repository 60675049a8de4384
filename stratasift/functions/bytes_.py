"""Expressions over binary columns: hashes, entropy, integers, textual tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content of more bytes than this is hashed by its first PART bytes and its size.
WHOLE, PART = 64 << 20, 16 << 20


def content_hash(content: Column, whole: int = WHOLE, part: int = PART) -> Column:
    """SHA-256 of the content; of large content, of its head, with the size appended. Null content has no hash."""
    size = F.octet_length(content)
    return F.when(size <= whole, F.sha2(content, 256)).otherwise(F.concat_ws(":", F.sha2(F.substring(content, 1, part), 256), size.cast("string")))


def quick_key(size: Column, mtime: Column) -> Column:
    """`size:seconds`, a cheap key of a file's state."""
    return F.concat_ws(":", size.cast("string"), F.floor(mtime).cast("long").cast("string"))


def unsigned(content: Column, at: int, size: int, big: bool = False) -> Column:
    """The unsigned integer of up to 7 bytes at a 0-based offset; null where the content ends before."""
    piece = F.substring(content, at + 1, size)
    digits = F.hex(piece) if big else F.array_join(F.reverse(F.regexp_extract_all(F.hex(piece), F.lit("(..)"))), "")
    return F.when(F.octet_length(piece) == size, F.conv(digits, 16, 10).cast("long"))


def _entropies(content: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> float:
        if not b:
            return 0.0
        n = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        p = n[n > 0] / len(b)
        return float(-(p * np.log2(p)).sum())

    return content.map(one).astype(float)


def entropy(content: Column) -> Column:
    """Shannon entropy in bits a byte, 0 to 8; 0 for empty or null content. An Arrow UDF: SQL would explode every byte."""
    return F.pandas_udf(_entropies, "double")(content)


def printable_share(content: Column) -> Column:
    """Share of bytes that are printable ASCII or tab, line feed or carriage return; multi-byte characters count as not."""
    size = F.octet_length(content)
    text = F.decode(content, "ISO-8859-1")
    kept = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", ""))
    return F.when(size > 0, kept / size).otherwise(F.lit(0.0))


def looks_textual(content: Column, window: int = 2048) -> Column:
    """Not empty, no NUL among the first bytes, and more than 92 % of them printable."""
    head = F.substring(content, 1, window)
    return F.coalesce((F.octet_length(head) > 0) & ~F.decode(head, "ISO-8859-1").contains("\x00") & (printable_share(head) > 0.92), F.lit(False))


def compression_kind(content: Column) -> Column:
    """Name of the compression that the first bytes announce, or null."""
    hexed = F.hex(F.substring(content, 1, 6))
    return (
        F.when(hexed.rlike("^(7801|785E|789C|78DA)"), "zlib").when(hexed.startswith("1F8B"), "gzip").when(hexed.startswith("28B52FFD"), "zstd")
        .when(hexed.startswith("04224D18"), "lz4").when(hexed.startswith("5D0000"), "lzma_alone")
    )


def entropy_profile(blobs: DataFrame, key: str, content: str, samples: int = 16, block: int = 65_536) -> DataFrame:
    """(key, block, place, entropy) of `samples` pieces of `block` bytes, spread over each blob that is not empty."""
    size = F.octet_length(content)
    step = F.greatest(F.lit(block), F.floor(size / samples)).cast("long")
    places = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.least((size - 1).cast("long"), k * step))
    spread = blobs.where(size > 0).select(key, F.col(content).alias("blob__"), F.posexplode(places).alias("block", "place"))
    return spread.select(key, "block", "place", entropy(F.substr("blob__", (F.col("place") + 1).cast("int"), F.lit(block))).alias("entropy"))
