"""What several operators share: materialised intermediates, word hashing and distributed components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

MULT = np.uint64(0x9E3779B97F4A7C15)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and all runs on this machine, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="stratasift-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: later stages survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that no later stage reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows, so that Python holds the texts of one slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, remembered up to a fixed number of distinct words."""

    def __init__(self, limit: int = 400_000):
        from xxhash import xxh3_64_intdigest

        self.digest, self.known, self.limit = xxh3_64_intdigest, {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            digest = self.digest
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    if (v := known.get(w)) is None:
                        v = known[w] = digest(w)
                    out[i] = v
        return np.array(out, dtype=np.uint64)


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8; bytes.lower() changes A-Z only and bytes.split() splits at the six ASCII spaces."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes; fewer words than k (but some) make one window of all of them."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h = (h + words[j : n - k + 1 + j]) * MULT
            h ^= h >> np.uint64(29)
    return mix64(h + np.uint64(k))


#: Bits of an id filter that tasks share (4 MB), whatever the number of ids.
FILTER_BITS = 1 << 25


def slot_filter(df: DataFrame, hashed: Column) -> np.ndarray:
    """A bitmap of FILTER_BITS with the slots of uniformly hashed longs: it lets all of them through, and others as it fills up."""
    slot = hashed.bitwiseAND(F.lit(FILTER_BITS - 1))
    words = df.select(slot.alias("s")).select(F.expr("s div 64").alias("w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.bits
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Mask of the longs whose slot is in the filter."""
    slot = hashed.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the vertices of undirected edges (a long, b long) with the smallest vertex they reach: (v, component).

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each node
    links its neighbours to the smallest one, which at most doubles no node's degree for
    long, and stops when a round changes nothing. Each round is written to the shared
    folder; nothing is gathered in one task beyond a partial minimum per vertex.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = materialise(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt, npath = materialise(small)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(spark, path)
        e, path = nxt, npath
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    tails = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v")
    return tails
