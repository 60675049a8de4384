"""Benchmark decontamination by size-partitioned MinHash containment search.

After LSH Ensemble (Zhu et al., VLDB 2016): benchmark items are partitioned by size, so that
inside a partition containment converts to a Jaccard threshold without much loss. A partition's
largest item is at most RATIO times its smallest, and there are as many partitions as the
sizes need. A long document would drown a short item, so for each partition it is read through
half-overlapping windows of twice the partition's largest item: an item's passage lies whole in
one of them, and the Jaccard similarity of window and item is 1 / (2 * RATIO) at least (a bit
less for items found in part). An item and a window are a candidate if any of the partition's
bands of MinHash values agree; candidates are verified by exact containment of the item's
distinct word shingles in the whole document.

The benchmark is indexed in groups of at most GROUP items, each a broadcast of bounded size;
documents are mapped in place and never shuffled. Only windows that hold a shingle which is
the minimum of some item of the partition are sketched: no other window can agree with any band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.llm.common import WordHasher, mix64, window_hashes, words_of

#: Hash functions (bands of one row), largest to smallest item of a partition, and most items in one broadcast index.
FUNCTIONS, RATIO, GROUP = 96, 2, 20_000
SEEDS = mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Band keys of a set: for each function its smallest hash, made distinct by function."""
    with np.errstate(over="ignore"):
        step = max(1, 200_000 // len(shingles))  # functions at once
        low = np.concatenate([mix64(shingles[None, :] + SEEDS[j : j + step, None]).min(axis=1) for j in range(0, FUNCTIONS, step)])
        return mix64(low ^ SEEDS)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mask of the values that a sorted table, not empty, holds."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class ItemIndex:
    """Size-partitioned MinHash index of (item_id, text) pairs; items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]], k: int):
        hasher = WordHasher()
        kept = [(i, np.unique(window_hashes(hasher(words_of(text)), k))) for i, text in items]
        kept = sorted((x for x in kept if len(x[1])), key=lambda x: len(x[1]))
        self.ids = [i for i, _ in kept]
        self.sets = [s for _, s in kept]
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        start = 0
        while start < len(kept):
            end = int(np.searchsorted(sizes, RATIO * sizes[start], "right"))
            keys, owners, minimal = [], [], []
            for n in range(start, end):
                s = self.sets[n]
                keys.append(sketch(s))
                owners.append(np.full(FUNCTIONS, n))
                with np.errstate(over="ignore"):
                    minimal.append(np.unique([s[mix64(s + seed).argmin()] for seed in SEEDS]))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.parts.append((int(sizes[end - 1]), keys[order], owners[order], np.unique(np.concatenate(minimal))))
            start = end
        self.minimal = np.unique(np.concatenate([m for *_, m in self.parts])) if self.parts else np.empty(0, np.uint64)

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Numbers of the items of which a window of the shingle sequence has an equal band."""
        if not len(self.minimal) or not len(shingles):
            return set()
        hits = np.flatnonzero(among(shingles, self.minimal))
        found: set[int] = set()
        if not len(hits):
            return found
        for largest, keys, owners, minimal in self.parts:
            own = hits[among(shingles[hits], minimal)]
            for w in np.unique(np.concatenate([own // largest, np.maximum(own // largest - 1, 0)])):
                bands = sketch(shingles[w * largest : (w + 2) * largest])
                lo, hi = np.searchsorted(keys, bands, "left"), np.searchsorted(keys, bands, "right")
                for a, b in zip(lo, hi):
                    found.update(owners[a:b].tolist())
        return found

    def contained(self, shingles: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
        """(item_id, item shingles, those found) of the items with den * found >= num * all, verified exactly."""
        out = []
        if numbers := self.candidates(shingles):
            whole = np.unique(shingles)
            for n in sorted(numbers):
                s = self.sets[n]
                found = int(among(s, whole).sum())
                if den * found >= num * len(s):
                    out.append((self.ids[n], len(s), found))
        return out


def _indexes(benchmark: DataFrame, k: int, id_col: str, text_col: str) -> list:
    """Broadcast indexes of GROUP items each."""
    spark = benchmark.sparkSession
    out, group = [], []
    for r in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        group.append((r[0], r[1]))
        if len(group) == GROUP:
            out.append(spark.sparkContext.broadcast(ItemIndex(group, k)))
            group = []
    if group or not out:
        out.append(spark.sparkContext.broadcast(ItemIndex(group, k)))
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and item found in it: doc_id, item_id, n_item_shingles, n_found, containment.

    Words are split at ASCII white space after lower-casing A-Z; an item of fewer than k words
    is one shingle of all of them, which only an equally short text holds. Items and documents
    without words, or null, match nothing. Repeated rows and null ids are returned as they
    are; other columns are ignored; an empty table on either side gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("item_id long, n_item_shingles long, n_found long, containment double").fields])
    made = []
    for index in _indexes(benchmark, k, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for hit in index.value.contained(window_hashes(hasher(words_of(text)), k), num, den):
                        rows.append(i)
                        found.append((*hit, hit[2] / hit[1]))
                columns = list(zip(*found)) if found else [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

        made.append(source.mapInArrow(run, schema))
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in whose text no item is contained, with all their columns, in the same partitions."""
    at = docs.columns.index(text_col)
    indexes = _indexes(benchmark, k, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                shingles = window_hashes(hasher(words_of(text)), k)
                clean.append(not any(index.value.contained(shingles, num, den) for index in indexes))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB's exact containment over `documents` and `benchmark`.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark),
bs as (select distinct item_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as s, least(5, len(w)) as k
  from b, lateral (select unnest(range(1, len(w) - least(5, len(w)) + 2)) as i) where len(w) > 0),
ds as (select distinct doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as s, least(5, len(w)) as k
  from d, lateral (select unnest(range(1, len(w) - least(5, len(w)) + 2)) as i) where len(w) > 0),
n as (select item_id, count(*) as n from bs group by item_id)
select doc_id, n.item_id, n.n as n_item_shingles, count(*) as n_found, count(*) / n.n as containment
from ds join bs using (s, k) join n on n.item_id = bs.item_id
group by doc_id, n.item_id, n.n having 100 * count(*) >= 80 * n.n
"""
