"""Line dedup with a segment-partition edit join.

A line is removed where an earlier line, by (doc_id, line number), is equal, or near: within
TAU edits of code points, or SHORT_TAU where one of the two is shorter than NEAR_LEAST bytes,
since two edits tell short sentences apart. Lines under LEAST bytes are near to none ("Part 1"
and "Part 2" are two headings), but go where they are equal. Equal lines meet by hash. For near
ones (PassJoin, Li et al., VLDB 2011) each line is split into TAU + 1 segments of even length;
within TAU edits one segment stays whole, so a line probes the segments of lines of its length
down to TAU less with the substrings that multi-match-aware selection leaves. Substring hashes
of a whole batch come from one rolling prefix sum in numpy. Pairs with a short line have
segments of their own, by SHORT_TAU. Candidates are verified by a banded bit-parallel automaton
on the lines themselves.

Hot segments (a page of near copies) are those with HOT lines over the whole table. Their lines
are cut into chunks. Lines that find an earlier near line in their own chunk are decided; only
the others travel on, to every chunk of the segment, where histograms of code points and their
pairs rule out most pairs before the automaton runs. A crowd of near copies thus sends a few
lines from chunk to chunk, whatever its size. The list of hot segments is bounded; a segment
beyond it is joined like any other: slower, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from stratasift.llm.common import forget, materialise, mix64, passes, slices, slot_filter

#: Edits; least bytes of a line that has near ones, and by TAU edits; edits of shorter lines.
TAU, LEAST, NEAR_LEAST, SHORT_TAU = 2, 20, 40, 1
#: Lines of a segment from which it is hot, most hot segments that tasks share, lines in a chunk, guests of a chunk in one group.
HOT, HOT_KEYS, CHUNK, GUESTS = 16, 1 << 20, 400, 4000
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def points(line: bytes) -> np.ndarray:
    """The code points of UTF-8."""
    return np.frombuffer(line, np.uint8) if line.isascii() else np.frombuffer(line.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def edits_allowed(a: bytes, b: bytes, tau: int, near_least: int) -> int:
    return tau if min(len(a), len(b)) >= near_least else min(tau, SHORT_TAU)


def within(a: bytes, b: bytes, tau: int) -> bool:
    """Whether a becomes b by at most tau insertions, deletions or substitutions of code points.

    Level d of the automaton holds a bit for each diagonal of the band that d edits reach; a
    code point of b moves all diagonals of a level at once.
    """
    x, y = points(a), points(b)
    if abs(len(x) - len(y)) > tau:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y, n = x[head:], y[head:], n - head
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    if not a or not b:
        return max(len(a), len(b)) <= tau
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + tau)
    band = (1 << (2 * tau + 1)) - 1
    levels = [0] * (tau + 1)
    for d in range(tau + 1):
        levels[d] = ((1 << (d + 1)) - 1) << tau & band  # the first d points of a deleted
    for j, c in enumerate(b):
        match = places.get(c, 0) >> j & band
        before = levels
        levels = [before[0] & match]
        for d in range(1, tau + 1):
            levels.append((before[d] & match | before[d - 1] | before[d - 1] >> 1 | levels[d - 1] << 1) & band)
        if not levels[tau]:
            return False
    return bool(levels[tau] >> (len(a) - len(b) + tau) & 1)


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the tau + 1 segments of lines of given lengths; the last ones are one longer."""
    short, longer = length // (tau + 1), length % (tau + 1)
    out, start = [], np.zeros_like(length)
    for i in range(tau + 1):
        size = short + (i >= tau + 1 - longer)
        out.append((start, size))
        start = start + size
    return out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse; tables of ordinary batches are kept."""
    if len(_powers[0]) < n:
        made = []
        for base in (_P, _PINV):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(table))
        if n > 4_000_000:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def segment_keys(lines: list[bytes], tau: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, line numbers) of the segments of lines, or of the substrings that they probe with, by code points."""
    length = np.array([len(x) for x in lines], dtype=np.int64)
    joined = b"".join(lines)
    if not joined.isascii():
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        length = np.diff(begun[np.concatenate([[0], np.cumsum(length)])])
    base = np.concatenate([[0], np.cumsum(length)])[:-1]
    data = points(joined).astype(np.uint64)
    data += np.uint64(1)
    with np.errstate(over="ignore"):
        power, inverse = powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        data *= power[:-1]
        np.cumsum(data, out=prefix[1:])

        keys, rows = [], []
        everything = np.arange(len(lines))
        for delta in range(tau + 1) if probe else (0,):
            target = length - delta
            for i, (start, size) in enumerate(segments(target, tau)):
                low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
                for shift in range(low, high + 1) if probe else (0,):
                    at = start + shift
                    ok = (at >= 0) & (at + size <= length)
                    s, e = base[ok] + at[ok], base[ok] + at[ok] + size[ok]
                    h = (prefix[e] - prefix[s]) * inverse[s]
                    keys.append(mix64(h ^ (target[ok].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(i + 1))))
                    rows.append(everything[ok])
    return np.concatenate(keys), np.concatenate(rows)


def near_keys(lines: list[bytes], tau: int, near_least: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """segment_keys of long lines by tau, and by SHORT_TAU of short ones and of those that one edit (4 bytes) makes short."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for chosen, edits, salt in ((size >= near_least, tau, 0), (size < near_least + 4, min(tau, SHORT_TAU), 0x5851F42D4C957F2D)):
        own = np.flatnonzero(chosen)
        if len(own):
            k, r = segment_keys([lines[i] for i in own], edits, probe)
            keys.append(mix64(k ^ np.uint64(salt)) if salt else k)
            rows.append(own[r])
    return np.concatenate(keys), np.concatenate(rows)


def _distinct_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Lines of some bytes at least, distinct within a bounded window of the task, with their ids."""
    seen: set[int] = set()
    held, ids, size = [], [], 0
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            for line in lines_of(text):
                if len(line) >= least and (h := xxh3_64_intdigest(line)) not in seen:
                    seen.add(h)
                    held.append(line)
                    ids.append(h)
                    size += len(line)
                    if size > 300_000:
                        yield held, np.array(ids, dtype=np.uint64).view(np.int64)
                        held, ids, size = [], [], 0
                        if len(seen) > 200_000:
                            seen.clear()
    if held:
        yield held, np.array(ids, dtype=np.uint64).view(np.int64)


def _index(docs: DataFrame, tau: int, least: int, near_least: int) -> DataFrame:
    """(key, id) of the lines' segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, ids in _distinct_lines(batches, least):
            keys, rows = near_keys(lines, tau, near_least, False)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids[rows])], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def _hot_keys(index: DataFrame) -> DataFrame:
    """Segments that HOT lines or more share over the whole table, most shared first, HOT_KEYS of them at most: key."""
    return index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key")


def _probes(docs: DataFrame, tau: int, least: int, near_least: int, hot, want_hot: bool) -> DataFrame:
    """(key, id) of the lines' probes, those that are hot or the others.

    A line's own segments are among its probes: those of its length, unshifted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        # Most keys are not hot: a slot each tells that before the table is searched.
        slots = np.zeros(1 << 22, dtype=bool)
        slots[(table & np.uint64(len(slots) - 1)).astype(np.int64)] = True
        for lines, ids in _distinct_lines(batches, least) if len(table) or not want_hot else ():
            keys, rows = near_keys(lines, tau, near_least, True)
            if len(table):
                maybe = np.flatnonzero(slots[(keys & np.uint64(len(slots) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
                hits = maybe[table[at] == keys[maybe]]
                chosen = np.full(len(keys), not want_hot)
                chosen[hits] = want_hot
                keys, rows = keys[chosen], rows[chosen]
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids[rows])], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def _texts(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """The lines of some ids: id, line. A bitmap of fixed size filters lines where they are read."""
    filtered = docs.sparkSession.sparkContext.broadcast(slot_filter(ids, F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, own in _distinct_lines(batches, least):
            hit = np.flatnonzero(passes(filtered.value, own))
            yield pa.record_batch([pa.array(own[hit]), pa.array([lines[i] for i in hit], pa.binary())], ["id", "line"])

    found = docs.select("text").mapInArrow(run, "id long, line binary")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _histograms(lines: list[bytes]) -> np.ndarray:
    """Counts of code points and of their pairs by hash; an edit changes at most two of the first and four of the second."""
    out = np.zeros((len(lines), 192), dtype=np.int32)
    for r, line in enumerate(lines):
        x = points(line).astype(np.int64)
        out[r, :64] = np.bincount(x & 63, minlength=64)
        out[r, 64:] = np.bincount((x[1:] * 31 + x[:-1]) & 127, minlength=128)
    return out


def near_pairs(lines: list[bytes], tau: int, near_least: int = 0, guests: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j, of lines within the edits they are allowed, tau at most; histograms rule most out.

    With guests (a mask), only pairs of a guest and a line that is none.
    """
    lengths = np.array([len(points(x)) for x in lines])
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    counts = _histograms([lines[i] for i in order])
    kind = guests[order] if guests is not None else None
    out = []
    for x in range(len(order)):
        y = np.arange(x + 1, int(np.searchsorted(lengths, lengths[x] + tau, "right")))
        if kind is not None:
            y = y[kind[y] != kind[x]]
        if len(y):
            y = y[np.abs(counts[y, :64] - counts[x, :64]).sum(axis=1) <= 2 * tau]
        if len(y):
            y = y[np.abs(counts[y, 64:] - counts[x, 64:]).sum(axis=1) <= 4 * tau]
        for j in y:
            a, b = lines[order[x]], lines[order[j]]
            if within(a, b, edits_allowed(a, b, tau, near_least)):
                out.append((min(order[x], order[j]), max(order[x], order[j])))
    return out


def _verified(batches: Iterator[pa.RecordBatch], tau: int, near_least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        near = [within(x, y, edits_allowed(x, y, tau, near_least)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        mask = pa.array(near, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first columns, which are longs."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(width)])
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(starts, starts[1:]):
                if held and (start or (keys[0] != last).any()):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
            last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _later(batches: Iterator[pa.RecordBatch], width: int, tau: int, near_least: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of ordered groups: one earlier line a near each line b that has any. Columns: the group's, id, line, and guest or none."""
    a, b = [], []
    for group in _runs(batches, width):
        ids, lines = group.column(width).to_pylist(), group.column(width + 1).to_pylist()
        guest = group.column(width + 2).to_numpy() if group.num_columns > width + 2 else None
        earlier = {j: i for i, j in near_pairs(lines, tau, near_least, guest) if guest is None or guest[j]}
        a += [ids[i] for i in earlier.values()]
        b += [ids[j] for j in earlier]
        if len(a) > 10_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def removed_lines(docs: DataFrame, tau: int = TAU, least: int = LEAST, near_least: int = NEAR_LEAST) -> DataFrame:
    """The lines to remove, of docs (doc_id, text): doc_id, line_no, id (the line's hash), near.

    near tells lines that only a near match removes from copies of an earlier line.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, numbers, one, two = [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                for n, line in enumerate(lines_of(text)):
                    if line and not line.isspace():
                        owner.append(r)
                        numbers.append(n)
                        one.append(xxh3_64_intdigest(line))
                        two.append(xxh3_128_intdigest(line) & 0x7FFFFFFFFFFFFFFF)
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(two, pa.int64())], ["doc_id", "line_no", "id", "check"])

    lines, _ = materialise(docs.select("doc_id", "text").mapInArrow(number, f"doc_id {kind}, line_no long, id long, check long"))
    firsts, _ = materialise(lines.groupBy("id", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    order = firsts.groupBy("id").agg(F.min("first").alias("first"))

    index, index_path = materialise(_index(docs, tau, least, near_least))
    hot_keys, hot_path = materialise(_hot_keys(index))
    hot = spark.sparkContext.broadcast(np.sort(hot_keys.toArrow().column("key").to_numpy().view(np.uint64)))
    # At most HOT_KEYS longs are broadcast. A line that stands in HOT tasks or more is hot by that: the others meet fewer than HOT rows a key.
    cold = index.join(F.broadcast(hot_keys), "key", "left_anti")
    i, p = cold.hint("shuffle_hash").alias("i"), _probes(docs, tau, least, near_least, hot, False).alias("p")
    pairs = i.join(p, F.expr("i.key = p.key and i.id <> p.id")).select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b")).distinct()
    pairs, pairs_path = materialise(pairs)
    crowd, crowd_path = materialise(_probes(docs, tau, least, near_least, hot, True).distinct())
    wanted, wanted_path = materialise(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowd.select("id")).distinct())
    texts, texts_path = materialise(_texts(docs, wanted, least))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")
    links = both.mapInArrow(lambda it: _verified(it, tau, near_least), "a long, b long")

    # Hot segments: first inside chunks, then what has no earlier near line there as guests of the other chunks.
    sizes = crowd.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = crowd.join(sizes, "key").join(texts, "id").join(order, "id")
    chunked = chunked.select("key", "id", "line", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("c"))

    in_order = ["doc_id", "line_no", "id"]
    chunk = chunked.repartition("key", "c").sortWithinPartitions("key", "c", *in_order).select("key", "c", "id", "line")
    own, own_path = materialise(chunk.mapInArrow(lambda it: _later(it, 2, tau, near_least), "a long, b long"))
    several = chunked.where("chunks > 1")
    undecided = several.join(own.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    undecided, undecided_path = materialise(undecided)
    zero = F.lit(0).cast("long")
    groups = undecided.groupBy("key").agg(F.ceil(F.count("*") / GUESTS).alias("groups"))
    guests = undecided.join(groups, "key").withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")))
    guests = guests.withColumn("d", F.explode(F.filter(F.sequence(zero, F.col("chunks") - 1), lambda d: d != F.col("c"))))
    hosts = several.join(groups, "key").withColumn("g", F.explode(F.sequence(zero, F.col("groups") - 1))).withColumn("d", F.col("c"))
    shared = ["key", "d", "g", "id", "line", "doc_id", "line_no"]
    meeting = guests.select(*shared, F.lit(True).alias("guest")).unionByName(hosts.select(*shared, F.lit(False).alias("guest")))
    meeting = meeting.repartition("key", "d", "g").sortWithinPartitions("key", "d", "g", *in_order).select("key", "d", "g", "id", "line", "guest")
    links = links.unionByName(own).unionByName(meeting.mapInArrow(lambda it: _later(it, 3, tau, near_least), "a long, b long"))

    ranked = links.join(order.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(order.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    near, _ = materialise(ranked.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    for path in (index_path, hot_path, pairs_path, crowd_path, wanted_path, texts_path, own_path, undecided_path):
        forget(spark, path)
    decided = firsts.join(near.withColumn("near", F.lit(True)), "id", "left").select("id", "check", "first", F.coalesce("near", F.lit(False)).alias("near"))
    out = lines.join(decided, ["id", "check"])
    copy = F.struct("doc_id", "line_no") != F.col("first")
    return out.where(copy | F.col("near")).select("doc_id", "line_no", "id", (F.col("near") & ~copy).alias("near"))


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = LEAST, near_least: int = NEAR_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text cut, and n_lines, n_copies, n_near, n_cut: lines before, copies and near matches removed, code points removed.

    Lines are split at line feeds; lines without a word stay. Equal lines count at any
    length; near are lines of `least` bytes or more within tau edits of code points, or
    SHORT_TAU if one has fewer than near_least bytes. The first line of several equal or
    near ones, by doc_id (numbers, strings or any other type that has an order) and line
    number, stays; a line goes if any earlier line is near it, whether that one stays or
    not. Rows that share a doc_id count as one document: their lines of one number and text
    are one line. Rows of a null doc_id stay as they are; a null text stays null. Columns of
    docs named like a new one are replaced by it. An empty table gives an empty result.
    """
    new = ["n_lines", "n_copies", "n_near", "n_cut"]
    docs = docs.drop(*(c for c in new if c not in (id_col, text_col)))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    removed = removed_lines(source, tau, least, near_least)
    # A document's list is bounded by its own lines.
    lists = removed.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id", "near")).alias("removed_lines__")).withColumnRenamed("doc_id", "removed_of__")
    joined = docs.join(lists, F.col(id_col) == F.col("removed_of__"), "left").drop("removed_of__")
    at = docs.columns.index(text_col)
    old = len(docs.columns)
    names = [*docs.columns, *new]
    schema = docs.select("*", *(F.lit(0).cast("long").alias(c) for c in new)).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(old).to_pylist()):
                lines = lines_of(text)
                copies = near = chars = 0
                if gone:
                    drop = {(g["line_no"], g["id"]): g["near"] for g in gone}
                    numbers = {n for n, _ in drop}
                    kept = []
                    for n, line in enumerate(lines):
                        key = (n, np.uint64(xxh3_64_intdigest(line)).astype(np.int64).item()) if n in numbers else None
                        if key in drop:
                            near += drop[key]
                            copies += not drop[key]
                            chars += len(points(line))
                        else:
                            kept.append(line)
                    text = b"\n".join(kept).decode("utf-8", "surrogatepass")
                texts.append(text)
                counts.append((len(lines) if text is not None else 0, copies, near, chars))
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(old)]
            yield pa.record_batch([*columns, *(pa.array([x[c] for x in counts], pa.int64()) for c in range(len(new)))], names)

    return joined.mapInArrow(cut, schema)


#: DuckDB's form: equality, and distance between all distinct lines of about one length. Its levenshtein() counts bytes, so
#: the accented letters of the tables become single control characters first; other non-ASCII characters count as their bytes.
ORACLE_SQL = r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents),
f as (select line, octet_length(encode(line)) as b, min({'d': doc_id, 'n': line_no}) as first,
    translate(line, 'ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúü', CONTROLS) as s, length(line) as c from l
  where regexp_matches(line, '[^\x20\x09-\x0D]') and doc_id is not null group by line),
near as (select distinct y.line from f x join f y on y.c between x.c - 2 and x.c + 2 and x.first < y.first and x.b >= 20 and y.b >= 20
  and levenshtein(x.s, y.s) <= case when least(x.b, y.b) >= 40 then 2 else 1 end),
r as (select l.*, {'d': l.doc_id, 'n': l.line_no} <> f.first as copy, near.line is not null as near from l left join f on f.line = l.line left join near on near.line = l.line)
select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where not (coalesce(copy, false) or near)), '') as text, count(*) as n_lines,
  count(*) filter (where coalesce(copy, false)) as n_copies, count(*) filter (where near and not coalesce(copy, false)) as n_near,
  coalesce(cast(sum(length(line)) filter (where coalesce(copy, false) or near) as bigint), 0) as n_cut
from r group by doc_id
""".replace("CONTROLS", " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 31)]))
