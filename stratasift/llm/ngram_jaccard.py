"""N-gram Jaccard join with set-relation skipping.

Exact self-join of documents whose shingle sets have a Jaccard similarity of at least
num/den, as connected components. It follows the two skips of "Leveraging set relations
in exact set similarity join" (Wang et al., VLDB 2017):

* index-level skip: inverted lists of prefix tokens hold (position, set); entries of one
  position form a block, and a block is skipped as a whole when even its best entry cannot
  reach the overlap that the threshold asks for;
* answer-level skip: the answers of a set are derived from those of a highly similar set
  (its leader). Jaccard distance is a metric, so whatever is near a follower lies within
  (1 - t) + d(leader, follower) of the leader.

Tokens are 64-bit hashes of word windows. Any total order of tokens gives right results;
shingles that are locally frequent get the last places, so shared passages rarely enter a
prefix. The lists of frequent shingles have a fixed bound and change speed only. Pairs of short
lists must leave room for their overlap in a small histogram of each set before they count, so
that chance neither sends sets nor ties them into crowds that grow with the table.

Equal sets are one class. Classes that a chain of candidates connects (a crowd) meet in one
group while they are few, so that each set is sent once, not once a list; a group has its own
inverted lists, where both skips act. Larger crowds are joined list by list. Beyond a bound,
crowds and lists are cut into chunks. In lists of a large crowd chunks are joined by themselves
first; then only classes that are not yet linked with most of their list travel from chunk to
chunk. A group returns at most one edge a set (a spanning forest).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import WordHasher, components, forget, materialise, passes, slot_filter, window_hashes, words_of

#: Prefix lists of up to SHORT sets are joined pair by pair; longer ones by pairs of chunks of about CHUNK sets.
SHORT, CHUNK = 256, 1024
#: Tokens of a chunk of a crowd, so that long texts make chunks of fewer sets.
TOKENS = 1_000_000
#: Crowds of candidates of up to so many sets are compared as a whole, by pairs of chunks; in larger ones, list by list.
WHOLE = 16 * CHUNK
#: Sets that visit a chunk of a long list in one group.
GUESTS = 1024
#: Bounds of the lists of frequent shingles that tasks share: of any, and of the low ones.
FREQUENT, LOW_FREQUENT = 32_768, 262_144


def shingle_set(text: str | None, k: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; a shorter text is one shingle, an empty one has none."""
    return np.unique(window_hashes(hasher(words_of(text)), k))


def needed_overlap(na, nb, num: int, den: int):
    """Least overlap of sets of na and nb tokens with den * overlap >= num * union."""
    return -((-num * (na + nb)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens among which two sets of that threshold must share one: n - ceil(n * num / den) + 1."""
    return n + 1 + (-n * num) // den


def low_tokens(num: int, den: int) -> int:
    """Tokens below this are twice the share of all that prefixes hold; rare ones come by hash, so most of a prefix lies below."""
    return min(1 << 63, (1 << 65) * (den - num) // den)


def _local_frequent(batches: Iterator[pa.RecordBatch], k: int, low: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def fold() -> None:
        nonlocal tokens, counts, held
        t, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        both = np.concatenate([tokens, t])
        tokens, where = np.unique(both, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, c]), minlength=len(tokens)).astype(np.int64)
        keep = counts > 1
        tokens, counts, held = tokens[keep], counts[keep], []

    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(shingle_set(text, k, hasher))
            size += len(held[-1])
            if size > 2_000_000:
                fold()
                size = 0
    fold()
    top = np.flatnonzero(counts >= 6)
    top = top[np.argsort(-counts[top], kind="stable")[: FREQUENT // 2]]
    # In a large table a shingle of hundreds of lists may repeat only once in a task.
    below = np.flatnonzero(tokens < np.uint64(low))
    top = np.union1d(top, below[np.argsort(-counts[below], kind="stable")[:LOW_FREQUENT]])
    yield pa.record_batch([pa.array(tokens[top].view(np.int64)), pa.array(counts[top])], ["token", "n"])


def frequent_shingles(docs: DataFrame, k: int, num: int, den: int) -> np.ndarray:
    """Up to FREQUENT shingles that repeat within a partition, and LOW_FREQUENT of the low ones, rarest first. A bounded aid to ordering, not an exact count."""
    low = low_tokens(num, den)
    local = docs.select("text").mapInArrow(lambda it: _local_frequent(it, k, low), "token long, n long")
    counted, path = materialise(local.groupBy("token").agg(F.sum("n").alias("n")).where("n > 2"))
    most = lambda df, n: df.orderBy(F.desc("n"), "token").limit(n)
    rows = most(counted, FREQUENT).union(most(counted.where(F.col("token").between(0, low - 1)), LOW_FREQUENT)).distinct().toArrow()
    forget(docs.sparkSession, path)
    token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    return token[np.lexsort((-token, n))].view(np.uint64)


def ordered_prefix(tokens: np.ndarray, sorted_frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of the set in the global order: rare shingles by hash, then frequent ones by rank."""
    p = prefix_length(len(tokens), num, den)
    if not len(sorted_frequent):
        return tokens[:p]
    at = np.minimum(np.searchsorted(sorted_frequent, tokens), len(sorted_frequent) - 1)
    hot = sorted_frequent[at] == tokens
    rare = tokens[~hot]
    if len(rare) >= p:
        return rare[:p]
    tail = tokens[hot]
    return np.concatenate([rare, tail[np.argsort(rank[at[hot]])]])[:p]


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(tokens.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(tokens * np.uint64(0xD6E8FEB86659FD93) ^ (tokens >> np.uint64(32))).view(np.int64))


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens of a set end in each value of some low bits: a byte a count, a power of two of them, about n / 4; empty if a count needs more."""
    slots = 1 << max(4, (len(tokens) // 4).bit_length() - 1)
    counts = np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens that two sets with these sketches have in common at most."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    slots = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, slots).sum(axis=0), y.reshape(-1, slots).sum(axis=0)).sum())


def _near_by_sketch(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, x, y) whose sketches leave room for the overlap that the threshold asks for."""
    for batch in batches:
        sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
        room = [not x or not y or most_overlap(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= needed_overlap(na, nb, num, den) for na, nb, x, y in sizes]
        mask = pa.array(room, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _index(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    order = np.argsort(frequent)
    sorted_frequent, rank = frequent[order], order
    list_type = pa.list_(pa.int64())
    for batch in batches:
        sizes, s1, s2, prefixes, sketches = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            t = shingle_set(text, k, hasher)
            sizes.append(len(t))
            x, y = identity(t)
            s1.append(x)
            s2.append(y)
            sketches.append(sketch(t) if len(t) else b"")
            prefixes.append(ordered_prefix(t, sorted_frequent, rank, num, den).view(np.int64) if len(t) else np.empty(0, np.int64))
        lengths = np.array([len(p) for p in prefixes], dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64))
        yield pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values).cast(list_type), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "s1", "s2", "prefix", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        batch = batch.filter(pa.array(passes(bits, batch.column(2).to_numpy())))
        sets = [shingle_set(text, k, hasher) for text in batch.column(1).to_pylist()]
        named = [identity(t) for t in sets]
        yield pa.record_batch(
            [batch.column(0), pa.array([len(t) for t in sets], pa.int64()), pa.array([x for x, _ in named], pa.int64()), pa.array([y for _, y in named], pa.int64()), pa.array([t.tobytes() for t in sets], pa.binary())],
            ["rep", "n_shingles", "s1", "s2", "tokens"],
        )


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            keep.append(int((large[at] == small).sum()) >= needed_overlap(len(a), len(b), num, den))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - sizes), sizes)


class Lists:
    """Inverted lists over the prefixes of some sets: blocks of one token and position, in that order.

    Tokens are ordered by their hash, those that many of the sets hold last.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, vocabulary: int, num: int, den: int):
        self.num, self.den = num, den
        self.sizes = sizes = np.diff(starts)
        m = len(sizes)
        owner = np.repeat(np.arange(m), sizes)
        often = np.bincount(flat, minlength=vocabulary) > max(8, m // 8)
        ordered = flat[np.argsort(owner * 2 + often[flat], kind="stable")]
        self.lengths = sizes + 1 + (-sizes * num) // den
        self.prefixes = [ordered[s : s + n] for s, n in zip(starts, self.lengths)]
        at = _ranges(starts[:-1], starts[:-1] + self.lengths)
        token, owner = ordered[at], np.repeat(np.arange(m), self.lengths)
        position = at - starts[owner]
        order = np.lexsort((owner, position, token))
        token, position, self.owner = token[order], position[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (position[1:] != position[:-1])]))
        self.begin, self.end = new, np.append(new[1:], len(token))
        self.position = position[new]
        held = sizes[self.owner]
        self.least = np.minimum.reduceat(held, new)
        self.left = np.maximum.reduceat(held, new) - self.position
        self.first = np.searchsorted(token[new], np.arange(vocabulary + 1))

    def candidates(self, x: int) -> np.ndarray:
        """Sets, in order and without x, in the blocks that no skip excludes."""
        tokens, n = self.prefixes[x], self.sizes[x]
        lo, hi = self.first[tokens], self.first[tokens + 1]
        blocks = _ranges(lo, hi)
        own_left = np.repeat(n - np.arange(len(tokens)), hi - lo)
        useful = np.minimum(own_left, self.left[blocks]) >= needed_overlap(n, self.least[blocks], self.num, self.den)
        blocks = blocks[useful]
        found = np.unique(self.owner[_ranges(self.begin[blocks], self.end[blocks])])
        return found[found != x]


def chunk_forest(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some sets; with labels, of those that join different labels.

    Each turn takes a leader that follows no earlier one, finds its candidates in the inverted
    lists, and computes its overlaps with those that are not farther from an earlier leader
    than the triangle inequality allows. Sets that link with a leader become its followers: of
    their candidates only those in the leader's ring just beyond the threshold, or whose
    distance the leader left open, are compared, and none that is connected already.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    lists = Lists(flat, starts, len(vocabulary), num, den)
    width = 1 - num / den
    parent = np.arange(m)
    if labels is not None:
        _, first, group = np.unique(labels, return_index=True, return_inverse=True)
        parent = first[group]
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(x: int, y: int) -> None:
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            edges.append((int(ids[x]), int(ids[y])))

    def all_roots() -> np.ndarray:
        roots = parent
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        return roots

    member = np.zeros(len(vocabulary), dtype=bool)

    def overlaps(x: int, among: np.ndarray) -> np.ndarray:
        own = flat[starts[x] : starts[x + 1]]
        member[own] = True
        hit = member[flat[_ranges(starts[among], starts[among + 1])]]
        out = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[among])[:-1]]), dtype=np.int64)
        member[own] = False
        return out

    follows = np.full(m, -1)
    to_leader = np.zeros(m)
    known: list[tuple[int, np.ndarray]] = []
    for x in range(m):
        if follows[x] >= 0:
            continue
        chosen = lists.candidates(x)
        if labels is not None:
            chosen = chosen[all_roots()[chosen] != find(x)]
        for _, distance in known[-8:]:
            if distance[x] <= 1:
                chosen = chosen[(distance[chosen] - distance[x] <= width + 1e-9) | (distance[chosen] > 1)]
        distance = np.full(m, 2.0)
        distance[x] = 0
        if len(chosen):
            o = overlaps(x, chosen)
            distance[chosen] = 1 - o / (sizes[x] + sizes[chosen] - o)
            for j in chosen[o >= needed_overlap(sizes[x], sizes[chosen], num, den)]:
                link(x, int(j))
                if follows[j] < 0 and j > x:
                    follows[j], to_leader[j] = x, distance[j]
        known.append((x, distance))
    by_leader = dict(known)
    roots = all_roots()
    for a in np.flatnonzero(follows >= 0):
        if (roots == roots[a]).all():
            break
        near = lists.candidates(int(a))
        near = near[(follows[near] >= 0) & (roots[near] != roots[a])]
        ring = by_leader[int(follows[a])]
        near = near[(ring[near] <= width + to_leader[a] + 1e-9) | (ring[near] > 1)]
        if len(near):
            o = overlaps(int(a), near)
            if len(linked := near[o >= needed_overlap(sizes[a], sizes[near], num, den)]):
                for j in linked:
                    link(int(a), int(j))
                roots = all_roots()
    return edges


def _forest(num: int, den: int):
    """A grouped function: edges among the sets (cls, tokens) of a group, or between its labels where it has them."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cls").drop_duplicates("cls")
        labels = frame["label"].to_numpy(np.int64) if "label" in frame else None
        edges = chunk_forest(frame["cls"].to_numpy(np.int64), [np.frombuffer(v, np.uint64) for v in frame["tokens"]], num, den, labels)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _chunks(rows: DataFrame) -> DataFrame:
    """chunks and c, the number of a row's own chunk: by length and weight (sets and tokens of the group)."""
    whole = (F.col("length") <= 2 * CHUNK) & (F.col("weight") <= 2 * TOKENS)
    chunks = F.when(whole, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("length") / CHUNK), F.ceil(F.col("weight") / TOKENS))).cast("long")
    return rows.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("chunks")))


def _pairs_of_chunks(rows: DataFrame, key: str, forest) -> DataFrame:
    """forest() over the rows of each key (key, cls, tokens, length, weight): whole if small enough for two chunks, else each pair of its chunks."""
    zero = F.lit(0).cast("long")
    cut = _chunks(rows)
    others = F.when(F.col("chunks") == 1, F.array(zero)).otherwise(F.filter(F.sequence(zero, F.col("chunks") - 1), lambda d: d != F.col("c")))
    cut = cut.withColumn("d", F.explode(others)).select(key, F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "cls", "tokens")
    return cut.groupBy(key, "lo", "hi").applyInPandas(forest, "a long, b long")


def _chunks_and_guests(rows: DataFrame, key: str, links: DataFrame, forest) -> tuple[DataFrame, list[str]]:
    """Edges among the rows of each key, as _pairs_of_chunks, besides those that links and each chunk's own edges imply.

    After the chunks' own edges, the rows of a key that are not in its most frequent component
    are guests of all other chunks. A list of near copies is one component by then.
    """
    spark = rows.sparkSession
    cut, cut_path = materialise(_chunks(rows).select(key, "cls", "tokens", "chunks", "c"))
    own, own_path = materialise(cut.groupBy(key, "c").applyInPandas(forest, "a long, b long"))
    several = cut.where("chunks > 1")
    labels = components(links.unionByName(own))
    labelled = several.join(labels, F.col("cls") == F.col("v"), "left").withColumn("label", F.coalesce("component", "cls")).drop("v", "component")
    labelled, labelled_path = materialise(labelled)
    home = labelled.groupBy(key, "label").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.sum("n").alias("all"), F.max("n").alias("most"))
    home = home.where(F.col("all") > F.col("most")).select(key, "home", F.ceil((F.col("all") - F.col("most")) / GUESTS).alias("groups"))
    zero = F.lit(0).cast("long")
    open_ = labelled.join(home, key)
    guests = open_.where("label <> home").withColumn("g", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("groups")))
    guests = guests.withColumn("d", F.explode(F.filter(F.sequence(zero, F.col("chunks") - 1), lambda d: d != F.col("c"))))
    hosts = open_.withColumn("g", F.explode(F.sequence(zero, F.col("groups") - 1))).withColumn("d", F.col("c"))
    columns = [key, "d", "g", "cls", "tokens", "label"]
    meeting = guests.select(columns).unionByName(hosts.select(columns))
    between, between_path = materialise(meeting.groupBy(key, "d", "g").applyInPandas(forest, "a long, b long"))
    for path in (cut_path, labelled_path):
        forget(spark, path)
    return own.unionByName(between), [own_path, between_path]


def near_duplicate_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are split at ASCII white space after lower-casing A-Z. A text with fewer than k
    words is one shingle; an empty or null text has none and links with nothing. Rows of a
    null doc_id keep a null component_id and link with nothing. Repeated rows are returned
    as often as they come; rows that share a doc_id count as one document, whatever their
    texts: a link of any of them is a link of all that have shingles. An id may be of any
    type that has an order. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, k, num, den))
    index, _ = materialise(docs.mapInArrow(lambda it: _index(it, k, num, den, frequent.value), f"doc_id {kind}, n_shingles long, s1 long, s2 long, prefix array<long>, sketch binary"))
    filled = index.where("n_shingles > 0 and doc_id is not null")
    identity_columns = ["s1", "s2", "n_shingles"]
    # Classes of equal sets; numbered once, as they are written.
    classes = filled.groupBy(*identity_columns).agg(F.min("doc_id").alias("rep"), F.first(F.struct("prefix", "sketch")).alias("made")).select(*identity_columns, "rep", "made.*")
    classes, _ = materialise(classes.withColumn("cls", F.monotonically_increasing_id()))
    lists = classes.select("cls", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = lists.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    postings, postings_path = materialise(lists.join(shared.hint("shuffle_hash"), "token"))

    short = postings.where(F.col("length") <= SHORT)
    x, y = short.alias("x"), short.alias("y")
    # A shared token at these positions leaves room for the smaller head, itself and the smaller tail; sizes must be near.
    room = f"{num + den} * (least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos)) >= {num} * (x.n + y.n)"
    shares = x.join(y, F.expr(f"x.token = y.token and x.cls < y.cls and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {room}"))
    shares = shares.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("shared"), F.max(F.expr("least(x.n - x.pos, y.n - y.pos)")).alias("tail"))
    # Beyond the tokens shared by both prefixes, a pair has at most one suffix in common; tokens of long lists may be shared too.
    crowded = postings.where(F.col("length") > SHORT).groupBy("cls").agg(F.count("*").alias("crowded"))
    shares = shares.join(crowded.withColumnRenamed("cls", "a").withColumnRenamed("crowded", "ca"), "a", "left").join(crowded.withColumnRenamed("cls", "b").withColumnRenamed("crowded", "cb"), "b", "left")
    suffix = F.expr(f"greatest(ceil(na * {num} / {den}), ceil(nb * {num} / {den})) - 1")
    need = num * (F.col("na") + F.col("nb"))
    hidden = F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    first = (num + den) * F.col("tail") >= need  # if the first shared token is not in a long list
    kept = ((num + den) * (F.col("shared") + hidden + suffix) >= need) & (first | (hidden > 0))
    shares = shares.where(kept).select("a", "b", "na", "nb")
    # Most pairs share a token by chance. Sketches tell so before sets are sent and before chance ties crowds together.
    sketches = classes.select("cls", "sketch")
    drawn = shares.join(sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    pairs, pairs_path = materialise(drawn.select("a", "b", "na", "nb", "x", "y").mapInArrow(lambda it: _near_by_sketch(it, num, den), "a long, b long"))
    long = postings.where(F.col("length") > SHORT)
    # Sets that some chain of candidates connects meet in one group if they are few, each sent there once.
    owners = long.groupBy("token").agg(F.min("cls").alias("owner"))
    stars = long.join(owners, "token").where("cls <> owner").select(F.col("owner").alias("a"), F.col("cls").alias("b")).distinct()
    joined = components(pairs.unionByName(stars))
    members = joined.select(F.col("v").alias("cls"), F.col("component").alias("crowd")).unionByName(joined.select(F.col("component").alias("cls"), F.col("component").alias("crowd")).distinct())
    members = members.join(classes.select("cls", "rep", *identity_columns), "cls")
    members = members.join(members.groupBy("crowd").agg(F.count("*").alias("crowd_size"), F.sum("n_shingles").alias("weight")), "crowd")
    members, members_path = materialise(members)
    # Sets are made again where the texts are read; the bitmap keeps texts that no list needs from being shingled or shuffled.
    bits = spark.sparkContext.broadcast(slot_filter(members, F.xxhash64("rep")))
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = texts.mapInArrow(lambda it: _sets(it, k, bits.value), f"rep {kind}, n_shingles long, s1 long, s2 long, tokens binary").where("n_shingles > 0")
    sets, sets_path = materialise(sets.join(members, [*identity_columns, "rep"]).select("cls", "crowd", "crowd_size", "weight", "tokens"))

    forest = _forest(num, den)
    crowds = sets.where(F.col("crowd_size") <= WHOLE)
    links = _pairs_of_chunks(crowds.select("crowd", "cls", "tokens", F.col("crowd_size").alias("length"), "weight"), "crowd", forest)
    paths = [postings_path, pairs_path, members_path, sets_path]

    large = sets.where(F.col("crowd_size") > WHOLE).select("cls", "tokens")
    if not large.isEmpty():  # crowds beyond that: short lists pair by pair, long ones by chunks
        left = pairs.join(large.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
        both = left.join(large.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
        links, links_path = materialise(links.unionByName(both.mapInArrow(lambda it: _verify(it, num, den), "a long, b long")))
        listed = long.join(large, "cls").select("token", "cls", "tokens", "length", F.lit(0).cast("long").alias("weight"))
        more, more_paths = _chunks_and_guests(listed, "token", links, forest)
        links = links.unionByName(more)
        paths += [links_path, *more_paths]

    # Rows that share a doc_id are linked by it.
    several = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    of_ids = filled.join(several, "doc_id").select("doc_id", *identity_columns).distinct().join(classes.select("cls", *identity_columns), identity_columns)
    same = of_ids.join(of_ids.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").select("a", F.col("cls").alias("b"))
    labels = components(links.unionByName(same.where("a <> b")))
    for path in paths:
        forget(spark, path)
    found = classes.drop("prefix", "sketch").join(labels, F.col("cls") == F.col("v"), "left").withColumn("label", F.coalesce("component", "cls"))
    least = found.groupBy("label").agg(F.min("rep").alias("least"))
    found = found.join(least, "label").select(*identity_columns, "least")
    out = index.drop("prefix", "sketch").join(found, identity_columns, "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
