"""Language-model scores by subword lattice likelihood.

The pieces of an existing vocabulary span a lattice over each word (a word starts with the
vocabulary's word mark). A word's probability is the sum over all its segmentations of the
product of piece probabilities, by a forward recursion in log space; a text's is the product
over its words and an end. Piece probabilities start from the vocabulary's own scores and are
re-estimated once from the corpus: expected piece counts under the start weights (a forward
and a backward pass over the distinct training words, weighted by how often they occur).

Both passes run over the table of distinct words, not over texts. Texts then look words up:
the most frequent ones, whose number is bounded, in a shared table, the rest by a join on
the word's hash, so what is broadcast does not grow with the corpus. Words are told apart by
64-bit hashes in that join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from stratasift.llm.common import MULT, WordHasher, materialise, words_of

MARK = "▁"
#: Words that tasks share; cells of a lattice computed at once; smoothing of piece counts; distinct words a task holds.
FREQUENT, CELLS, SMOOTHING, HELD = 1 << 19, 150_000, 0.1, 400_000
NEVER = -1e30


class Pieces:
    """A vocabulary as sorted hashes of its pieces with log probabilities; bytes spell what no piece does."""

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_ids: np.ndarray):
        hashes = np.array([self.hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.longest = max(len(p) for p in pieces)
        self.byte_ids = byte_ids
        self.logp = np.asarray(scores, dtype=float)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(MULT)) & 0xFFFFFFFFFFFFFFFF
        return h

    def weighted(self, counts: np.ndarray) -> Pieces:
        """The same pieces with probabilities in proportion to counts (one more for the end of a text)."""
        new = object.__new__(Pieces)
        new.__dict__ = dict(self.__dict__)
        smooth = counts + SMOOTHING
        new.logp = np.log(smooth / smooth.sum())
        return new


def load_pieces(path: str) -> Pieces:
    """Read a vocabulary file. Scores that are ranks (0, -1, -2, ...) become weights of a Zipf curve, log 1 / (rank + 2.7)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores, byte_ids = [], [], np.zeros(256, dtype=np.int64)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = len(names)
            names.append(f"\x00{sp.id_to_piece(i)}")
            scores.append(None)
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            names.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
    known = np.array([s for s in scores if s is not None])
    ranks = bool((known == np.round(known)).all())
    weight = [-np.log(2.7 - s) if ranks else s for s in known]
    least = min(weight)
    it = iter(weight)
    logp = np.array([least if s is None else next(it) for s in scores])
    logp = np.append(logp, least)  # the end of a text
    return Pieces(names, logp - np.logaddexp.reduce(logp), byte_ids)


def lattices(words: list[bytes], pieces: Pieces, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log marginal probability of each word; with counts, also the expected uses of each piece."""
    out = np.zeros(len(words))
    expected = np.zeros(len(pieces.logp)) if counts is not None else None
    chars = [np.frombuffer((MARK + w.decode("utf-8", "replace")).encode("utf-32-le"), np.uint32) for w in words]
    lengths = np.array([len(c) for c in chars])
    for length in np.unique(lengths):
        members = np.flatnonzero(lengths == length)
        step = max(1, CELLS // int(length))
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            c = np.stack([chars[i] for i in part])
            z, uses = _lattice(c, pieces, None if counts is None else counts[part])
            out[part] = z
            if uses is not None:
                expected += uses
    return out, expected


def _lattice(c: np.ndarray, pieces: Pieces, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    n, length = c.shape
    code = c.astype(np.uint64) + np.uint64(1)
    ids: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    h = np.zeros((n, length), dtype=np.uint64)
    spelled = np.zeros((n, length), dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(1, min(pieces.longest, length) + 1):
            h = (h[:, : length - k + 1] + code[:, k - 1 :]) * MULT
            at = np.minimum(np.searchsorted(pieces.hashes, h.ravel()), len(pieces.hashes) - 1)
            hit = pieces.hashes[at] == h.ravel()
            piece = np.where(hit, pieces.ids[at], -1).reshape(h.shape)
            weight = np.where(piece >= 0, pieces.logp[piece], NEVER)
            if k == 1 and not hit.all():
                spelled = piece < 0
                for v in np.unique(c[spelled]):
                    used = pieces.byte_ids[list(chr(v).encode("utf-8", "replace"))]
                    weight[spelled & (c == v)] = pieces.logp[used].sum()
            ids.append(piece)
            weights.append(weight)
    most = len(weights)
    alpha = np.full((n, length + 1), NEVER)
    alpha[:, 0] = 0
    for e in range(1, length + 1):
        into = np.stack([alpha[:, e - k] + weights[k - 1][:, e - k] for k in range(1, min(most, e) + 1)])
        top = into.max(axis=0)
        alpha[:, e] = top + np.log(np.exp(into - top).sum(axis=0))
    z = alpha[:, length]
    if counts is None:
        return z, None
    beta = np.full((n, length + 1), NEVER)
    beta[:, length] = 0
    for s in range(length - 1, -1, -1):
        onto = np.stack([weights[k - 1][:, s] + beta[:, s + k] for k in range(1, min(most, length - s) + 1)])
        top = onto.max(axis=0)
        beta[:, s] = top + np.log(np.exp(onto - top).sum(axis=0))
    uses = np.zeros(len(pieces.logp))
    for k in range(1, most + 1):
        share = np.exp(alpha[:, : length - k + 1] + weights[k - 1] + beta[:, k:] - z[:, None]) * counts[:, None]
        if k == 1 and spelled.any():
            for v in np.unique(c[spelled]):
                mass = share[spelled & (c == v)].sum()
                np.add.at(uses, pieces.byte_ids[list(chr(v).encode("utf-8", "replace"))], mass)
        known = ids[k - 1] >= 0
        uses += np.bincount(ids[k - 1][known], weights=share[known], minlength=len(uses))
    return z, uses


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trained, others = Counter(), set()

    def flush() -> Iterator[pa.RecordBatch]:
        rest = [w for w in others if w not in trained]
        words = [*trained, *rest]
        counts = [*trained.values(), *[0] * len(rest)]
        for lo in range(0, len(words), 100_000):
            yield pa.record_batch([pa.array(words[lo : lo + 100_000], pa.binary()), pa.array(counts[lo : lo + 100_000], pa.int64())], ["word", "c"])
        trained.clear()
        others.clear()

    for batch in batches:
        for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            trained.update(words_of(text)) if train else others.update(words_of(text))
            if len(trained) + len(others) > HELD:
                yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """Distinct words of rows (text, train) with their occurrences in training rows (0 for others): word, c."""
    local = docs.select("text", "train").mapInArrow(_count_words, "word binary, c long")
    return local.groupBy("word").agg(F.sum("c").alias("c"))


def train_pieces(words: DataFrame, texts: int, pieces: Pieces) -> Pieces:
    """Re-estimate piece probabilities from the table of word counts; texts: the number of ends."""
    start = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(start.value.logp))
        for batch in batches:
            total += lattices(batch.column(0).to_pylist(), start.value, batch.column(1).to_numpy().astype(float))[1]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["piece", "n"])

    counts = np.zeros(len(pieces.logp))
    for r in words.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row a piece at most
        counts[r.piece] = r.n
    counts[-1] = texts
    return pieces.weighted(counts)


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """One row a document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose train_col is true (null: false). base_score is the smoothed
    unigram log10 probability of the words and the end; score that of the piece lattice.
    Null and empty texts hold the end alone. Repeated rows and null ids are scored like
    others and count as often as they come; with no training row, counts are zero and piece
    weights come from smoothing; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    words, _ = materialise(word_counts(d))
    texts = d.where("train").count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + texts, distinct + (texts > 0)
    pieces = spark.sparkContext.broadcast(train_pieces(words, texts, load_pieces(vocabulary)))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(0).to_pylist()
            h = np.array([xxh3_64_intdigest(x) for x in w], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(h), batch.column(1), pa.array(lattices(w, pieces.value)[0] / np.log(10))], ["h", "c", "lattice"])

    scored, _ = materialise(words.mapInArrow(score_words, "h long, c long, lattice double"))
    level = F.floor(F.log2(F.col("c") + 1) * 8)
    histogram = {r.level: r.n for r in scored.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # some hundreds of levels
    least, held = max(histogram, default=0) + 1, 0
    while histogram and least - 1 >= min(histogram) and held + histogram.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += histogram.get(least, 0)
    common = scored.where(level >= least).toArrow()  # FREQUENT rows at most
    ch = common.column("h").to_numpy().view(np.uint64)
    order = np.argsort(ch)
    shared = spark.sparkContext.broadcast((ch[order], common.column("c").to_numpy()[order], common.column("lattice").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        hashes, count, lattice = shared.value
        logc = np.log10(count + 0.1)
        for batch in batches:
            sizes, known, base, lat, tails, tfs = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                w, tf = np.unique(hasher(words_of(text)), return_counts=True)
                hit = np.zeros(len(w), dtype=bool)
                if len(hashes) and len(w):
                    at = np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)
                    hit = hashes[at] == w
                    at, n = at[hit], tf[hit]
                    known.append(int(n[count[at] > 0].sum()))
                    base.append(float(n @ logc[at]))
                    lat.append(float(n @ lattice[at]))
                else:
                    known.append(0), base.append(0.0), lat.append(0.0)
                sizes.append(int(tf.sum()))
                tails.append(w[~hit].view(np.int64))
                tfs.append(tf[~hit])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lat, pa.float64()), pa.array(tails, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))],
                ["row", "doc_id", "train", "n", "known", "base", "lattice", "tail", "tf"],
            )

    kind = dict(d.dtypes)["doc_id"]
    rows = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "train")
    rows, _ = materialise(rows.mapInArrow(look_up, f"row long, doc_id {kind}, train boolean, n long, known long, base double, lattice double, tail array<long>, tf array<long>"))
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.tf").alias("tf"))
    joined = tail.join(scored.select("h", "c", F.col("lattice").alias("lw")), "h")
    sums = joined.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("b"), F.sum(F.col("tf") * F.col("lw")).alias("l"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"))
    out = rows.drop("tail", "tf").join(sums, "row", "left")
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    end_base, end_lattice = float(np.log10(texts + 0.1)), float(pieces.value.logp[-1] / np.log(10))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("k", F.lit(0)) + int(texts > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) + end_base - (F.col("n") + 1) * F.lit(norm)).alias("base_score"),
        (F.col("lattice") + F.coalesce("l", F.lit(0.0)) + F.lit(end_lattice)).alias("score"),
    )
