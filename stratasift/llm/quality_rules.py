"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths mark the words that lie in an n-gram
found twice or more in the text; the share of characters inside such n-grams, and inside
lines equal to an earlier line, decides. Each length's hashes extend those of the length
before, all in numpy, one text at a time: memory follows the longest text, and no shuffle
is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratasift.llm.common import MULT, WordHasher

#: Symbols counted, and the largest share in % of word characters inside duplicated n-grams, by n.
#: A heading repeated once as a footer stays below these in a text of a hundred words.
SYMBOLS = b"#*$%&|<>"
COVERAGE_LIMITS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: Largest share in % of lines, and of word characters, in lines equal to an earlier one; symbols for each 100 words.
LINE_LIMIT, LINE_CHAR_LIMIT, SYMBOL_LIMIT = 50, 30, 25
#: Base rule: least words, window of the repeat count, largest share in % of repeated words.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_LIMIT = 20, 8, 30

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_gram_chars"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, dup_gram_chars long"


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Mask of the words inside n-grams found twice or more; None if all n-grams are distinct."""
    ranked = np.sort(hashes)
    if not (ranked[1:] == ranked[:-1]).any():
        return None
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str | None, hasher: WordHasher) -> tuple:
    """The values of COLUMNS for one text; a null text counts as an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, False, 0, 0
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    chars = np.add.reduceat((inside & ((data & 0xC0) != 0x80)).astype(np.int64), starts)
    word_chars, symbols = int(chars.sum()), int(_SYMBOL[data].sum())

    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            parts = line.split()
            if parts:
                lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += sum(len(p.decode("utf-8", "surrogatepass")) for p in parts)
                else:
                    seen.add(line)
    else:
        lines = 1

    repeat = gram_chars = 0
    failed = False
    base = hasher(words)
    rolled = base
    longest = max([REPEAT_WINDOW, *COVERAGE_LIMITS])
    with np.errstate(over="ignore"):
        for k in range(2, longest + 1):
            if n < k:
                break
            rolled = rolled[:-1] * MULT
            rolled ^= rolled >> np.uint64(31)
            rolled += base[k - 1 :]
            if k not in COVERAGE_LIMITS and k != REPEAT_WINDOW:
                continue
            mask = covered(rolled, k, n)
            if mask is None:
                break  # longer n-grams are distinct too
            inside_chars = int(chars[mask].sum())
            if k == min(COVERAGE_LIMITS):
                gram_chars = inside_chars
            if k == REPEAT_WINDOW:
                repeat = int(mask.sum())
            failed |= 100 * inside_chars > COVERAGE_LIMITS.get(k, 100) * word_chars
    failed |= 100 * dup_lines > LINE_LIMIT * lines or 100 * dup_line_chars > LINE_CHAR_LIMIT * word_chars
    failed |= 100 * symbols > SYMBOL_LIMIT * n
    base_failed = n < LEAST_WORDS or 100 * repeat > REPEAT_LIMIT * n
    return n, word_chars, symbols, dup_lines, repeat, base_failed, not (base_failed or failed), dup_line_chars, gram_chars


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id and COLUMNS.

    Null and empty texts have zeros, fail the base rule and are not kept. Repeated rows and
    null ids come back as they are; other columns are ignored; an empty table gives none.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *T.StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = [measure(t, hasher) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in COLUMNS]
            kinds = [pa.bool_() if c in ("base_failed", "kept") else pa.int64() for c in COLUMNS]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", *COLUMNS])

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text the rules keep, with all their columns, in the same partitions."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        kept = COLUMNS.index("kept")
        for batch in batches:
            yield batch.filter(pa.array([measure(t, hasher)[kept] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: DuckDB's form of quality_measures over `documents`.
ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
sizes as (select doc_id, t, w, cast(len(w) as bigint) as n from d),
chars as (select doc_id, cast(sum(length(word)) as bigint) as c from words group by doc_id),
grams as (
  select s.doc_id, g.k, p.i, md5(array_to_string(list_slice(s.w, p.i, p.i + g.k - 1), ' ')) as h
  from sizes s, (select unnest([5, 6, 7, 8, 9, 10]) as k) g, lateral (select unnest(range(1, s.n - g.k + 2)) as i) p),
twice as (select doc_id, k, i from (select *, count(*) over (partition by doc_id, k, h) as c from grams) where c > 1),
marked as (select distinct t.doc_id, t.k, t.i + o.j as i from twice t, lateral (select unnest(range(0, t.k)) as j) o),
cover as (select m.doc_id, m.k, cast(count(*) as bigint) as nw, cast(sum(length(words.word)) as bigint) as nc
  from marked m join words on words.doc_id = m.doc_id and words.i = m.i group by m.doc_id, m.k),
lines as (select doc_id, line, i, row_number() over (partition by doc_id, line order by i) as r,
    length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) as c
  from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) as n_lines, count(*) filter (where r > 1) as n_dup, coalesce(sum(c) filter (where r > 1), 0) as c_dup from lines group by doc_id),
m as (
  select s.doc_id, s.n as n_words, coalesce(c.c, 0) as word_chars,
    cast(length(s.t) - length(regexp_replace(s.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n_dup, 0) as bigint) as n_dup_lines,
    coalesce((select nw from cover where cover.doc_id = s.doc_id and k = 8), 0) as n_repeat_words,
    coalesce(dup.n_lines, 0) as n_lines,
    cast(coalesce(dup.c_dup, 0) as bigint) as dup_line_chars,
    coalesce((select nc from cover where cover.doc_id = s.doc_id and k = 5), 0) as dup_gram_chars,
    exists (select 1 from cover where cover.doc_id = s.doc_id and 100 * nc > (50 - 2 * k) * c.c) as gram_failed
  from sizes s left join chars c on c.doc_id = s.doc_id left join dup on dup.doc_id = s.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or gram_failed or 100 * n_dup_lines > 50 * n_lines
    or 100 * dup_line_chars > 30 * word_chars or 100 * n_symbols > 25 * n_words) as kept,
  dup_line_chars, dup_gram_chars
from m
"""
