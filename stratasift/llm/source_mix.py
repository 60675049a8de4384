"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets come from a water-filling of the whole volume over the sources. Each source's
documents, in a pseudo-random order and up to MAX_REPEATS times over, form a stream of
words that is cut into blocks; a source's quota is the stream up to its target. A binary
tree over the output shards then splits the multiset of quota blocks: at each node the
child on the left draws its share of the node's blocks without replacement, which makes
the counts by source multivariate hypergeometric and keeps every quota exact. Inside a
source, the shards' counts take disjoint runs of its permuted blocks; each shard orders
what it holds by a local shuffle key.

Everything is DataFrame code. A source's stream offsets come from sums over MD5 ranges, so
a source that holds most rows is spread over FINE_RANGES groups; nothing sorts a whole
source in one task. Tables by source or by block count have one row a source and block:
the number of blocks is a parameter, not a function of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratasift.llm.common import WORD_PATTERN, materialise

#: Weights by a source's rank in code point order, repeating, and the most times a document is taken.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: MD5 ranges that a source's documents are summed over (three hex digits, 4096), and the number of blocks of a mix.
RANGE_DIGITS = 3
BLOCKS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Water-filling: source, source_size, target, from rows of source and size.

    A source is saturated at MAX_REPEATS times its size when the common level of words a
    weight reaches it. Sources sorted by cap over weight saturate in that order, so the level
    follows from running sums over the sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = ranked.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(MAX_REPEATS) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumns({
        "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(every),
        "weights": F.sum("weight").over(every),
    })
    level = (F.col("total") - F.col("capped_before")) / (F.col("weights") - F.col("weight_before"))
    ranked = ranked.withColumn("own_level", level)
    free = F.col("cap") > F.col("weight") * F.col("own_level")
    ranked = ranked.withColumn("level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("own_level").alias("l")))).over(every).getField("l"))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    return ranked.select("source", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_no, shard, first, n: runs of each source's quota blocks (source_no, n_blocks) by shard.

    The tree starts with one token for each quota block in a node of all shards. At each
    level a node's left child draws its share of the node's tokens without replacement, by a
    hash that differs from level to level: the tokens it gets by source are a multivariate
    hypergeometric sample, and no token is lost or dealt twice. Shards' totals differ by
    about one block. The tokens are as many as the mix has blocks, a parameter.
    """
    tokens = quotas.select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("token"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    width = shards
    while width > 1:
        node = Window.partitionBy("lo", "hi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        drawn = F.row_number().over(node.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "lo", "hi", "source_no", "token")), "source_no", "token"))
        share = F.floor(F.count("*").over(node) * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        tokens = tokens.withColumn("mid", middle).withColumn("left", drawn <= share)
        tokens = tokens.select("source_no", "token", F.when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("left") & (F.col("hi") - F.col("lo") > 1), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        width = -(-width // 2)
    counts = tokens.groupBy("source_no", F.col("lo").alias("shard")).agg(F.count("*").alias("n"))
    return counts.withColumn("first", F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n"))


def mix(docs: DataFrame, shards: int = 16, blocks: int = BLOCKS, seed: int = 1) -> DataFrame:
    """What the mix takes: doc_id, copy, size, source, source_size, target, shard, position, words.

    One row for each piece of a document in a block of the mix, and one row with null shard
    and no words for each document that it leaves out. words sums to the source's rounded
    target exactly; a document comes at most MAX_REPEATS times, and only the last block of a
    source may cut one. Documents without words have size 0 and are left out. Null sources
    form one source, last; a null doc_id counts like any other; repeated rows are documents
    of their own, told apart by copy; an empty table, or one
    without words, takes nothing. Reruns agree.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    d = d.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = materialise(d.withColumn("range", F.substr("key", F.lit(1), F.lit(RANGE_DIGITS))))[0]
    targets = source_targets(d)
    goal = targets.withColumn("goal", F.least(F.round("target").cast("long"), MAX_REPEATS * F.col("source_size")))
    sums = goal.agg(F.sum("goal").alias("all"))
    per_block = F.greatest(F.lit(1), F.ceil(F.col("all") / blocks)).cast("long")
    goal = goal.crossJoin(F.broadcast(sums)).withColumn("per_block", per_block)  # one row of sums
    goal = goal.withColumns({"n_blocks": F.ceil(F.col("goal") / F.col("per_block")).cast("long"), "source_no": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")})
    goal = materialise(goal.drop("all"))[0]

    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).drop("n")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranges = ranges.join(goal, same(ranges, goal)).drop(goal["source"])
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("copy", F.row_number().over(Window.partitionBy("source", "range").orderBy("key", "size")))
    placed = placed.join(ranges, same(placed, ranges) & (placed["range"] == ranges["range"])).drop(ranges["source"]).drop(ranges["range"])
    placed = placed.withColumn("start", F.col("base") + F.col("before"))
    # Passes over the source: the words of pass p start at p * source_size + start of the stream.
    passes = F.transform(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)), lambda p: F.struct((p * F.col("source_size") + F.col("start")).alias("from"), F.least(p * F.col("source_size") + F.col("start") + F.col("size"), F.col("goal")).alias("to")))
    passes = F.filter(passes, lambda x: x["from"] < x["to"])
    first, last = lambda x: F.floor(x["from"] / F.col("per_block")), lambda x: F.floor((x["to"] - 1) / F.col("per_block"))
    pieces = F.flatten(F.transform(passes, lambda x: F.transform(F.sequence(first(x), last(x)), lambda b: F.struct(
        b.cast("long").alias("block"), F.greatest(x["from"], b * F.col("per_block")).alias("at"), (F.least(x["to"], (b + 1) * F.col("per_block")) - F.greatest(x["from"], b * F.col("per_block"))).alias("words")))))
    rows = placed.select("doc_id", "copy", "size", "source", "source_size", "target", "source_no", "n_blocks", F.explode_outer(pieces).alias("piece"))
    rows = rows.select("doc_id", "copy", "size", "source", "source_size", "target", "source_no", "piece.block", "piece.at", "piece.words")

    runs = split_quotas(goal.where("n_blocks > 0").select("source_no", "n_blocks"), shards, seed)
    # A source's blocks in a permuted order: the tree's runs are positions in that order.
    listed = goal.where("n_blocks > 0").select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("source_no").orderBy(F.md5(F.concat_ws(":", F.lit(seed + 1), "source_no", "block")), "block")) - 1)
    drawn = runs.select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("place"))
    block_shards = drawn.join(listed, ["source_no", "place"]).select("source_no", "block", "shard")
    block_shards = materialise(block_shards)[0]  # at most BLOCKS rows and one more a source
    # Documents that are left out have no block: negative ones of many values match nothing and spread them over the tasks.
    spread = F.coalesce("block", -1 - F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)))
    dealt = rows.withColumn("block", spread).join(block_shards, ["source_no", "block"], "left")
    position = F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(seed + 2), "shard", "source_no", "block", "at"))
    dealt = dealt.withColumns({"position": position, "words": F.coalesce("words", F.lit(0).cast("long"))})
    return dealt.select("doc_id", "copy", "size", "source", "source_size", "target", "shard", "position", "words")


def taken_by_document(docs: DataFrame, shards: int = 16, blocks: int = BLOCKS, seed: int = 1) -> DataFrame:
    """One row a document row: doc_id, size, source_size, target, taken, shards, n_pieces. Repeated rows have a row each.

    shards lists the output shards that the splitting tree gives the document's words to,
    comma-joined, in order; n_pieces counts its pieces in their blocks.
    """
    pieces = mix(docs, shards, blocks, seed)
    per = pieces.groupBy("doc_id", "copy", "source", "size").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"), F.array_join(F.transform(F.array_sort(F.collect_set("shard")), lambda x: x.cast("string")), ",").alias("shards"), F.count("shard").alias("n_pieces")
    )
    return per.drop("source", "copy")


def oracle_sql(shards: int = 16, blocks: int = BLOCKS, seed: int = 1) -> str:
    """DuckDB's form of taken_by_document over `documents`, for a number of shards that is a power of two.

    The first recursion saturates sources until none is above its cap; then one step a level of the splitting tree.
    """
    levels, width, n = [], shards, 0
    while width > 1:
        levels.append(
            f"""t{n + 1} as (select no, token, case when l then lo else mid end as lo, case when l then mid else hi end as hi
  from (select *, row_number() over (partition by lo, hi order by md5('{seed}:' || lo || ':' || hi || ':' || no || ':' || token), no, token) <= floor(count(*) over (partition by lo, hi) * (mid - lo) / (hi - lo)) as l
    from (select *, (lo + hi) // 2 as mid from t{n})))"""
        )
        width, n = width // 2, n + 1
    tree = ",\n".join(levels)
    return f"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null')) as key from documents),
s as (select *, ((row_number() over (order by source nulls last) - 1) % 3) + 1 as w, row_number() over (order by source nulls last) as no from (select source, cast(sum(size) as bigint) as n from d group by source)),
fill(step, level) as (
  select 0, cast((select sum(n) from s) as double) / (select sum(w) from s)
  union all
  select step + 1, ((select sum(n) from s) - (select coalesce(sum(3 * n), 0) from s where 3 * n <= w * f.level)) / nullif((select sum(w) from s where 3 * n > w * f.level), 0)
  from fill f where step < 40 and level is not null),
top as (select max(level) as level from fill),
t as (select source, no, n, least(cast(3 * n as double), w * level) as target from s, top),
g0 as (select *, least(cast(round(target) as bigint), 3 * n) as goal from t),
g as (select *, ceil(goal / per_block)::bigint as n_blocks from (select *, greatest(1, ceil((select sum(goal) from g0) / {blocks}))::bigint as per_block from g0)),
t0 as (select no, unnest(range(0, n_blocks)) as token, 0 as lo, {shards} as hi from g),
{tree},
c as (select no, lo as shard, count(*) as n from t{n} group by no, lo),
r as (select *, sum(n) over (partition by no order by shard) as after from c),
b as (select no, block, row_number() over (partition by no order by md5('{seed + 1}:' || no || ':' || block), block) - 1 as place from (select no, unnest(range(0, n_blocks)) as block from g)),
dealt as (select b.no, block, shard from b join r on r.no = b.no and place >= after - r.n and place < after),
p as (select d.*, g.no, g.n, g.target, g.goal, g.per_block, row_number() over () as id, coalesce(sum(d.size) over (partition by d.source order by key, d.size rows between unbounded preceding and 1 preceding), 0) as start
  from d join g on g.source is not distinct from d.source),
passes as (select *, pass * n + start as begun, least(pass * n + start + size, goal) as stop from p, (select unnest(range(0, {MAX_REPEATS})) as pass)),
pieces as (select id, no, unnest(range(begun // per_block, (stop - 1) // per_block + 1)) as block from (select id, no, per_block, cast(begun as bigint) as begun, cast(stop as bigint) as stop from passes where begun < stop)),
found as (select id, array_to_string(list_sort(list(distinct shard)), ',') as shards, count(*) as n_pieces from pieces join dealt on dealt.no = pieces.no and dealt.block = pieces.block group by id)
select doc_id, size, p.n as source_size, target,
  cast(greatest(0, least(start + size, goal) - start) + greatest(0, least(p.n + start + size, goal) - p.n - start) + greatest(0, least(2 * p.n + start + size, goal) - 2 * p.n - start) as bigint) as taken,
  coalesce(shards, '') as shards, coalesce(n_pieces, 0) as n_pieces
from p left join found on found.id = p.id
"""


ORACLE_SQL = oracle_sql()
