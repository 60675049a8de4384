"""Relational operators of the inventory: duplicates, cascades, budgets, resume, upserts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratasift.rules.engines import DATA_FOLDER


def duplicate_owners(files: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the smallest `order` of its content key as owner, and whether it is a copy.

    A partial minimum by key is joined back, so that a key of many rows is neither sorted nor gathered.
    """
    owners = files.groupBy(key).agg(F.min(order).alias("owner"), F.count("*").alias("copies"))
    return files.join(owners, key).withColumn("is_duplicate", F.col(order) > F.col("owner"))


def best_candidate(candidates: DataFrame, key: str, early_stop: float | None = 0.95) -> DataFrame:
    """Arg-max cascade over (key, rank, confidence, ...): the strictly greatest confidence wins, ties the lower rank.

    With early_stop, candidates ranked after the first that reaches it are not looked at.
    """
    fields = [c for c in candidates.columns if c != key]
    if early_stop is not None:
        first = candidates.where(F.col("confidence") >= early_stop).groupBy(key).agg(F.min("rank").alias("stop"))
        candidates = candidates.join(first, key, "left").where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop")))
    best = candidates.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("confidence", -F.col("rank"))).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in fields])


def within_budget(members: DataFrame, container: str, order: list[str], size: str, max_entries: int, max_bytes: int, max_ratio: float | None = None, packed: str | None = None, ratio_from: int = 64 << 20) -> DataFrame:
    """Members of each container before the first that breaks a limit on entries, bytes or, past ratio_from, expansion."""
    running = Window.partitionBy(container).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    m = members.withColumns({"entry_no": F.row_number().over(Window.partitionBy(container).orderBy(*order)), "bytes_so_far": F.sum(size).over(running)})
    broken = (F.col("entry_no") > max_entries) | (F.col("bytes_so_far") > max_bytes)
    if max_ratio is not None and packed:
        broken |= (F.col("bytes_so_far") > ratio_from) & (F.col("bytes_so_far") > F.col(packed) * max_ratio)
    m = m.withColumn("broken", F.max(broken.cast("int")).over(running))
    return m.where("broken = 0").drop("broken")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keyed latest-wins: the last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been finished: an anti join."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def cached_or(detected: DataFrame, cache: DataFrame, keys: list[str], value: str, fresh: Column) -> DataFrame:
    """`value` from the cache where its keys hit, otherwise computed."""
    joined = detected.join(cache.select(*keys, F.col(value).alias("cached_value")), keys, "left")
    return joined.withColumn("hit", F.col("cached_value").isNotNull()).withColumn(value, F.coalesce("cached_value", fresh)).drop("cached_value")


def interpolate(keys: DataFrame, track: str, time: str, value: str, samples: DataFrame, at: str) -> DataFrame:
    """Linear as-of interpolation of keyframes at sample times, held at both ends.

    samples has (track, at). Keys and samples of a track are sorted once together; the key
    before and the key after each sample come from two window fills, not from a range join.
    """
    both = keys.select(track, F.col(time).alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("kind"))
    both = both.unionByName(samples.select(track, F.col(at).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")))
    key = F.when(F.col("kind") == 0, F.struct("t", "v"))
    before = F.last(key, ignorenulls=True).over(Window.partitionBy(track).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(key, ignorenulls=True).over(Window.partitionBy(track).orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing))
    s = both.withColumns({"b": before, "a": after}).where("kind = 1")
    share = (F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    v = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull() | (F.col("a.t") == F.col("b.t")), F.col("b.v")).otherwise(F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share)
    return s.select(track, F.col("t").alias(at), v.alias(value))


def engine_scores(files: DataFrame, rules: DataFrame, least: float = 0.2, cap: float = 0.99, repeats: int = 3) -> DataFrame:
    """Engines by weighted evidence: (scope, folder tokens, name) rows against (engine, kind, needle, weight) rules.

    Names are reduced to (scope, name) and (scope, folder token) counts before the rule table,
    a broadcast of some dozens of rows, meets them. The n-th repeat of the same evidence weighs
    a n-th of the first, up to `repeats`.
    """
    r = F.broadcast(rules)
    names = files.groupBy("scope", "name").agg(F.count("*").alias("n"))
    low = F.lower("name")
    by_name = names.join(r, ((F.col("kind") == "file") & (low == F.col("needle"))) | ((F.col("kind") == "suffix") & low.endswith(F.col("needle"))) | ((F.col("kind") == "prefix") & low.startswith(F.col("needle"))))
    note = F.when(F.col("kind") == "suffix", F.concat(F.lit("ext:"), "needle")).when(F.col("kind") == "file", F.concat(F.lit("file:"), "name")).otherwise(F.concat(F.lit("name:"), "name"))
    by_name = by_name.select("scope", "engine", note.alias("note"), F.when(F.col("kind") == "suffix", F.col("weight") * 0.6).otherwise(F.col("weight")).alias("weight"), "n")
    folders = files.select("scope", "folder").distinct()
    tokens = folders.select("scope", "folder", F.explode(F.array_distinct(F.split(F.lower("folder"), "/"))).alias("token"))
    by_folder = tokens.join(r, (F.col("kind") == "dir") & (F.col("token") == F.col("needle"))).select("scope", "engine", F.concat(F.lit("dir:"), "needle").alias("note"), "weight", F.lit(1).cast("long").alias("n"))
    data = tokens.where(F.col("token").endswith("_data")).select("scope", F.lit("Unity").alias("engine"), F.concat(F.lit("dir:"), "token").alias("note"), F.lit(DATA_FOLDER).alias("weight"), F.lit(1).cast("long").alias("n"))
    hits = by_name.unionByName(by_folder).unionByName(data).groupBy("scope", "engine", "note").agg(F.max("weight").alias("weight"), F.sum("n").alias("n"))
    harmonic = F.when(F.col("n") >= 3, 1 + 1 / 2 + 1 / 3).when(F.col("n") == 2, 1.5).otherwise(1.0) if repeats == 3 else F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(repeats)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)
    scored = hits.groupBy("scope", "engine").agg(F.least(F.lit(cap), F.sum(F.col("weight") * harmonic)).alias("confidence"), F.array_sort(F.collect_set("note")).alias("evidence"))
    return scored.where(F.col("confidence") >= least)


#: Members of a class that one row carries.
BLOCK = 1024


def member_blocks(members: DataFrame) -> DataFrame:
    """(cls, block) of members (cls, id): their ids in arrays of about BLOCK, so that a large class is several rows."""
    sizes = members.groupBy("cls").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = members.join(sizes, "cls").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return cut.groupBy("cls", "b").agg(F.collect_list("id").alias("block")).drop("b")


def pairs_of_members(classes: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, score) for all members i and j of each pair (x, y, score) of classes; left and right are member_blocks.

    Only blocks are joined and dealt, each pair of them to any task; the pairs of members are
    made last, where they are read, and never shuffled.
    """
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.sparkSession.sparkContext.defaultParallelism)
    both = classes.join(left.select(F.col("cls").alias("x"), F.col("block").alias("p")), "x").join(right.select(F.col("cls").alias("y"), F.col("block").alias("q")), "y")
    dealt = both.select("p", "q", "score").repartition(4 * parts, F.xxhash64("p", "q"))
    return dealt.select(F.explode("p").alias("i"), "q", "score").select("i", F.explode("q").alias("j"), "score")
