"""Rig analysis, classification, similarity joins and grouping of assets, as DataFrame operators."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.functions import names
from stratasift.operators import graph

#: Patterns of bone names by slot of a humanoid skeleton; a slot takes the first bone that any of them matches.
SLOT_PATTERNS = {
    "root": [r"^root$", r"^bip\d*$", r"^armature$", r"^reference$", r"^hips?_?root"],
    "pelvis": [r"pelvis", r"hips?$", r"bip\d*_?pelvis", r"^koshi", r"waist"],
    "spine": [r"spine", r"bip\d*_?spine", r"^abdomen", r"^back", r"^senaka"],
    "chest": [r"chest", r"spine[23]", r"upperchest", r"^mune", r"thorax"],
    "neck": [r"neck", r"bip\d*_?neck", r"^kubi"],
    "head": [r"head$", r"bip\d*_?head", r"^atama"],
    "shoulder_l": [r"(l|left)[_.]?(clavicle|shoulder)", r"clavicle[_.]?l\b", r"shoulder[_.]?l\b"],
    "shoulder_r": [r"(r|right)[_.]?(clavicle|shoulder)", r"clavicle[_.]?r\b", r"shoulder[_.]?r\b"],
    "arm_l": [r"(l|left)[_.]?(upper)?arm", r"arm[_.]?l\b", r"upperarm[_.]?l"],
    "arm_r": [r"(r|right)[_.]?(upper)?arm", r"arm[_.]?r\b", r"upperarm[_.]?r"],
    "forearm_l": [r"(l|left)[_.]?(fore|lower)?arm", r"forearm[_.]?l\b", r"elbow[_.]?l"],
    "forearm_r": [r"(r|right)[_.]?(fore|lower)?arm", r"forearm[_.]?r\b", r"elbow[_.]?r"],
    "hand_l": [r"(l|left)[_.]?hand", r"hand[_.]?l\b", r"wrist[_.]?l"],
    "hand_r": [r"(r|right)[_.]?hand", r"hand[_.]?r\b", r"wrist[_.]?r"],
    "thigh_l": [r"(l|left)[_.]?(up)?leg", r"(l|left)[_.]?thigh", r"thigh[_.]?l\b", r"upleg[_.]?l"],
    "thigh_r": [r"(r|right)[_.]?(up)?leg", r"(r|right)[_.]?thigh", r"thigh[_.]?r\b", r"upleg[_.]?r"],
    "calf_l": [r"(l|left)[_.]?(low)?leg", r"(l|left)[_.]?calf", r"calf[_.]?l\b", r"shin[_.]?l"],
    "calf_r": [r"(r|right)[_.]?(low)?leg", r"(r|right)[_.]?calf", r"calf[_.]?r\b", r"shin[_.]?r"],
    "foot_l": [r"(l|left)[_.]?foot", r"foot[_.]?l\b", r"ankle[_.]?l"],
    "foot_r": [r"(r|right)[_.]?foot", r"foot[_.]?r\b", r"ankle[_.]?r"],
}
CORE_SLOTS = ("pelvis", "spine", "head")
PAIRED_SLOTS = ("arm", "hand", "thigh", "foot")
SIDES = (("left", "right"), ("_l", "_r"), (".l", ".r"), ("l_", "r_"))

#: Hints in an asset's name or path.
HINTS = {
    "weapon": r"(weapon|gun|rifle|pistol|sword|blade|axe|bow|knife|katana)",
    "prop": r"(prop|chair|table|barrel|crate|box|lamp|door|item|pickup)",
    "environment": r"(env|environment|building|terrain|road|wall|floor|tree|rock|level|map)",
    "creature": r"(creature|monster|beast|enemy|zombie|dragon|animal|boss)",
    "npc": r"(npc|villager|citizen|vendor|merchant|guard)",
    "character": r"(char|character|player|hero|pc_|people|human|body|avatar|skin)",
}


def slot_matches(bones: DataFrame) -> DataFrame:
    """(asset, slot, bone) of bones (asset, ix, name, ...): the first bone, by ix, of each slot."""
    tests = F.array_compact(F.array(*[F.when(F.lower("name").rlike("|".join(p)), slot) for slot, p in SLOT_PATTERNS.items()]))
    return bones.select("asset", "ix", "name", F.explode(tests).alias("slot")).groupBy("asset", "slot").agg(F.min_by("name", "ix").alias("bone"))


def rig_scores(bones: DataFrame) -> DataFrame:
    """asset, bone_count, depth, humanoid, rig_score of skeletons (asset, ix, name, parent; -1 or null: a root).

    Names give up to 0.6 by matched slots, the shape up to 0.6 by bone count, depth, branch
    points, unbranched chains and symmetric pairs. Depths and chains come from pointer
    doubling over all skeletons at once.
    """
    b = bones.select("asset", F.col("ix").cast("long").alias("ix"), "name", F.when(F.col("parent") >= 0, F.col("parent")).cast("long").alias("parent"))
    node = b.select(F.struct("asset", "ix").alias("id"), F.when(F.col("parent").isNotNull(), F.struct("asset", F.col("parent").alias("ix"))).alias("parent"))
    counts = b.groupBy("asset").agg(F.count("*").alias("bone_count"))
    depth = graph.depths(node).groupBy(F.col("id.asset").alias("asset")).agg(F.max("depth").alias("depth"))
    children = b.where("parent is not null").groupBy("asset", "parent").agg(F.count("*").alias("n")).groupBy("asset").agg(F.count_if(F.col("n") >= 2).alias("branches"))
    chains = graph.chains(node).groupBy(F.col("id.asset").alias("asset")).agg(F.count_if(F.col("length") >= 3).alias("chains"))
    low = b.select("asset", F.lower("name").alias("name"))
    sides = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in SIDES])
    partner = low.select("asset", "name", F.explode(sides).alias("s")).where(F.expr("contains(name, s.a)")).select("asset", "name", F.replace("name", F.col("s.a"), F.col("s.b")).alias("other"))
    pairs = partner.join(low.select("asset", F.col("name").alias("other")), ["asset", "other"], "left_semi").select("asset", "name").distinct().groupBy("asset").agg(F.count("*").alias("pairs"))
    slots = slot_matches(b).groupBy("asset").agg(F.collect_set("slot").alias("slots"))
    r = reduce(lambda x, y: x.join(y, "asset", "left"), [depth, children, chains, pairs, slots], counts).fillna(0, ["branches", "chains", "pairs"])
    r = r.withColumn("slots", F.coalesce("slots", F.array().cast("array<string>")))
    shape = F.when(F.col("bone_count").between(15, 400), 0.25).when(F.col("bone_count") > 8, 0.1).otherwise(0.0)
    for test, weight in ((F.col("depth") >= 5, 0.2), (F.col("branches") >= 3, 0.2), (F.col("chains") >= 4, 0.25), (F.col("pairs") >= 4, 0.1)):
        shape = shape + F.when(test, weight).otherwise(0.0)
    has = lambda s: F.array_contains("slots", s).cast("int")
    core = sum((has(s) for s in CORE_SLOTS), F.lit(0))
    limbs = sum((has(f"{s}_l") * has(f"{s}_r") for s in PAIRED_SLOTS), F.lit(0))
    score = F.least(F.lit(1.0), 0.6 * F.size("slots") / len(SLOT_PATTERNS) + 0.6 * shape)
    return r.select("asset", "bone_count", "depth", (((core >= 2) & (limbs >= 2)) | (score >= 0.72)).alias("humanoid"), score.alias("rig_score"))


def classify(name: Column, path: Column, skinned: Column, humanoid: Column, bones: Column, clips: Column, textures: Column, triangles: Column, meshes: Column) -> Column:
    """struct(classification, confidence): ordered predicates, the first that holds."""
    text = F.lower(F.concat_ws(" ", name, path))
    hint = lambda kind: text.rlike(HINTS[kind])
    add = lambda test, weight: F.when(test, weight).otherwise(0.0)
    score = add(skinned, 0.35) + F.when(humanoid, 0.35).when(bones >= 8, 0.15).otherwise(0.0) + add(clips > 0, 0.1) + add(textures > 0, 0.05) + add(hint("character"), 0.15)
    made = lambda kind, confidence: F.struct(F.lit(kind).alias("classification"), F.least(F.lit(confidence[0]), score + confidence[1]).alias("confidence") if isinstance(confidence, tuple) else F.lit(confidence).alias("confidence"))
    return (
        F.when(hint("npc") & (score >= 0.4), made("npc", (0.97, 0.0))).when(hint("creature") & (skinned | (bones >= 6)), made("creature", (0.95, 0.1))).when(score >= 0.6, made("character", (0.98, 0.0)))
        .when(skinned & (bones >= 6), made("creature", (0.8, 0.15))).when(hint("weapon"), made("weapon", 0.7)).when(hint("environment") | ((triangles > 200_000) & ~skinned), made("environment", 0.55))
        .when(hint("prop"), made("prop", 0.6)).when(meshes > 0, made("prop", 0.35)).otherwise(made("unknown", 0.2))
    )


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard plus 0.1 where tokens are shared, else 0.8 of the matching-block ratio of the lower-case stems (an Arrow UDF)."""
    tokens = names.token_similarity(names.name_tokens(a), names.name_tokens(b))
    ratio = F.pandas_udf(_ratios, "double")(F.lower(names.stem(a)), F.lower(names.stem(b)))
    return F.when(tokens > 0, tokens).otherwise(0.8 * ratio)


def match_animations(models: DataFrame, clips: DataFrame, least: float = 0.5) -> DataFrame:
    """(model, clip, score) of models (model, name, path, bones) and clips (clip, name, path, tracks) with a score of `least` or more.

    0.8 of the tracks' share of bones, 0.3 of path proximity, 0.3 of name similarity. A pair
    with no shared bone, name token or first folder stays under 0.24, so those are lossless
    keys of a hash join; no cross join is made.
    """

    def keyed(df: DataFrame, bones: str) -> DataFrame:
        root = F.when(F.contains("path", F.lit("/")), F.array(F.concat(F.lit("p:"), F.lower(F.substring_index("path", "/", 1))))).otherwise(F.array().cast("array<string>"))
        keys = F.concat(F.transform(F.coalesce(bones, F.array().cast("array<string>")), lambda x: F.concat(F.lit("b:"), F.lower(x))), F.transform(names.name_tokens(F.col("name")), lambda x: F.concat(F.lit("t:"), x)), root)
        return df.withColumn("key", F.explode(F.array_distinct(keys)))

    pairs = keyed(models, "bones").select("model", "key").join(keyed(clips, "tracks").select("clip", "key"), "key").select("model", "clip").distinct()
    m = models.select("model", F.col("name").alias("mn"), F.col("path").alias("mp"), F.transform("bones", F.lower).alias("bones"))
    c = clips.select("clip", F.col("name").alias("cn"), F.col("path").alias("cp"), F.array_distinct(F.transform("tracks", F.lower)).alias("tracks"))
    j = pairs.join(m, "model").join(c, "clip")
    overlap = F.coalesce(F.size(F.array_intersect("bones", "tracks")) / F.greatest(F.lit(1), F.size("tracks")), F.lit(0.0))
    score = F.least(F.lit(1.0), 0.8 * overlap + 0.3 * names.path_proximity(F.col("mp"), F.col("cp")) + 0.3 * name_similarity(F.col("mn"), F.col("cn")))
    return j.select("model", "clip", score.alias("score")).where(F.col("score") >= least)


def group_confidence(models: DataFrame, animations: DataFrame, textures: DataFrame, least: float = 0.45) -> DataFrame:
    """(model, animations, textures, confidence): the asset's confidence, more with members, 0.99 at most."""
    n = lambda df, c: df.groupBy("model").agg(F.collect_set(c).alias(c))
    g = models.select("model", "confidence").join(n(animations, "clip"), "model", "left").join(n(textures, "texture"), "model", "left")
    extra = F.when(F.size("clip") > 0, 0.05).otherwise(0.0) + F.when(F.size("texture") > 0, 0.03).otherwise(0.0)
    return g.select("model", F.sort_array("clip").alias("animations"), F.sort_array("texture").alias("textures"), F.least(F.lit(0.99), F.col("confidence") + extra).alias("confidence")).where(F.col("confidence") >= least)


def bones_of(spark: SparkSession, rows: list[tuple[str, list[tuple[str, int]]]]) -> DataFrame:
    """A bones table from (asset, [(name, parent), ...])."""
    return spark.createDataFrame([(a, i, n, p) for a, bones in rows for i, (n, p) in enumerate(bones)], "asset string, ix long, name string, parent long")
