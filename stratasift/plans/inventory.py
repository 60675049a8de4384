"""More of the query catalogue: ordered lists, lookups, tree order, versions, export rows and plugin rules, each with its SQL.

Orders stand for scans, documents for files, events for error rows and keyframes, parts for
assets, suppliers for groups. Registered beside the queries of the catalogue module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratasift.functions import geometry, names
from stratasift.operators import assets, graph, registry
from stratasift.plans.catalogue import QUERIES, query, table, values
from stratasift.rules.exports import EXPORT_FOLDERS, OTHER_FOLDER, OTHER_STATES, STATE_ORDER, TERMINAL_STATES
from stratasift.sources import sinks

# Ordered lists. A relation has no order of its own: the place in the list is a column.


@query("""select o_orderkey, o_orderdate, cast(row_number() over (order by o_orderdate desc, o_orderkey desc) as integer) as place from orders where o_orderstatus in ('O', 'P') and o_orderdate >= (select max(o_orderdate) from orders) - interval 30 day""")
def resumable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished scans, newest first. The list is a report over a month, so one task may number it."""
    o = table(spark, sf_dir, "orders")
    recent = o.crossJoin(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("interval 30 days")).alias("since")))).where("o_orderdate >= since and o_orderstatus in ('O', 'P')")  # one row
    return recent.select("o_orderkey", "o_orderdate", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"))


@query("""select p_type, p_partkey, p_name, cast(row_number() over (partition by p_type order by p_name, p_partkey) as integer) as place from part""")
def assets_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy("p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_name", F.row_number().over(w).alias("place"))


@query("""select user_id, event_id, event_type, cast(row_number() over (partition by user_id order by event_id desc) as integer) as place from events where event_type = 'error' or value is null or value < 5""")
def errors_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error' or value is null or value < 5")
    return e.select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("place"))


@query("""select f.doc_id, f.hash from (select doc_id, sha256(text) as hash from documents where text is not null) f
where f.hash in (select sha256(text) from documents join labels using (doc_id) where text is not null and quality = 0)""")
def files_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    asked = d.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id").select("hash").distinct()
    return d.join(asked, "hash", "left_semi").select("doc_id", "hash")


STATES = [*STATE_ORDER, *OTHER_STATES]


@query(f"""select o_orderkey, s.state, s.rank as rank, s.terminal from orders join (select state, cast(rank as integer) as rank, terminal = 1 as terminal from ({values([(s, n, int(s in TERMINAL_STATES)) for n, s in enumerate(STATES)])}) t(state, rank, terminal)) s on s.rank = o_orderkey % {len(STATES)}""")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each file, its place in the order of states, and whether work on it has ended."""
    known = F.array(*[F.lit(s) for s in STATES])
    state = F.element_at(known, (F.col("o_orderkey") % len(STATES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state")).select("o_orderkey", "state", sinks.state_rank(F.col("state")).alias("rank"), sinks.is_terminal(F.col("state")).alias("terminal"))


# Histograms and lookups


@query("""select source, lang, count(*) as objects, cast(sum(n_chars) as bigint) as bytes from documents group by source, lang""")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each class in a file."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("objects"), F.sum("n_chars").cast("long").alias("bytes"))


_CLASSES = [*EXPORT_FOLDERS, "gizmo"]


@query(f"""select p_partkey, coalesce(folder, '{OTHER_FOLDER}') as folder from (select p_partkey, ([{', '.join(f"'{c}'" for c in _CLASSES)}])[p_partkey % {len(_CLASSES)} + 1] as c from part)
left join ({values(list(EXPORT_FOLDERS.items()))}) t(class, folder) on class = c""")
def export_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("p_partkey") % len(_CLASSES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sinks.export_folder(kind).alias("folder"))


_ENGINES = ["Unity", "Unreal Engine 4", "unreal", "Godot", "RenderWare", None]


@query(f"""select p_partkey, engine, case when engine is not null then 'plugins/' || replace(lower(engine), ' ', '_') when p_size > 25 then 'plugins/<game_name>' else '' end as plugin
from (select p_size, p_partkey, ([{', '.join("null" if e is None else f"'{e}'" for e in _ENGINES)}])[p_partkey % {len(_ENGINES)} + 1] as engine from part)""")
def plugin_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.element_at(F.array(*map(F.lit, _ENGINES)), (F.col("p_partkey") % len(_ENGINES) + 1).cast("int"))
    kind = F.when(F.col("p_size") > 25, "game_container").otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", engine.alias("engine"), registry.suggest_plugin(engine, kind).alias("plugin"))


@query(r"""with v as (select p_partkey, case p_partkey % 5 when 0 then '2018.4.' || p_size || 'f1' when 1 then p_size || '.x.3' when 2 then '5' when 3 then '' else '2020.3b.' || p_size || '.9' end as version from part),
s as (select p_partkey, version, list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(regexp_extract(x, '^[0-9]*') as integer), 0)) as n from v)
select p_partkey, version, coalesce(n[1], 0) as major, coalesce(n[2], 0) as minor, coalesce(n[3], 0) as patch from s""")
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("2018.4."), size, F.lit("f1"))).when(k == 1, F.concat(size, F.lit(".x.3"))).when(k == 2, "5").when(k == 3, "").otherwise(F.concat(F.lit("2020.3b."), size, F.lit(".9")))
    v = table(spark, sf_dir, "part").select("p_partkey", text.alias("version")).withColumn("n", names.version_numbers(F.col("version")))
    return v.select("p_partkey", "version", F.col("n")[0].alias("major"), F.col("n")[1].alias("minor"), F.col("n")[2].alias("patch"))


@query("""select p_partkey, p_brand, s_name as group_name from part left join supplier on s_suppkey = p_partkey""")
def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each character, where it has one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("group_name"))
    return table(spark, sf_dir, "part").join(s, "p_partkey", "left").select("p_partkey", "p_brand", "group_name")


@query("""with n as (select doc_id as node, lang || cast(doc_id % 50 as varchar) as bone from documents), f as (select min(node) as node, bone from n group by bone),
t as (select distinct event_type, case when user_id % 2 = 0 then 'en' else 'xx' end || cast(user_id % 60 as varchar) as bone from events)
select event_type as clip, t.bone, coalesce(node, -1) as node from t left join f on f.bone = t.bone""")
def tracks_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of clips with the node that their bone names; -1 for those that an export drops with a warning."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("bone"))
    side = F.when(F.col("user_id") % 2 == 0, "en").otherwise("xx")
    tracks = table(spark, sf_dir, "events").select(F.col("event_type").alias("clip"), F.concat(side, (F.col("user_id") % 60).cast("string")).alias("bone")).distinct()
    return assets.tracks_to_nodes(tracks, nodes).withColumn("node", F.coalesce("node", F.lit(-1)))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, cast(l_partkey % 7 - 3 as bigint) as ix from lineitem where l_linenumber = 1),
e as (select n_nationkey + 1 as i, n_name as name from nation), m as (select r_regionkey + 1 as i, r_name as name from region)
select l_orderkey, l_partkey, ix, case when ix = 0 then 'None' else coalesce(e.name, m.name, '?') end as parent from r left join e on ix > 0 and e.i = ix left join m on ix < 0 and m.i = -ix""")
def package_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed references: above 0 an export, below 0 an import, 0 none."""
    refs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 7 - 3).cast("long").alias("ix"))
    exports = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("number"), F.col("n_name").alias("name"))
    imports = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("number"), F.col("r_name").alias("name"))
    return assets.resolve_package_index(refs, "ix", exports, imports, "parent")


# Trees


@query("""with recursive n as (select doc_id as id, case when doc_id > 0 then cast(floor((doc_id - 1) / 3) as bigint) end as parent from documents),
w(id, path) as (select id, [id] from n where parent is null union all select n.id, list_append(path, n.id) from w join n on n.parent = w.id)
select id, len(path) - 1 as depth, cast(row_number() over (order by path) as bigint) - 1 as place from w""")
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bone tree in the order it is written: each bone before its children, children by number."""
    n = table(spark, sf_dir, "documents").select(F.lit(0).alias("tree"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 3)).alias("parent"))
    return graph.preorder(n, "tree").select("id", "depth", "place")


@query("""with n as (select doc_id as id, source || cast(doc_id % 40 as varchar) as name, case when doc_id % 10 > 0 then doc_id - doc_id % 10 end as parent from documents where source is not null)
select n.id, n.name, n.parent is null or n.parent not in (select id from n) as is_root, (select count(*) from n c where c.parent = n.id) as children, (select min(id) from n f where f.name = n.name) as first_named from n""")
def bone_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bone is a root, how many children it has, and the first bone of its name."""
    i = F.col("doc_id")
    n = table(spark, sf_dir, "documents").where("source is not null").select(i.alias("id"), F.concat("source", (i % 40).cast("string")).alias("name"), F.when(i % 10 > 0, i - i % 10).alias("parent"))
    return graph.bone_lookups(n)


# Models


@query("""with v as (select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)
select vec_id, round(x * 0.5, 8) as x, round(z * 0.5, 8) as y, round(-y * 0.5, 8) as z, (vec_id // 3) * 3 + case vec_id % 3 when 1 then 2 when 2 then 1 else 0 end as corner from v""")
def model_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model to Z up at half the scale: axes change and one is mirrored, so triangles turn over."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    out = e.select("vec_id", geometry.normalise_vertex(F.col("v"), "z", "right", 0.5).alias("v"), geometry.winding(F.col("vec_id"), "z", "right").alias("corner"))
    return out.select("vec_id", F.round(F.col("v")[0], 8).alias("x"), F.round(F.col("v")[1], 8).alias("y"), F.round(F.col("v")[2], 8).alias("z"), "corner")


# Export


@query(f"""select p_partkey, case when p_partkey % 3 = 0 then false else true end as written, case when p_partkey % 3 = 0 then 'no writer for fbx' end as reason from part""")
def export_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows: formats without a writer give a reason instead of a file."""
    form = F.when(F.col("p_partkey") % 3 == 0, "fbx").when(F.col("p_partkey") % 3 == 1, "glb").otherwise("obj")
    return table(spark, sf_dir, "part").select("p_partkey", sinks.export_problem(form).alias("reason")).select("p_partkey", F.col("reason").isNull().alias("written"), "reason")


@query("""select p_brand as category, p_type as kind, count(*) as items, min(p_name) as first_item from part group by p_brand, p_type""")
def results_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping behind a result tree: category, kind, number of items."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("kind")).agg(F.count("*").alias("items"), F.min("p_name").alias("first_item"))


@query("""select event_type as log, cast(floor(epoch(ts) / 86400) as bigint) as day, count(*) as n, min(event_id) as first_id from events where value < 20 or value is null group by 1, 2""")
def problem_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and refusals as a table by kind and day, in place of rotating log files."""
    e = table(spark, sf_dir, "events").where("value < 20 or value is null")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return e.groupBy(F.col("event_type").alias("log"), day.alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_MANIFESTS = [
    '{"name": "a", "version": "1.0", "api_version": 1, "entrypoint": "plugin.py"}', '{"version": "1.0", "api_version": 1, "entrypoint": "plugin.py"}', '{"name": "a", "version": "1.0", "api_version": 9, "entrypoint": "plugin.py"}',
    '{"name": "", "version": "1.0", "api_version": "x", "entrypoint": "../plugin.py"}', '{"name": "a", "version": "1.0"}',
]


@query(f"""with m as (select p_partkey, ([{', '.join(f"'{j}'" for j in _MANIFESTS)}])[p_partkey % {len(_MANIFESTS)} + 1] as j from part),
f as (select p_partkey, coalesce(json_extract_string(j, 'name'), '') as name, coalesce(json_extract_string(j, 'version'), '') as version, coalesce(json_extract_string(j, 'entrypoint'), '') as entry, coalesce(json_extract_string(j, 'api_version'), '1') as api from m)
select p_partkey, array_to_string(list_filter([case when name = '' then 'missing field: name' end, case when version = '' then 'missing field: version' end, case when entry = '' then 'missing field: entrypoint' end,
  case when not regexp_full_match(api, '[0-9]+') then 'api_version is no number' when cast(api as integer) > 1 then 'asks for interface ' || api end,
  case when entry like '.%' or contains(entry, '/') then 'entrypoint is no plain file name' end], lambda x: x is not null), '; ') as problems from f""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of each plugin manifest."""
    text = F.element_at(F.array(*map(F.lit, _MANIFESTS)), (F.col("p_partkey") % len(_MANIFESTS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(registry.manifest_problems(text), "; ").alias("problems"))
