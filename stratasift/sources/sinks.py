"""Sinks: manifests, reports, renamed copies and keyed tables."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratasift.rules.exports import EXPORT_FOLDERS, OTHER_FOLDER, OTHER_STATES, STATE_ORDER, TERMINAL_STATES, WRITERS


def manifests(assets: DataFrame) -> DataFrame:
    """One JSON text an asset, keys in the columns' order."""
    return assets.select(F.col(assets.columns[0]), F.to_json(F.struct(*assets.columns)).alias("manifest"))


def unique_names(files: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Repeated names in a folder get `_02`, `_03` and so on before the extension, by `order`."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    base, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    number = F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    return files.withColumn("target", F.when(n == 1, F.col(name)).otherwise(F.concat(base, F.lit("_"), number, ext)))


def upsert(target: DataFrame | None, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table after an insert-or-replace: the last change of each key wins, by `order`."""
    both = changes if target is None else target.unionByName(changes)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def insert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table after an insert-or-ignore."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(target.columns))


def report(counts: dict[str, int], unsupported: DataFrame, errors: DataFrame, most: int = 500) -> tuple[str, str]:
    """report.json and report.html texts; lists are cut to their first `most` rows by path, the counts are whole."""
    take = lambda df: [r.asDict() for r in df.orderBy(*df.columns).limit(most).collect()]
    body = {"counts": counts, "unsupported": take(unsupported), "errors": take(errors)}
    cells = lambda r: "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values())
    tables = "".join(f"<h2>{k}</h2><table>{''.join(f'<tr>{cells(r)}</tr>' for r in body[k])}</table>" for k in ("unsupported", "errors"))
    items = "".join(f"<li>{html.escape(k)}: {v}</li>" for k, v in counts.items())
    return json.dumps(body, indent=2, default=str), f"<!DOCTYPE html><title>Scan report</title><ul>{items}</ul>{tables}"


def state_rank(state: Column) -> Column:
    """A state's place in the order of states; those beside it follow."""
    return F.array_position(F.array(*map(F.lit, [*STATE_ORDER, *OTHER_STATES])), state).cast("int") - 1


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)


def export_folder(classification: Column) -> Column:
    folders = F.create_map(*[F.lit(x) for kv in EXPORT_FOLDERS.items() for x in kv])
    return F.coalesce(folders[classification], F.lit(OTHER_FOLDER))


def export_problem(form: Column) -> Column:
    """Why a format is not written; null where it is."""
    return F.when(~form.isin(WRITERS), F.concat(F.lit("no writer for "), form))


#: The keys of an asset's manifest, in order.
MANIFEST_KEYS = [
    "name", "source", "format", "engine", "asset_type", "confidence", "mesh", "vertices", "triangles", "skinned", "bones", "skeleton", "coordinate_system", "original_coordinate_system",
    "unit_scale", "animations", "textures", "validation", "classification_evidence", "group_confidence", "generated",
]


def asset_manifests(assets: DataFrame, key: str) -> DataFrame:
    """(key, manifest): JSON of MANIFEST_KEYS; columns that assets lacks are null there, an engine that is not known is "Unknown"."""
    value = {c: F.col(c) if c in assets.columns else F.lit(None).cast("string") for c in MANIFEST_KEYS}
    value["engine"] = F.coalesce(value["engine"], F.lit("Unknown"))
    value["asset_type"] = F.lower(value["asset_type"])
    for c in ("confidence", "group_confidence"):
        value[c] = F.round(value[c].cast("double"), 3)
    return assets.select(key, F.to_json(F.struct(*[value[c].alias(c) for c in MANIFEST_KEYS]), {"ignoreNullFields": "false"}).alias("manifest"))
