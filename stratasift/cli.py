"""Command line: scan, extract, detect, inspect, formats. Exit codes: 0 done, 1 error, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from stratasift.operators import relational
from stratasift.rules.engines import ENGINE_RULES
from stratasift.rules.signatures import SIGNATURES
from stratasift.session import build_session
from stratasift.sources import archives, exports, images, models, scan, sinks


def _scan(spark, a) -> dict:
    files = scan.read_files(spark, a.path, a.max_bytes)
    whole, problems = scan.expand(spark, files, a.max_depth, work_dir=a.work or str(Path(a.out or ".").resolve() / "work"))
    found = scan.detect(spark, whole)
    parsed = models.parse_models(whole)
    owners = relational.duplicate_owners(whole.select("virtual_path", "hash"), "hash", "virtual_path")
    counts = {
        "files": files.count(), "items": whole.count(), "containers": found.where(scan.is_container(F.col("category"))).count(), "models": parsed.where("error is null").count(), "textures": images.image_headers(whole).count(),
        "failed": parsed.where("error is not null").count(), "duplicates": owners.where("is_duplicate").count(), "unsupported": problems.count(),
    }
    if a.out:
        errors = files.where("error is not null").select("virtual_path", F.col("error").alias("reason")).unionByName(parsed.where("error is not null").select("virtual_path", F.col("error").alias("reason")))
        text, page = sinks.report(counts, problems, errors)
        Path(a.out).mkdir(parents=True, exist_ok=True)
        Path(a.out, "report.json").write_text(text)
        Path(a.out, "report.html").write_text(page)
    if a.verb == "extract":
        repeated = owners.where("is_duplicate").select("virtual_path")
        rows = whole.join(repeated, "virtual_path", "left_anti").select("virtual_path", "content")
        exports.export_models(rows, a.format.split(",")).write.mode("overwrite").parquet(str(Path(a.out, "exports.parquet")))
    return counts


def _detect(spark, a) -> dict:
    names = scan.read_files(spark, a.path).select(F.lit("all").alias("scope"), F.regexp_replace("virtual_path", "/?[^/]*$", "").alias("folder"), F.substring_index("virtual_path", "/", -1).alias("name"))
    rules = spark.createDataFrame(ENGINE_RULES, "engine string, kind string, needle string, weight double")
    return {r.engine: {"confidence": round(r.confidence, 4), "evidence": r.evidence[:12]} for r in relational.engine_scores(names, rules).orderBy(F.desc("confidence"), "engine").collect()}


def _inspect(spark, a) -> dict:
    return {r.virtual_path: r.asDict() for r in scan.detect(spark, scan.read_files(spark, a.path)).collect()}


def _formats(spark, a) -> dict:
    return {"signatures": sorted({r[1] for r in SIGNATURES}), "containers": sorted(archives.READERS), "unsupported": archives.UNSUPPORTED, "models": sorted(models.BY_EXTENSION)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratasift", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("scan", "extract", "detect", "inspect"):
        v = verbs.add_parser(verb)
        v.add_argument("path")
        v.add_argument("--out", default="out" if verb == "extract" else None)
        v.add_argument("--work")
        v.add_argument("--format", default="glb", help="export formats, comma-joined")
        v.add_argument("--max-depth", type=int, default=10)
        v.add_argument("--max-bytes", type=int)
    verbs.add_parser("formats")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run = {"scan": _scan, "extract": _scan, "detect": _detect, "inspect": _inspect, "formats": _formats}[a.verb]
        print(json.dumps(run(None if a.verb == "formats" else build_session("stratasift"), a), indent=2, default=str))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
