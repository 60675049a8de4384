"""Extension points: ordered registries of detectors, extractors, parsers and exporters, and plugin manifests.

A registered thing is any callable; the first that accepts an item, by priority and then by
age, handles it. Tasks use a registry as it was when the job started, since it travels with
the function that reads it.
"""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratasift.rules.exports import API_VERSION, MANIFEST_FIELDS

#: Kinds of things that a plugin may add.
KINDS = ("detector", "extractor", "model_parser", "texture_parser", "animation_parser", "exporter", "game_profile", "compression_codec")


class Registry:
    """Things of one kind: higher priority first, older first among equals."""

    def __init__(self, kind: str):
        self.kind, self._held = kind, []

    def add(self, thing, priority: int | None = None):
        self._held.append((getattr(thing, "priority", 50) if priority is None else priority, len(self._held), thing))
        return thing

    def __iter__(self) -> Iterator:
        return (thing for *_, thing in sorted(self._held, key=lambda x: (-x[0], x[1])))

    def __len__(self) -> int:
        return len(self._held)

    def first(self, accepts: Callable[[object], bool]):
        """The first thing that accepts, or None."""
        return next((t for t in self if accepts(t)), None)

    def clear(self) -> None:
        self._held.clear()


REGISTRIES = {kind: Registry(kind) for kind in KINDS}


def register(kind: str, priority: int | None = None) -> Callable:
    """Decorator: an instance of the class, or the function itself, joins the registry of its kind."""

    def wrap(made):
        REGISTRIES[kind].add(made() if isinstance(made, type) else made, priority)
        return made

    return wrap


class PluginInterface:
    """What a plugin's register(api) is handed."""

    version = API_VERSION

    def __init__(self, plugin: str):
        self.plugin = plugin

    def __getattr__(self, name: str) -> Callable:
        kind = name.removeprefix("add_")
        if name.startswith("add_") and kind in REGISTRIES:
            return REGISTRIES[kind].add
        raise AttributeError(name)


def summary() -> dict[str, list[str]]:
    return {kind: [getattr(t, "name", getattr(t, "__name__", type(t).__name__)) for t in r] for kind, r in REGISTRIES.items()}


def plugin_problems(folder: str | Path, largest: int = 64 << 20) -> list[str]:
    """What keeps a plugin folder from being loaded; nothing of it is run."""
    folder = Path(folder)
    manifest, out = folder / "plugin.json", []
    if not folder.is_dir():
        return [f"{folder} is no folder"]
    if not manifest.exists():
        return ["plugin.json is missing"]
    try:
        found = json.loads(manifest.read_text(encoding="utf-8"))
    except ValueError:
        return ["plugin.json is no JSON"]
    out += [f"missing field: {k}" for k in MANIFEST_FIELDS if not found.get(k)]
    asked = str(found.get("api_version", 1))
    if not asked.isdigit():
        out.append("api_version is no number")
    elif int(asked) > API_VERSION:
        out.append(f"asks for interface {asked}, this is {API_VERSION}")
    entry = str(found.get("entrypoint", "plugin.py"))
    if re.search(r"^\.|[/\\]", entry):
        out.append("entrypoint is no plain file name")
    elif not (folder / entry).exists():
        out.append(f"entrypoint {entry} is missing")
    elif not re.search(r"^def register\s*\(", (folder / entry).read_text(encoding="utf-8", errors="replace"), re.M):
        out.append(f"{entry} has no register(api)")
    if sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) > largest:
        out.append(f"larger than {largest >> 20} MB")
    return out


def load_plugins(folder: str | Path) -> dict[str, list[str]]:
    """Load each sound plugin below a trusted folder; plugin name to its problems. A plugin that fails leaves the others."""
    out = {}
    for path in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        out[path.name] = plugin_problems(path)
        if not out[path.name]:
            try:
                entry = json.loads((path / "plugin.json").read_text(encoding="utf-8"))["entrypoint"]
                spec = importlib.util.spec_from_file_location(f"stratasift_plugin_{path.name}", path / entry)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                module.register(PluginInterface(path.name))
            except Exception as e:
                out[path.name] = [f"failed: {e}"]
    return out


def suggest_plugin(engine: Column, category: Column) -> Column:
    """The folder of a plugin that could open an unsupported file; empty where nothing is known."""
    low = F.lower(F.coalesce(engine, F.lit("")))
    return F.when(low != "", F.concat(F.lit("plugins/"), F.replace(low, F.lit(" "), F.lit("_")))).when(category == "game_container", "plugins/<game_name>").otherwise("")


def manifest_problems(manifest: Column) -> Column:
    """Problems of a manifest's text, in order: fields, interface version, entry name."""
    parsed = F.from_json(manifest, "name string, version string, api_version string, entrypoint string")
    missing = [F.when(F.coalesce(parsed[k], F.lit("")) == "", f"missing field: {k}") for k in MANIFEST_FIELDS]
    asked = F.coalesce(parsed["api_version"], F.lit("1"))
    version = F.when(~asked.rlike("^[0-9]+$"), "api_version is no number").when(asked.cast("int") > API_VERSION, F.concat(F.lit("asks for interface "), asked))
    entry = F.when(F.coalesce(parsed["entrypoint"], F.lit("plugin.py")).rlike(r"^\.|[/\\]"), "entrypoint is no plain file name")
    return F.array_compact(F.array(*missing, version, entry))
