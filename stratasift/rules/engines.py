"""Weighted evidence of game engines, and the hints of names."""

from __future__ import annotations

#: Engine, kind (file, dir, suffix, prefix), needle, weight.
ENGINE_RULES = [
    ("Unity", "file", "globalgamemanagers", 0.5),
    ("Unity", "file", "resources.assets", 0.35),
    ("Unity", "file", "unityplayer.dll", 0.4),
    ("Unity", "dir", "il2cpp_data", 0.3),
    ("Unity", "file", "level0", 0.2),
    ("Unity", "suffix", ".assets", 0.2),
    ("Unity", "suffix", ".bundle", 0.1),
    ("Unity", "suffix", ".unity3d", 0.25),
    ("Unreal", "suffix", ".uasset", 0.4),
    ("Unreal", "suffix", ".umap", 0.3),
    ("Unreal", "suffix", ".pak", 0.1),
    ("Unreal", "suffix", ".utoc", 0.35),
    ("Unreal", "dir", "engine", 0.15),
    ("Unreal", "dir", "paks", 0.2),
    ("Source", "file", "gameinfo.txt", 0.5),
    ("Source", "suffix", ".vpk", 0.3),
    ("Source", "suffix", ".bsp", 0.2),
    ("Source", "suffix", ".vtf", 0.25),
    ("Source", "suffix", ".mdl", 0.15),
    ("Godot", "file", "project.godot", 0.6),
    ("Godot", "suffix", ".pck", 0.3),
    ("Godot", "suffix", ".tscn", 0.3),
    ("CryEngine", "file", "system.cfg", 0.3),
    ("CryEngine", "suffix", ".pak", 0.05),
    ("CryEngine", "suffix", ".cgf", 0.4),
    ("CryEngine", "suffix", ".caf", 0.3),
    ("RenderWare", "suffix", ".dff", 0.45),
    ("RenderWare", "suffix", ".txd", 0.4),
    ("RenderWare", "suffix", ".ifp", 0.2),
    ("id Tech", "suffix", ".pk3", 0.35),
    ("id Tech", "suffix", ".pk4", 0.35),
    ("id Tech", "suffix", ".bsp", 0.1),
    ("GameMaker", "file", "data.win", 0.6),
    ("GameMaker", "file", "game.unx", 0.5),
    ("Frostbite", "suffix", ".cas", 0.5),
    ("Frostbite", "suffix", ".sb", 0.4),
    ("Frostbite", "suffix", ".toc", 0.3),
    ("Frostbite", "file", "cas.cat", 0.6),
    ("Anvil", "suffix", ".forge", 0.6),
    ("Anvil", "file", "datapc.forge", 0.5),
    ("CRI Middleware", "suffix", ".afs", 0.5),
    ("CRI Middleware", "suffix", ".adx", 0.3),
    ("PS2", "file", "system.cnf", 0.35),
    ("PS2", "prefix", "slus_", 0.2),
    ("PS1", "file", "psx.exe", 0.4),
    ("PS1", "prefix", "slus_", 0.35),
    ("PS1", "prefix", "sces_", 0.35),
]
#: Share of a suffix rule's weight, most repeats counted, weight of a `*_data` folder, cap and least score.
SUFFIX_SHARE, MOST_REPEATS, DATA_FOLDER, CAP, LEAST = 0.6, 3, 0.35, 0.99, 0.2

#: Words that tell nothing about an asset's name.
NAME_NOISE = "mesh model skin skinned lod lod0 lod1 sk sm char character body final export anim animation clip tex texture diffuse albedo normal base color d n s".split()

#: Names that Windows reserves for devices.
DEVICE_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
