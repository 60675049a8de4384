"""Tables of states, export folders, axes and plugin manifests that results must agree with."""

#: States of a file in their order; those beside the order; those where work has ended.
STATE_ORDER = ["discovered", "identified", "queued", "extracting", "parsing", "validating", "converting", "exporting", "completed"]
OTHER_STATES = ["failed", "skipped", "unsupported"]
TERMINAL_STATES = ["completed", "failed", "skipped", "unsupported"]

#: Folders of an export by classification; what has none goes to OTHER_FOLDER.
EXPORT_FOLDERS = {
    "character": "Characters",
    "npc": "Characters",
    "creature": "Characters",
    "weapon": "Props",
    "prop": "Props",
    "environment": "Environment",
    "unknown": "Models",
}
OTHER_FOLDER = "Models"
#: Export formats that have a writer.
WRITERS = ["glb", "gltf", "obj", "dae"]

#: The source axis and sign of each axis of a coordinate system, from Y up and right-handed.
AXES = {
    ("y", "right"): ((0, 1), (1, 1), (2, 1)),
    ("y", "left"): ((0, 1), (1, 1), (2, -1)),
    ("z", "right"): ((0, 1), (2, 1), (1, -1)),
    ("z", "left"): ((0, 1), (2, 1), (1, 1)),
}

#: Fields that a plugin's manifest must have, and the newest interface it may ask for.
MANIFEST_FIELDS = ("name", "version", "entrypoint")
API_VERSION = 1
