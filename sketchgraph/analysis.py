"""The whole reading of drawings: the agents, their fixed order, and one call from images to finished scenes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.config import Settings, load
from sketchgraph.model import Scene
from sketchgraph.operators import control, export, identity, pixels, topology
from sketchgraph.responders import Backend, Registry

#: The agents with what they need, establish and make stale, and the order of a plain run.
AGENTS = {
    "preprocess": ((), ("preprocessed",), ("triaged", "shapes", "connections", "text_regions", "topology", "vlm_analysis", "text_read", "verified")),
    "triage": (("preprocessed",), ("triaged",), ()),
    "shapes": (("preprocessed",), ("shapes",), ("connections", "text_regions", "topology", "verified")),
    "connections": (("shapes",), ("connections",), ("text_regions", "topology", "verified")),
    "text_layout": (("connections",), ("text_regions",), ("text_read", "topology", "verified")),
    "topology": (("shapes",), ("topology",), ()),
    "vlm_analyst": (("text_regions",), ("vlm_analysis",), ()),
    "text_reader": (("text_regions",), ("text_read",), ()),
    "verifier": (("topology",), (), ()),
}
ORDER = ("preprocess", "triage", "shapes", "connections", "text_layout", "topology", "vlm_analyst", "topology", "text_reader", "topology")
#: Parameters of an agent that a planner may set.
PLANNED = {"preprocess": ("rotation",), "shapes": ("relax", "mode", "min_shape_scale", "fit_threshold", "gap_close_scale"), "text_reader": ("force", "ids")}
NEEDS_MODEL = ("vlm_analyst", "text_reader", "verifier")


@dataclass
class Result:
    """Finished scenes, and what was done."""

    scene: Scene
    trace: list[tuple[int, str, str]]
    notes: list[str] = field(default_factory=list)

    def descriptions(self) -> DataFrame:
        return export.graph_texts(self.scene)

    def stats(self) -> DataFrame:
        return topology.stats(self.scene)


def allowed(agent: str, params: dict) -> dict:
    """The parameters of a planner's that an agent takes."""
    return {k: v for k, v in (params or {}).items() if k in PLANNED.get(agent, ())}


def listing(settings: Settings, overrides: dict[str, Backend] | None = None) -> list[str]:
    """A line for each agent: its name, what it needs, and the responder it would use."""
    registry = Registry(settings, overrides)
    out = []
    for name, (needs, gives, _) in AGENTS.items():
        backend = registry.for_agent(name) if name in NEEDS_MODEL else None
        model = f" [{backend.name}]" if backend else " [no responder]" if name in NEEDS_MODEL else ""
        out.append(f"{name}: needs {', '.join(needs) or 'nothing'}, gives {', '.join(gives) or 'corrections'}{model}")
    return out


def stages(settings: Settings, more: dict[str, Callable[[Scene], Scene]] | None = None) -> dict[str, control.Stage]:
    """The agents as stages over a scanned scene; pixel steps have been done by :func:`pixels.scanned`, models come in ``more``."""
    same = lambda s: s
    runs = dict.fromkeys(AGENTS, same) | {"topology": topology.updated} | (more or {})
    return {n: control.Stage(n, runs[n], frozenset(needs), frozenset(gives), frozenset(stale)) for n, (needs, gives, stale) in AGENTS.items()}


def finished(scene: Scene) -> Scene:
    """Compact ids in reading order, and the first line of the description as summary where there is none."""
    scene = identity.renumbered(scene)
    heads = export.description_heads(scene)
    images = scene.images.join(heads, "image_id", "left")
    old = F.col("summary") if "summary" in scene.images.columns else F.lit(None).cast("string")
    return scene.with_(images=images.withColumn("summary", F.coalesce(F.nullif(old, F.lit("")), "line")).drop("line"))


def read_scene(scene: Scene, settings: Settings | None = None, more: dict[str, Callable[[Scene], Scene]] | None = None) -> Result:
    """Topology, model stages where ``more`` has them, and finishing, over scanned scenes."""
    settings = settings or load()
    by_name = stages(settings, more)
    wanted = [n for n in ORDER if n not in NEEDS_MODEL or n in (more or {})]
    scene, progress = control.run_plan([by_name[n] for n in wanted], scene)
    check = (more or {}).get("verifier")
    if check and settings.verifier["enabled"]:
        scene = control.verified(scene, lambda s: (check(s), False), topology.updated, settings.verifier["max_rounds"])
    used = sorted(n for n in NEEDS_MODEL if n in (more or {}))
    return Result(finished(scene), progress.trace, [f"models used by: {', '.join(used) if used else 'none, geometry only'}"])


def analyze(spark: SparkSession, path: str, settings: Settings | None = None, more: dict[str, Callable[[Scene], Scene]] | None = None) -> Result:
    """Read the images of a folder (or one file) and all that is in them."""
    settings = settings or load()
    files = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    numbered = files.withColumn("image_id", F.xxhash64("origin"))
    return read_scene(pixels.scanned_scene(pixels.scanned(numbered, settings.preprocess["max_side"])), settings, more)
