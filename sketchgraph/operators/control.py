"""The order of work: stages and what they need, the planner's state machine, reading batches, responders."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchgraph.model import Scene

#: Texts read of one drawing at most, and texts in one request.
READ_MOST, BATCH = 150, 6
_PLACES = {"inside": 0, "near": 1, "on_line": 1, "free": 2}


@dataclass(frozen=True)
class Stage:
    """A step over scenes: it runs once all of ``requires`` are facts, adds ``provides`` and takes ``invalidates`` away."""

    name: str
    run: Callable[[Scene], Scene]
    requires: frozenset[str] = frozenset()
    provides: frozenset[str] = frozenset()
    invalidates: frozenset[str] = frozenset()


@dataclass
class Progress:
    """Facts established so far and a line for each step taken.

    ``settle`` works a step's scene out (by writing its tables, say), so that what fails in execution fails in its own step.
    """

    facts: set[str] = field(default_factory=set)
    trace: list[tuple[int, str, str]] = field(default_factory=list)
    settle: Callable[[Scene], Scene] | None = None

    def ready(self, stage: Stage) -> bool:
        return "stop" not in self.facts and stage.requires <= self.facts

    def take(self, stage: Stage, scene: Scene) -> Scene:
        """Run a stage; one that fails or is not ready is noted and skipped."""
        step = len(self.trace) + 1
        if not self.ready(stage):
            self.trace.append((step, stage.name, "not ready"))
            return scene
        try:
            after = stage.run(scene)
            scene = self.settle(after) if self.settle else after
        except Exception as error:  # noqa: BLE001  a stage's failure must not end the others
            self.trace.append((step, stage.name, f"failed: {type(error).__name__}"))
            return scene
        self.facts = (self.facts - stage.invalidates) | stage.provides
        self.trace.append((step, stage.name, "done"))
        return scene


def run_plan(stages: Iterable[Stage], scene: Scene, settle: Callable[[Scene], Scene] | None = None) -> tuple[Scene, Progress]:
    progress = Progress(settle=settle)
    for stage in stages:
        scene = progress.take(stage, scene)
    return scene, progress


def next_action(asked: str | None, history: list[str], ready: list[str], done: set[str]) -> str:
    """The planner's next stage: what it asked for, unless that is unknown, not ready or asked a third time in a row; then the
    first ready stage that has not run, else ``finish``."""
    repeated = len(history) >= 2 and history[-1] == history[-2] == asked
    if asked == "finish" or (asked in ready and not repeated):
        return asked
    return next((s for s in ready if s not in done), "finish")


def run_planner(stages: list[Stage], scene: Scene, ask: Callable[[Progress, list[str]], str | None], most: int = 20) -> tuple[Scene, Progress]:
    """Stages in the order that ``ask`` chooses, at most ``most`` steps."""
    progress, history, by_name = Progress(), [], {s.name: s for s in stages}
    for _ in range(most):
        ready = [s.name for s in stages if progress.ready(s)]
        action = next_action(ask(progress, ready), history, ready, set(history))
        if action == "finish":
            break
        history.append(action)
        scene = progress.take(by_name[action], scene)
    return scene, progress


def verified(scene: Scene, check: Callable[[Scene], tuple[Scene, bool]], after: Callable[[Scene], Scene], rounds: int = 2) -> Scene:
    """Corrections by ``check`` until it is content, ``after`` each of them, at most ``rounds`` times."""
    for _ in range(rounds):
        scene, content = check(scene)
        if content:
            return scene
        scene = after(scene)
    return scene


def to_read(texts: DataFrame, force: bool = False) -> DataFrame:
    """Texts that need a reader: without text, or unsure; if forced all that no verifier has set."""
    unread = (F.coalesce("text", F.lit("")) == "") | (F.coalesce("confidence", F.lit(0.0)) < 0.5)
    return texts.where(~F.array_contains("source", "verifier") if force else unread)


def reading_batches(texts: DataFrame) -> DataFrame:
    """Texts with ``rank`` (by placement, then from the top and left; the first 150 of a drawing) and ``batch`` (of six)."""
    place = F.create_map(*(F.lit(v) for p in _PLACES.items() for v in p))[F.col("placement")]
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(place, F.col("bbox.y"), F.col("bbox.x"), F.col("ord")))
    return texts.withColumn("rank", rank).where(F.col("rank") <= READ_MOST).withColumn("batch", F.floor((F.col("rank") - 1) / BATCH))


def placed_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """(image_id, id, text) of answers (image_id, batch, items array<struct<id, text>>): by id, without one by place in the batch."""
    each = answers.select("image_id", "batch", F.posexplode("items").alias("pos", "r"))
    place = batches.select("image_id", "batch", ((F.col("rank") - 1) % BATCH).alias("pos"), F.col("id").alias("place_id"))
    named = each.join(place, ["image_id", "batch", "pos"], "left").select("image_id", F.coalesce(F.nullif("r.id", F.lit("")), "place_id").alias("id"), F.col("r.text").alias("text"))
    return named.join(batches.select("image_id", "id"), ["image_id", "id"], "left_semi")


def asked(rows: DataFrame, respond: Callable[[str], str], column: str = "prompt", again: str = "\nAnswer with JSON only.") -> DataFrame:
    """``rows`` with ``answer`` from a responder; an answer that holds no JSON is asked for once more."""
    from sketchgraph.operators.model_json import extracted

    def one(prompt: str) -> str | None:
        first = respond(prompt)
        return first if extracted(first) is not None else respond(prompt + again)

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(one)

    return rows.withColumn("answer", answer(F.col(column)))


def chosen_responder(name: str, overrides: dict, configured: dict, available: list[str]) -> str | None:
    """The responder of an agent: its override, then ``*``, then the configuration; auto takes the first available, none none."""
    spec = overrides.get(name) or overrides.get("*") or configured.get(name) or "auto"
    if spec in ("none", "off", "null"):
        return None
    return next(iter(available), None) if spec == "auto" else spec
