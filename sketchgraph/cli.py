"""The command line: ``python -m sketchgraph.cli <command> ...``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sketchgraph import analysis, config, sinks
from sketchgraph.model import Scene
from sketchgraph.operators import evaluate, topology
from sketchgraph.responders import Registry


def _shared(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--config")
    parser.add_argument("--vlm")
    parser.add_argument("--no-vlm", action="store_true")
    parser.add_argument("--agent-vlm", action="append")
    parser.add_argument("--mode", choices=("pipeline", "planner"))
    parser.add_argument("--orientation")
    parser.add_argument("--detector", choices=("cv", "yolo", "cv+yolo"))
    parser.add_argument("--weights")
    parser.add_argument("--ocr", choices=("vlm", "trocr", "tesseract", "none"))
    parser.add_argument("--no-verify", action="store_true")
    parser.add_argument("--set", action="append")


def _settings(args) -> config.Settings:
    return config.load(getattr(args, "config", None), config.from_options(vars(args)))


def _spark() -> SparkSession:
    return SparkSession.builder.appName("sketchgraph").getOrCreate()


def analyze(args) -> int:
    """Read images, save what is found, and count it."""
    result = analysis.analyze(_spark(), args.images, _settings(args))
    sinks.write_results(result.scene, args.out)
    for r in result.stats().select("image_id", "shapes", "connections", "texts", "texts_read").collect():
        print(f"{r['image_id']}: {r['shapes']} shapes, {r['connections']} connections, {r['texts']} texts ({r['texts_read']} read)")
    return 0


def vlms(args) -> int:
    for r in Registry(_settings(args)).listing():
        print(f"{r['name']}  {r['provider']}  {r['model']}  available={r['available']}  {r['status']}")
    return 0


def agents(args) -> int:
    print("\n".join(analysis.listing(_settings(args))))
    return 0


def show_config(args) -> int:
    print(config.as_yaml(_settings(args)))
    return 0


def synth(args) -> int:
    """Generate drawings with their ground truth and write them as a training set."""
    from sketchgraph.sources.synthetic import generated, generated_scene

    rows = generated(_spark(), args.n, args.seed, args.val_fraction)
    print(json.dumps(sinks.write_dataset(generated_scene(rows), rows.select("image_id", "split"), args.out, tuple(f for f in args.formats.split(",") if f)), indent=2))
    return 0


def _scene(spark: SparkSession, folder: str) -> Scene:
    return Scene(*(spark.read.parquet(f"{folder}/{n}") for n in ("images", "shapes", "texts", "connections")))


def _report(spark: SparkSession, truth: str, system: str, folder: str):
    true, pred = topology.updated(_scene(spark, truth)), topology.updated(_scene(spark, folder))
    return evaluate.report(evaluate.evaluation(true, pred)).withColumn("system", F.lit(system))


def score(args) -> int:
    """Score a reading (a folder of scene tables) against the truth."""
    print("\n".join(sinks.write_reports(_report(_spark(), args.truth, args.name, args.reading), args.out)))
    return 0


def benchmark(args) -> int:
    """Score several readings, name=folder each, in one table."""
    spark, every = _spark(), None
    for item in args.readings:
        name, _, folder = item.partition("=")
        one = _report(spark, args.truth, name, folder)
        every = one if every is None else every.unionByName(one)
    print("\n".join(sinks.write_reports(every, args.out)))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sketchgraph")
    top.add_argument("-v", "--verbose", action="count", default=0)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for flags, more in options:
            p.add_argument(*flags, **more)
        _shared(p)
        p.set_defaults(run=run)

    out = (("--out",), {"default": "outputs"})
    add("analyze", analyze, (("images",), {}), out)
    add("vlms", vlms)
    add("agents", agents)
    add("config", show_config)
    add("synth", synth, (("-n",), {"type": int, "default": 1000}), (("--seed",), {"type": int, "default": 0}), (("--val-fraction",), {"type": float, "default": 0.1}), (("--formats",), {"default": ",".join(sinks.FORMATS)}), out)
    add("eval", score, (("truth",), {}), (("reading",), {}), (("--name",), {"default": "reading"}), out)
    add("benchmark", benchmark, (("truth",), {}), (("readings",), {"nargs": "+"}), out)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.verbose, 2)])
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
