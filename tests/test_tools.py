"""Settings, responders, data sets on disk, the whole reading, and generated drawings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchgraph import analysis, cli, config, responders, sinks, storage
from sketchgraph.operators import pixels
from sketchgraph.sources import synthetic


def test_settings_are_laid_over_each_other(tmp_path):
    base = {"vlms": {"a": {"provider": "mock", "model": "x", "api_key_env": "K"}}, "text": {"batch_size": 6, "ocr": "vlm"}}
    out = config.merged(base, {"vlms": {"a": {"provider": "ollama", "model": "y"}}, "text": {"batch_size": 2}})
    assert out == {"vlms": {"a": {"provider": "ollama", "model": "y"}}, "text": {"batch_size": 2, "ocr": "vlm"}}
    assert config.merged(base, {"vlms": {"a": {"model": "z"}}})["vlms"]["a"] == {"provider": "mock", "model": "z", "api_key_env": "K"}
    path = tmp_path / "own.yaml"
    path.write_text("shapes: {fit_threshold: 0.9}\nagent_vlms: {verifier: mock}\n")
    s = config.load(path, config.from_options({"vlm": "none", "no_verify": True, "agent_vlm": ["text_reader=ollama:q"], "set": ["text.max_items=3", "new.deep.key=[1, 2]"], "orientation": "90"}))
    assert (s.shapes["fit_threshold"], s.shapes["max_merge"], s.verifier["enabled"], s.text["max_items"], s.new["deep"]["key"], s.preprocess["orientation"]) == (0.9, 3, False, 3, [1, 2], "90")
    assert (s.responder_for("verifier"), s.responder_for("text_reader"), s.responder_for("planner")) == ("mock", "ollama:q", "none")
    with pytest.raises(ValueError):
        config.from_options({"agent_vlm": ["verifier"]})
    assert "fit_threshold: 0.9" in config.as_yaml(s) and config.DEFAULTS["shapes"]["fit_threshold"] == 0.86


def test_responders_are_chosen_and_asked_again():
    name, r = responders.parsed("ollama:llava:7b@http://gpu:1")
    assert (name, r.provider, r.model, r.base_url, r.max_images_per_call) == ("ollama:llava:7b", "ollama", "llava:7b", "http://gpu:1", 1)
    for bad in ("nonsense", "foo:bar"):
        with pytest.raises(responders.ResponderError):
            responders.parsed(bad)
    said = iter(["no json", "so {\"a\": 1}"])
    mock = responders.Scripted(config.Responder("mock", "m", max_images_per_call=1), script=lambda p, i: next(said))
    assert mock.generate_json("look") == {"a": 1} and mock.calls == 2 and mock.history[1]["prompt"].startswith("look\n\n")
    with pytest.raises(responders.ResponderError):
        mock.generate("x", [1, 2])
    with pytest.raises(responders.ResponderError):
        responders.Scripted(config.Responder("mock", "m"), script=lambda p, i: "none").generate_json("x")
    settings = config.load(over={"auto_preference": ["gone:x", "mock"], "agent_vlms": {"verifier": "off"}})
    registry = responders.Registry(settings, {"planner": mock})
    assert registry.for_agent("planner") is mock and registry.for_agent("verifier") is None
    assert registry.for_agent("text_reader").name == "mock" and registry.for_agent("text_reader") is registry.for_agent("vlm_analyst")
    assert registry.listing() == [{"name": "mock", "provider": "mock", "model": "mock", "available": "yes", "status": "ok"}]
    assert analysis.listing(settings)[0].startswith("preprocess: needs nothing") and "[no responder]" in analysis.listing(settings)[-1]
    assert analysis.allowed("shapes", {"relax": True, "x": 1}) == {"relax": True} and analysis.allowed("topology", {"a": 1}) == {}


def test_generated_pages_hold_their_truth(spark):
    recipe = synthetic.Recipe(diagrams=(2, 3), p_prose=1.0, p_scribble=1.0, p_edge=1.0, p_identity=1.0, p_pair=0.3)
    kinds = set()
    for seed in range(40):
        sheet = synthetic.Sheet(seed, recipe)
        sheet.draw()
        truth = sheet.truth()
        by_id = {s["id"]: s for s in truth["shapes"]}
        for s in truth["shapes"]:
            kinds.add(s["type"])
            p = by_id.get(s["parent_id"])
            assert (p is None) == (s["depth"] == 0) and (p is None or (s["depth"] == p["depth"] + 1 and p["bbox"]["x"] < s["bbox"]["x"]))
        boxes = [t["box"] for t in sheet.texts]
        assert all(not (a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]) for i, a in enumerate(boxes) for b in boxes[i + 1 :])
        names = {x["id"] for x in truth["shapes"] + truth["texts"]}
        for c in truth["connections"]:
            assert len(c["endpoints"]) >= 2 and all((e["shape_id"] or e["text_id"]) in names | {None} for e in c["endpoints"])
        assert sum(s["crossed_out"] for s in truth["shapes"]) == (len(truth["shapes"]) > 0)
        if sheet.two_pages:
            assert all(b[2] < sheet.width / 2 or b[0] > sheet.width / 2 for b in boxes)
    assert len(kinds) == 7 and synthetic.page(3)[0].tobytes() == synthetic.page(3)[0].tobytes()
    weights = {"a": 1.0, "b": 3.0, "c": 0.0}
    rng = np.random.default_rng(0)
    got = [synthetic.picked(rng, weights) for _ in range(2000)]
    assert 0.7 < got.count("b") / 2000 < 0.8 and "c" not in got
    line = synthetic.curve((0, 0), (100, 0), rng)
    assert np.allclose(line[[0, -1]], [(0, 0), (100, 0)], atol=1e-6) and len(synthetic.corner((0, 0), (5, 9), rng)) > 20
    assert synthetic.toward(synthetic.clean_outline("circle", 0, 0, 10, 10), (0, 0), (9, 0)) == pytest.approx([5, 0])
    rows = synthetic.generated(spark, 3, seed=2, pixels=True)
    found = pixels.scanned_scene(pixels.scanned(rows.select("image_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "nChannels", "data")))
    assert found.images.count() == 3 and found.shapes.count() > 0


def test_data_sets_are_written_by_split(spark, tmp_path):
    rows = synthetic.generated(spark, 4, seed=1, val_fraction=0.25).cache()
    scene = synthetic.generated_scene(rows)
    out = f"file://{tmp_path}/set"
    summary = sinks.write_dataset(scene, rows.select("image_id", "split"), out, system="s", prompt="p")
    assert (summary["n_train"], summary["n_val"]) == (3, 1) and json.loads((tmp_path / "set/dataset.json").read_text())["n_val"] == 1
    assert "val: images/val" in (tmp_path / "set/data.yaml").read_text() and "val: images/train" in sinks.data_yaml("x", False)
    labels = spark.read.json(f"{out}/labels")
    assert labels.count() == 4 and all(0 <= float(v) <= 1 for r in labels.collect() for line in r["lines"] for v in line.split(" ")[1:])
    for split in ("train", "val"):
        ids = sorted(r["id"] for r in spark.read.json(f"{out}/coco/annotations/split={split}").collect())
        assert ids == list(range(1, len(ids) + 1)) and ids
    assert spark.read.json(f"{out}/coco/categories").count() == 11 and spark.read.json(f"{out}/coco/images").where("split = 'val'").count() == 1
    assert spark.read.json(f"{out}/vlm").count() == 4 and spark.read.option("sep", "\t").option("header", True).csv(f"{out}/ocr").count() == scene.texts.count()
    files = spark.createDataFrame([("x/syn_1.jpg", b"1"), ("x/other.jpg", b"2")], "path string, content binary")
    assert [r["image_path"] for r in sinks.paired(spark.createDataFrame([("syn_1",)], "stem string"), files).collect()] == ["x/syn_1.jpg"]


def test_scenes_are_read_to_the_end(spark, tmp_path, capsys):
    rows = synthetic.generated(spark, 2, seed=5).cache()
    scene = synthetic.generated_scene(rows)
    result = analysis.read_scene(scene)
    assert [t[1:] for t in result.trace][:3] == [("preprocess", "done"), ("triage", "done"), ("shapes", "done")] and all(t[2] == "done" for t in result.trace)
    assert all(r["summary"].startswith("Found ") for r in result.scene.images.collect()) and result.descriptions().count() == 2
    ids = [r["id"] for r in result.scene.shapes.where("image_id = 1").orderBy("ord").collect()]
    assert ids == [f"S{k + 1}" for k in range(len(ids))]
    notes = spark.createDataFrame([(1, 2, "b", "second"), (1, 1, "a", "first")], "image_id long, step int, agent string, message string")
    sinks.write_results(result.scene, f"file://{tmp_path}/out", notes)
    text = spark.read.json(f"file://{tmp_path}/out/descriptions").where("image_id = 1").first()["text"]
    assert text.startswith("# drawing 1") and text.index("1. **a**: first") < text.index("2. **b**: second") and "```mermaid\nflowchart TB" in text
    fixes = spark.createDataFrame([(1, "S1")], "image_id long, id string")
    less = analysis.read_scene(scene, more={"verifier": lambda s: s.with_(shapes=s.shapes.join(fixes, ["image_id", "id"], "left_anti"))})
    assert less.scene.shapes.where("image_id = 1").count() == len(ids) - 1 and less.notes == ["models used by: verifier"]
    for name in ("images", "shapes", "texts", "connections"):
        getattr(scene, name).write.parquet(f"{tmp_path}/truth/{name}")
    assert cli.main(["benchmark", f"{tmp_path}/truth", f"same={tmp_path}/truth", "--out", f"file://{tmp_path}/report"]) == 0
    assert "| same | 1.00/1.00/1.00 |" in capsys.readouterr().out and "| same |" in (tmp_path / "report/report.md").read_text()
    for command in (["vlms"], ["agents"], ["config", "--set", "text.max_items=9"]):
        assert cli.main(command) == 0
    assert "max_items: 9" in capsys.readouterr().out


def test_tables_go_when_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "tables_dir", lambda _: f"file://{tmp_path}/tables")
    assert storage.write_table(spark.range(3), "numbers").count() == 3 and list((tmp_path / "tables").iterdir())
    storage.drop_tables(spark)
    assert not (tmp_path / "tables").exists()
