"""Every query and every stage over tables with nulls in each column, empty and very long texts, ties, repeats, clashing columns, and no rows."""

import random

import numpy as np
import pytest

from sketchgraph.llm import quality_classifier
from sketchgraph.llm.common import WordHashes
from sketchgraph.llm.queries import QUERIES
from sketchgraph.llm.text_stats import FEATURES, features

CLASHES = "row long, unit string, code long, grp string, key string, band long, part int, place long, features string, held_out boolean, n long, rare string, score string"
TABLES = {
    "documents": f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}",
    "pages": "page_id long, url string, html string, text string, n_chars string",
    "benchmark": "item_id long, text string, item string, words int",
    "labels": "doc_id long, quality int, toxic int, label string, n int",
    "conversations": "conv_id long, turn long, role string, text string, position string, action int, place string",
}


def rows_of(name):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["an", "orti", "The", "leon,", "re.", "zu"]) + rng.choice("aeiou") for _ in range(n))
    long = prose(150_000)
    extra = (1, "u", 2, "g", "k", 3, 4, 5, "f", True, 6, "r", "s")
    texts = [prose(80), "", None, "  \n\t ", long, prose(80), "é日本 " * 400, "<|endoftext|>", "<|endoftext|> <|x", "\x00\x1f a b", "word"] + [prose(60) for _ in range(30)]
    if name == "documents":
        copies = [texts[0]] * 12 + [long, ""]
        rows = [(i, t, ("en", "de", None)[i % 3], "s", 1, *extra) for i, t in enumerate(texts + copies)]
        return rows + [(None,) * 18, (None, texts[0], None, None, None, *[None] * 13), rows[0], rows[0], rows[2]]
    if name == "pages":
        page = "<html><body><nav><a href=a>x</a></nav><article><p>" + prose(40) + "</p></article></body></html>"
        return [(1, "u", page, "t", "n"), (1, "u", page, "t", "n"), (2, None, None, None, None), (None, "u", "", None, None), (3, "u", "<p>" + long, None, None), (4, "u", "<" * 5000 + "<b>" * 5000 + "</i>" * 5000, None, None)]
    if name == "benchmark":
        return [(1, texts[0], "i", 1), (1, texts[0], "i", 1), (None, texts[12], None, None), (2, None, None, None), (3, "", None, None), (4, "word", None, None), (5, long, None, None)]
    if name == "labels":
        return [(i, i % 2, 0, "l", 1) for i in range(44)] + [(3, None, None, None, None), (None, 1, 0, None, None), (4, 7, 0, None, None), (5, 0, 0, None, None), (5, 1, 0, None, None)]
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}", "p", 1, "x") for k in range(6)]
    return turns + [turns[0], (None, None, None, None, None, None, None), (2, None, "system", long, None, None, None), (2, None, "system", long, None, None, None), (3, 0, "tool", "", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name, ddl in TABLES.items():
        spark.createDataFrame(rows_of(name), ddl).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


SIZES = {"op2_html_text": "pages", "op5_chat_formatting": None, "op6_best_fit_packing": None}


@pytest.fixture(scope="module")
def answers(spark, odd, empty):
    """Every query's rows over both folders, several queries at a time."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        return {(n, f): pool.submit(lambda n=n, f=f: QUERIES[n](spark, f).collect()) for n in QUERIES for f in (odd, empty)}


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_over_odd_and_empty_tables(answers, odd, empty, name):
    rows = answers[name, odd].result()
    of = SIZES.get(name, "documents")
    if of:
        assert len(rows) == len(rows_of(of))
        key = "page_id" if of == "pages" else "doc_id"
        assert sorted(r[key] is None for r in rows) == sorted(r[0] is None for r in rows_of(of))
    else:
        assert rows
    assert not answers[name, empty].result()


def test_stages_over_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "best_fit_packing":
                assert out.columns == docs.columns and out.count() <= docs.count()
            else:
                assert {(r["doc_id"]) for r in out.select("doc_id").distinct().collect()} == {(r["doc_id"]) for r in docs.select("doc_id").distinct().collect()}
            docs = corpus_pipeline.write_table(out, name)
        assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_scores_are_log_density_differences(spark):
    """Scores straight from the definition: shrunk covariances, Mahalanobis distances by solving, determinants."""
    rng, hashes = random.Random(2), WordHashes()
    texts = [" ".join(rng.choice(["anti", "re", "Lo", "x1"]) + rng.choice(["", "!", "##"][: 1 + k % 3]) for _ in range(rng.randrange(20, 90))) for k in range(150)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.quality_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels).collect()}
    x = np.array([features(t.encode(), hashes) for t in texts])
    learned = np.array([not out[k]["held_out"] for k in range(150)])
    y = np.array([k % 3 == 0 for k in range(150)])
    center, scale = x[learned].mean(axis=0), np.sqrt(np.maximum(x[learned].var(axis=0), 1e-6))
    z = (x - center) / scale
    parts = [z[learned & (y == k)] for k in (False, True)]
    spread = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * s for p, s in zip(parts, spread, strict=True)) / learned.sum()
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(FEATURES))
    density = []
    for p, s in zip(parts, spread, strict=True):
        c = 0.9 * s + 0.1 * pooled
        off = z - p.mean(axis=0)
        density.append(np.log(len(p)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (off * np.linalg.solve(c, off.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / quality_classifier.TEMPERATURE))
    assert [out[k]["score"] for k in range(150)] == pytest.approx(want.tolist(), abs=1e-6)
