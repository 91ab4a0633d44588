"""Secret scans: fixed patterns, and a character convolutional network over every other candidate and its context.

Candidates are runs of 16 characters or more of ``[A-Za-z0-9+/_=.-]`` with a digit, and runs of 8 or more with letters of
both cases or a digit that stand behind a word such as ``pwd:`` or ``Bearer``. The network (numpy; one convolution,
maximum pooling over the candidate and over its context, one logistic output) slides over candidates longer than its window,
the highest probability counting, and is trained on labelled findings that
``labelled_findings`` writes from rules with a fixed seed; its output is calibrated by Platt scaling on findings kept apart,
and the threshold is the largest that still finds the demanded share of their secrets.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, text_bytes

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
LED = re.compile(r"""(?:\b(?:pwd|pass|auth|credentials?|private|client|access|key)["']?\x20*[:=]\x20*["']?|\bbearer\x20+)([A-Za-z0-9+/_.=-]{8,})""", re.IGNORECASE | re.ASCII)
LEADS = (b"pwd", b"pass", b"auth", b"credential", b"private", b"client", b"access", b"key", b"bearer")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
DIGIT = re.compile(rb"[0-9]")

#: Characters seen before, in and after a candidate.
BEFORE, WITHIN, AFTER = 24, 48, 8
WIDTH = BEFORE + WITHIN + AFTER
FILTERS, SPAN, CLASSES = 24, 5, 48
#: Share of the labelled secrets that the threshold must find.
RECALL = 0.98


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start and kind; offsets are code points."""
    out = []
    lower = data.lower()
    if any(n in lower for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, data: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets and overlap no span found already."""
    free = lambda a, b: not any(s < b and a < e for s, _, e in taken)
    found = [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0]) and free(*m.span())] if DIGIT.search(data) else []
    lower = data.lower()
    if any(n in lower for n in LEADS):
        known = set(found)
        mixed = lambda run: any(c.isdigit() for c in run) or (run.lower() != run and run.upper() != run)
        found += [m.span(1) for m in LED.finditer(text) if mixed(m[1]) and m.span(1) not in known and free(*m.span(1)) and not any(a <= m.start(1) < b for a, b in known)]
    return sorted(found)


def _char_classes() -> np.ndarray:
    """ASCII -> class: 1-26 letters (case is a class pair below), digits, the marks of candidates, white space, the rest."""
    table = np.full(128, 1, np.int64)
    for i, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = 2 + i
        table[ord(c.upper())] = 28
    table[[ord(c) for c in string.digits]] = 29
    for i, c in enumerate("+/_=.-:\"'@#&?%,;(){}[]"[:18]):
        table[ord(c)] = 30 + i
    table[[9, 10, 13, 32]] = 0
    return table


CHARS = _char_classes()


def encoded(text: str, a: int, b: int) -> np.ndarray:
    """Classes of the window around a candidate; parts that are shorter are padded with white space."""
    before = text[max(0, a - BEFORE) : a].rjust(BEFORE)
    within = text[a : min(b, a + WITHIN)].ljust(WITHIN)
    window = before + within + text[b : b + AFTER].ljust(AFTER)
    codes = np.frombuffer(window.encode("utf-32-le"), np.uint32)
    return CHARS[np.minimum(codes, 127)]


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """What the network sees of a candidate: its start and end and, if it is longer than WITHIN, each window of WITHIN characters."""
    return [(a, b), *((s, s + WITHIN) for s in range(a + 1, b - WITHIN + 1))]


@dataclass
class Network:
    """Convolution of one-hot characters with a bias, maxima by part, logistic output, Platt scaling and a threshold."""

    filters: np.ndarray  # SPAN, CLASSES, FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 * FILTERS
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled activations of windows ``x`` (n, WIDTH) of classes, and the places of the maxima."""
        n = WIDTH - SPAN + 1
        conv = self.bias + sum(self.filters[k][x[:, k : k + n]] for k in range(SPAN))
        parts = (slice(0, BEFORE - SPAN + 1), slice(BEFORE - SPAN + 1, BEFORE + WITHIN), slice(BEFORE + WITHIN, n))
        parts = [p for p in parts if p.start < n]
        at = np.concatenate([conv[:, p].argmax(axis=1) + p.start for p in parts], axis=1)
        top = np.take_along_axis(conv, at.reshape(len(x), len(parts), FILTERS), axis=1).reshape(len(x), -1)
        return np.maximum(top, 0), at

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[0] @ self.weights + self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -60, 60)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets of common shapes, and harmless runs with digits, each in a line of prose."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    syllables = ["an", "re", "ti", "on", "the", "in", "st", "or", "le", "de", "ch", "mo", "pa", "lu", "ver", "son"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    secrets = (
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: f"xoxb-{pick(string.digits, 11)}-{pick(alnum, 24)}",
        lambda: pick(alnum + "+/", 40), lambda: pick(alnum, 32), lambda: pick(alnum, int(rng.integers(20, 48))), lambda: pick(alnum + "+/", 43) + "=",
        lambda: "eyJ" + pick(alnum, 17) + "." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 43), lambda: pick(string.hexdigits.upper(), 40), lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick(upper, 24),
    )
    harmless = (
        lambda: "/".join(word() for _ in range(4)) + f"/{rng.integers(1, 2000)}.html", lambda: f"www.{word()}{word()}.example.com/{rng.integers(1, 999)}", lambda: f"{word()}.{word()}{rng.integers(1, 99)}.example.org",
        lambda: f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T1{rng.integers(0, 9)}.00.00", lambda: pick(string.digits, 16), lambda: pick(string.digits, int(rng.integers(16, 30))),
        lambda: "".join(word() for _ in range(5)) + str(rng.integers(0, 100)), lambda: "-".join(word() for _ in range(5)) + f"-{rng.integers(1, 99)}", lambda: "_".join(word() for _ in range(4)) + f"_{rng.integers(1, 99)}",
        lambda: f"{word()}-{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}.tar.gz", lambda: "=" * int(rng.integers(16, 40)) + str(rng.integers(0, 9)), lambda: f"{rng.integers(1, 99)}.mail{rng.integers(1, 9)}.example.com",
        lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}{word().capitalize()}{rng.integers(1, 99)}", lambda: "-".join(pick(string.digits, 4) for _ in range(4)), lambda: "...." * 5 + str(rng.integers(1, 400)),
    )
    leads = ("key", "auth", "Bearer", "credential", "client", "access", "private", "pass", "pwd")
    mixed = string.ascii_letters + string.digits * 3
    short_secrets = (lambda: pick(mixed, int(rng.integers(8, 16))), lambda: f"{pick(string.ascii_uppercase, 1)}{pick(mixed, int(rng.integers(5, 9)))}{pick(string.digits, 2)}", lambda: pick(string.ascii_letters, int(rng.integers(16, 30))))
    short_harmless = (
        lambda: f"{word()}{word()}{rng.integers(1, 30)}", lambda: f"{word().capitalize()}{word().capitalize()}", lambda: f"{word()}-{rng.integers(1, 30)}-{word()}", lambda: f"{word()}_{word()}.{rng.integers(1, 9)}",
        lambda: f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", lambda: f"{rng.integers(1, 99)}.{rng.integers(10, 99)}.{rng.integers(100, 999)}", lambda: f"{word().capitalize()}.{word()}.{word()}", lambda: f"{rng.integers(1, 99)}/{rng.integers(1000, 99999)}/{word()}",
    )
    out = []
    for k in range(n):
        label = k % 2
        short = rng.random() < 0.25
        kinds = (short_secrets if label else short_harmless) if short else secrets if label else harmless
        run = kinds[rng.integers(len(kinds))]()
        lead = " ".join(word() for _ in range(rng.integers(0, 6)))
        if short:
            lead += " " + str(rng.choice(leads)) + str(rng.choice([": ", " = ", "=", ":"]))
        elif label and rng.random() < 0.4:
            lead += " " + str(rng.choice(leads)) + str(rng.choice([": ", " = ", " ", '="']))
        lead += str(rng.choice(["", " ", " ", '"', "("]))
        tail = str(rng.choice(["", " ", '" ', ") ", ", ", ". "])) + " ".join(word() for _ in range(rng.integers(0, 4)))
        out.append((lead + run + tail, len(lead), len(lead) + len(run), label))
    return out


@functools.cache
def trained(n: int = 6000, seed: int = 11, epochs: int = 12, recall: float = RECALL) -> Network:
    """The network fitted to ``n`` labelled findings (Adam, batches of 64), calibrated on a third as many others."""
    rng = np.random.default_rng(seed)
    data = labelled_findings(n, seed)
    x = np.stack([encoded(t, a, b) for t, a, b, _ in data])
    y = np.array([label for *_, label in data], float)
    net = Network(rng.normal(0, 0.1, (SPAN, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.filters, net.bias, net.weights, np.zeros(1))]
    offset, step, rate = np.zeros(1), 0, 0.005
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), n // 64):
            xb, step = x[batch], step + 1
            pooled, at = net.hidden(xb)
            error = (1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.offset, -60, 60))) - y[batch]) / len(batch)
            back = (error[:, None] * net.weights) * (pooled > 0)
            grad_filters = np.zeros_like(net.filters)
            which = np.tile(np.arange(FILTERS), at.shape[1] // FILTERS)
            for k in range(SPAN):
                np.add.at(grad_filters[k], (np.take_along_axis(xb, at + k, axis=1), which[None, :]), back)
            grad_bias = np.bincount(which, back.sum(axis=0), FILTERS)
            grads = (grad_filters, grad_bias, pooled.T @ error + 1e-4 * net.weights, np.array([error.sum()]))
            for p, g, (m, v) in zip((net.filters, net.bias, net.weights, offset), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.offset = float(offset[0])
    held = labelled_findings(n // 3, seed + 1)
    z = net.logit(np.stack([encoded(t, a, b) for t, a, b, _ in held]))
    y = np.array([label for *_, label in held], float)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        slope -= 0.02 * float(((p - y) * z).mean() + 0.01 * (slope - 1))
        shift -= 0.1 * float((p - y).mean())
    net.slope, net.shift = slope, shift
    p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
    net.threshold = float(np.quantile(p[y == 1], 1 - recall, method="lower"))
    return net


def spans_of(data: bytes, net: Network) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding in a text, by start and kind."""
    text = data.decode("utf-8", "replace")
    found = base_spans(text, data)
    open_ = candidates(text, data, found)
    seen = [(k, w) for k, (a, b) in enumerate(open_) for w in windows(a, b)]
    hits = set()
    for at in range(0, len(seen), 256):
        part = seen[at : at + 256]
        p = net.probability(np.stack([encoded(text, a, b) for _, (a, b) in part]))
        hits.update(k for (k, _), hit in zip(part, (p >= net.threshold).tolist(), strict=True) if hit)
    found += [(open_[k][0], 3, open_[k][1]) for k in hits]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network) of every row of ``docs`` (doc_id long, text).

    Spans are kind:start:end in code points, end exclusive, by start, then kind. A null text is empty and has no spans; texts
    are read whole; a null doc_id stays null; repeated rows give a row each; other columns are ignored; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        net = shared.value

        def run(rows):
            for doc_id, data in rows:
                spans = spans_of(data, net)
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                yield doc_id, *counts[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), counts[3]

        return run

    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_network", pa.int64())])
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")), make, schema, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long", 1024)


def redacted(data: bytes, net: Network, mark: str = "[SECRET]") -> str:
    """The text with every finding (overlapping ones together) replaced by ``mark``."""
    text = data.decode("utf-8", "replace")
    out, end = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans_of(data, net):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[end:a], mark]
        end = b
    return "".join([*out, text[end:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their columns, secrets in ``text`` replaced; ``n_chars``, if there, counts the new text. Null texts stay null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(series: pd.Series) -> pd.Series:
        return series.map(lambda data: redacted(data, shared.value))

    columns = docs.columns
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean(text_bytes())))
    return (out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in columns else out).select(columns)
