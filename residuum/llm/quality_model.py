"""Quality classifier by co-training on two views of a page.

The content view sees the text: hashed trigrams of character shapes and how much repeats. The metadata view sees what surrounds
it: language, source, length, lines and characters a line in octaves, and host, address and title of the page that carries the document
(its id stands in the address). Each view has a logistic regression, calibrated (Platt scaling) on labelled rows of their own. In each
round a view labels the unlabelled pages that it is surest of by its calibrated probability, and the other view trains on them as well.
Labels of both kinds are handed over in the ratio of the labelled rows, as many as the scarcer kind allows, so that
a view which is never sure of bad pages hands on nothing and can't tilt the other; pages that the other view surely sees otherwise are
left out. Rounds end when neither view has anything to hand on. Afterwards the views are calibrated again, a third logistic regression on the calibrated logits, fitted on further
rows, combines them, and every document is scored.

The fit uses at most about ``LABELLED`` labelled and ``UNLABELLED`` further rows, chosen by a hash of the id; scoring reads every
whole text once and shuffles ids and metadata only. Half of the labelled rows train the views, a fifth calibrates, the rest is halved
for the combination and for the threshold, which lets ``PASS_RATE`` of the good rows pass (``kept``).

Defined cases. Null or empty text: all its features are zero, scored like any other. No labels, or of one kind only: score is the
share of good labels (1 without any) and everything is kept. Repeated labels of an id: their majority. A document on several pages: the
first address, and its title. Null ids: scored without a page. Repeated rows: same score. Empty table: empty result. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import stash

LABELLED, UNLABELLED = 4_000, 3_000
ROUNDS, EACH = 4, 100
#: How sure a view must be to hand a label on.
SURE = 0.95
PASS_RATE = 0.998
#: How much each view's weights are shrunk: metadata have many rare tags.
SHRINK = (0.03, 0.1)
SEED = 4
SHAPES, TAGS = 512, 256
OCTAVES = 24
CONTENT, META = SHAPES + 5, TAGS + 3 * OCTAVES + 6


def _shape_table() -> bytes:
    """Byte -> its shape: letters, capitals, digits, white space and line ends by kind, signs as they are."""
    kind = lambda b: "a" if b >= 128 or chr(b).islower() else "A" if chr(b).isupper() else "0" if chr(b).isdigit() else "n" if b == 10 else " " if chr(b).isspace() else chr(b)
    return bytes(ord(kind(b)) for b in range(256))


_SHAPE = _shape_table()


def content(text: str | None) -> np.ndarray:
    """Features of the whole text."""
    out = np.zeros(CONTENT, np.float32)
    words = (text or "").split()
    if not words:
        return out
    b = np.frombuffer((" " + text + " ").encode().translate(_SHAPE), np.uint8).astype(np.uint32)
    three = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    counts = np.bincount(three * np.uint32(0x2545F491) >> np.uint32(32 - SHAPES.bit_length() + 1), minlength=SHAPES)
    out[:SHAPES] = np.sqrt(counts / counts.sum())
    n, lines = len(words), text.split("\n")
    out[SHAPES:] = np.log1p(n) / 10, np.log1p(len(set(words))) / np.log1p(n), len(set(lines)) / len(lines), sum(map(len, words)) / n / 10, 1.0
    return out


def metadata(lang: str | None, source: str | None, url: str | None, title: str | None, n_chars: int, n_lines: int) -> np.ndarray:
    """Features of what surrounds the text."""
    out = np.zeros(META, np.float32)
    address = re.match(r"(?P<scheme>\w+)://(?P<host>[^/]*)(?P<path>[^?#]*)(?P<rest>.*)", url or "")
    tags = [f"lang {lang}", f"source {source}"]
    if address:
        tags += [f"host {x}" for x in re.split(r"[.-]", address["host"])] + [f"scheme {address['scheme']}", f"depth {address['path'].count('/')}"]
        tags += [f"rest {x}" for x in re.findall(r"[?&#](\w+)", address["rest"])]
    for tag in tags:
        out[xxhash.xxh32_intdigest(tag) % TAGS] += 0.5
    sizes = n_chars, n_lines, n_chars // max(1, n_lines)
    for k, size in enumerate(sizes):
        out[TAGS + k * OCTAVES + min(OCTAVES - 1, size.bit_length())] = 0.5
    signs = sum(not c.isalnum() and not c.isspace() for c in title or "")
    out[TAGS + 3 * OCTAVES :] = *(np.log1p(x) / 10 for x in sizes), float(bool(address)), float(bool(title)), signs / max(1, len(title or ""))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.3, prior: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression (Adam on all rows); ``prior`` shrinks the weights, less so with more rows."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        off = _sigmoid(x @ w[:-1] + w[-1]) - y
        g = np.append(x.T @ off / len(y) + prior / len(y) * w[:-1], off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    views: tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]
    scale: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float, float]
    threshold: float

    def logit(self, view: int, x: np.ndarray) -> np.ndarray:
        """Calibrated logits of one view."""
        w, b = self.views[view]
        a, c = self.scale[view]
        return np.clip(a * (x @ w + b) + c, -30, 30)


def handed_on(sure: np.ndarray, other: np.ndarray, known: dict[int, float], prior: float, each: int) -> dict[int, float]:
    """Labels that a view hands on: the rows of the pool that it is surest of, of both kinds in the ratio of ``prior``.

    ``sure`` and ``other``: the calibrated probability of good by this and the other view; ``known``: what the other view has been told.
    """
    free = np.array([r not in known for r in range(len(sure))], bool)
    good = np.flatnonzero(free & (sure >= SURE) & (other > 1 - SURE))
    bad = np.flatnonzero(free & (sure <= 1 - SURE) & (other < SURE))
    rows = min(each, len(good) / prior, len(bad) / (1 - prior))
    n_good, n_bad = int(rows * prior), int(rows * (1 - prior))
    if not n_good or not n_bad:
        return {}
    good, bad = good[np.argsort(-sure[good], kind="stable")][:n_good], bad[np.argsort(sure[bad], kind="stable")][:n_bad]
    return {int(r): 1.0 for r in good} | {int(r): 0.0 for r in bad}


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, each: int = EACH, log: list[tuple[int, int]] | None = None) -> Model:
    """``xs`` and ``pool``: both views of the labelled and the unlabelled rows; ``y``: 0 or 1. ``log`` gets how many labels each view handed on in each round."""
    prior = float(y.mean()) if len(y) else 1.0
    at = np.random.Generator(np.random.PCG64(SEED)).permutation(len(y))
    own, scaling, mixing, cutting = np.split(at, (np.array([0.5, 0.7, 0.85]) * len(y)).astype(int))
    if len(y) < 20 or any(len(set(y[part])) < 2 for part in (own, scaling, mixing)):
        flat = (np.zeros(CONTENT), 0.0), (np.zeros(META), 0.0)
        return Model(flat, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0, float(np.clip(np.log((prior + 1e-6) / (1 - prior + 1e-6)), -14, 14))), 0.0)
    told: list[dict[int, float]] = [{}, {}]  # what each view has learnt from the other: row of the pool -> label

    def fit(view: int) -> tuple[np.ndarray, float]:
        rows = np.array(list(told[view]), np.int64)
        return logistic(np.concatenate((xs[view][own], pool[view][rows])), np.concatenate((y[own], [told[view][r] for r in rows])), prior=SHRINK[view])

    def calibrated(view: int, weights: tuple[np.ndarray, float]) -> tuple[float, float]:
        a, c = logistic((xs[view][scaling] @ weights[0] + weights[1])[:, None] / 10, y[scaling], rate=0.05)
        return max(0.0, float(a[0])) / 10, c

    views = [fit(0), fit(1)]
    scale = [calibrated(v, views[v]) for v in (0, 1)]
    for _ in range(rounds):
        p = [_sigmoid(scale[v][0] * (pool[v] @ views[v][0] + views[v][1]) + scale[v][1]) for v in (0, 1)]
        new = [handed_on(p[v], p[1 - v], told[1 - v], prior, each) for v in (0, 1)]
        if log is not None:
            log.append((len(new[0]), len(new[1])))
        if not any(new):
            break
        told[1] |= new[0]
        told[0] |= new[1]
        views = [fit(0), fit(1)]
        scale = [calibrated(v, views[v]) for v in (0, 1)]
    logits = lambda part: np.stack([np.clip(a * (xs[v][part] @ w + b) + c, -30, 30) for v, ((w, b), (a, c)) in enumerate(zip(views, scale))], 1)
    mix, bias = logistic(logits(mixing) / 10, y[mixing], rate=0.05)
    mix = mix / 10
    good = _sigmoid(logits(cutting) @ mix + bias)[y[cutting] == 1]
    threshold = min(0.5, float(np.quantile(good, 1 - PASS_RATE))) if len(good) else 0.0
    return Model(tuple(views), tuple(scale), (float(mix[0]), float(mix[1]), bias), threshold)


def _addresses(pages: DataFrame, url_col: str, html_col: str = "html") -> DataFrame:
    """``page, url, title``: the first address of each document id and the title of its page (null without ``html_col``)."""
    number = F.regexp_extract(url_col, r"^\w+://[^/]+/(?:[^/?#]+/)*?(\d{1,18})(?:[/.?#]|$)", 1)  # empty if there is none
    id_ = F.when(number != "", number).cast("long")
    title = F.regexp_extract(html_col, r"<title>([^<]*)</title>", 1) if html_col in pages.columns else F.lit(None).cast("string")
    found = pages.select(id_.alias("page"), F.struct(F.col(url_col).alias("url"), title.alias("title")).alias("first")).filter("page IS NOT NULL")
    return found.groupBy("page").agg(F.min("first").alias("first")).select("page", "first.*")


_TABLE = "id long, lang string, source string, n_chars long, n_lines long"


def _seen(docs: DataFrame, of, kind: str) -> DataFrame:
    """``id, lang, source, n_chars, n_lines`` and ``of(text)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            chars, lines = [len(t or "") for t in texts], [(t or "").count("\n") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(chars, pa.int64()), pa.array(lines, pa.int64()), pa.array([of(t) for t in texts], pa.float64() if kind == "double" else pa.binary())], names=["id", "lang", "source", "n_chars", "n_lines", "of"])

    return docs.mapInArrow(run, f"{_TABLE}, of {kind}")


def fit(docs: DataFrame, addresses: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Co-train on bounded samples; ``docs``: id, lang, source, text; ``labels``: id, good."""
    labels = labels.groupBy("id").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000))
    share = min(1.0, labelled / max(1, labels.count()))
    more = min(1.0, unlabelled / max(1, docs.count()))
    told = labels.filter(place < int(1_000_000 * share))  # at most about ``labelled`` rows
    known = docs.join(F.broadcast(told), "id").drop("good")
    docs = docs.filter("id IS NOT NULL")
    other = docs.filter(place >= int(1_000_000 * (1 - more))).join(F.broadcast(told), "id", "left_anti")
    rows = _seen(known.unionByName(other), lambda t: content(t).astype("<f2").tobytes(), "binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("of", "lang", "source", "n_chars", "n_lines")).alias("row")).select("id", "row.*")  # one row an id, however often it is there
    rows = rows.join(told, "id", "left").join(addresses, rows["id"] == addresses["page"], "left").select(rows["*"], "good", "url", "title").collect()  # both samples
    rows.sort(key=lambda r: r["id"])
    views = np.stack([np.frombuffer(r["of"], "<f2") for r in rows]).astype(np.float64) if rows else np.zeros((0, CONTENT)), np.stack([metadata(r["lang"], r["source"], r["url"], r["title"], r["n_chars"], r["n_lines"]) for r in rows]).astype(np.float64) if rows else np.zeros((0, META))
    good = np.array([-1 if r["good"] is None else r["good"] for r in rows], np.int64)
    own = good >= 0
    return co_train((views[0][own], views[1][own]), good[own].astype(np.float64), (views[0][~own], views[1][~own]))


def score(docs: DataFrame, addresses: DataFrame, model: Model) -> DataFrame:
    """``id, text_score, meta_score, score, kept`` of every row."""
    read = stash(_seen(docs, lambda t: float(model.logit(0, content(t))), "double"), "content-scores")
    met = read.join(addresses, read["id"] == addresses["page"], "left").select("id", F.col("of").alias("text_logit"), "lang", "source", "url", "title", "n_chars", "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(model.logit(1, metadata(*x))) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 8)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["id", "text_logit", "meta_logit"])

    logits = met.mapInArrow(run, "id long, text_logit double, meta_logit double")
    a, b, c = model.mix
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    mixed = sigmoid(a * F.col("text_logit") + b * F.col("meta_logit") + c)
    return logits.select("id", sigmoid(F.col("text_logit")).alias("text_score"), sigmoid(F.col("meta_logit")).alias("meta_score"), mixed.alias("score"), (mixed >= model.threshold).alias("kept"))


def classify(docs: DataFrame, pages: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """Fit on the labels and score every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), "lang", "source", "text")
    addresses = _addresses(pages, url_col)
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("good")).filter("id IS NOT NULL AND good IS NOT NULL")
    return score(texts, addresses, fit(texts, addresses, told))
