"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte trigrams and 4-grams of the lower-cased text, hashed to ``BUCKETS`` rows of an embedding; a text is
the average over all its subwords, a linear softmax gives the languages. Both layers are trained together by stochastic
gradient descent in numpy on a bounded, hash-chosen sample of different whole labelled texts, rare languages first. As everything is linear up to the
softmax, embedding times weights is one small table, and a text's score is a histogram of its subwords times that table.
A tenth of the sample is kept from training to fit the temperature of the softmax and the score under which a
prediction is rejected (``accepted`` false; the language is still given).

Defined cases. Null text, or one without a letter: ``und``, score 0, not accepted. No labelled row: everything is ``und``. Very
long texts are read whole. Repeated rows: same answer. Null ids: predicted. Empty table: empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
DIM = 16
#: Different labelled texts that the fit uses, at most (about).
TRAIN_ROWS = 2_500
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.5, 6
#: Share of right predictions on the kept rows that the rejection threshold lets pass.
PASS_RATE = 0.995
UNKNOWN = "und"


def subwords(text: str) -> np.ndarray:
    """Bucket counts of the text's subwords."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    b = np.where((b >= 9) & (b <= 13), np.uint32(32), b)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    three = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    four = three[:-1] * np.uint32(0x27D4EB2F) ^ b[3:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(three * np.uint32(0x2545F491) >> shift, minlength=BUCKETS)
    return counts + np.bincount(four * np.uint32(0x2545F491) >> shift, minlength=BUCKETS)


def average(counts: np.ndarray) -> np.ndarray:
    """Shares of the subwords, scaled so that a bucket's usual value is near one."""
    return (counts * (BUCKETS / max(1, counts.sum()))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        p = _softmax((average(subwords(text)) @ self.table + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, labels: list[str]) -> Model:
    """Fit on averaged subwords ``x``; the order of the rows decides nothing but the batches."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.searchsorted(languages, labels)
    rng = np.random.Generator(np.random.PCG64(SEED))
    shuffled = rng.permutation(len(y))
    held, fit = (shuffled[: len(y) // 10], shuffled[len(y) // 10 :]) if len(y) >= 50 else (shuffled, shuffled)
    embedding = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    one_hot = np.eye(len(languages), dtype=np.float32)[y]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            hidden = x[at] @ embedding / BUCKETS**0.5
            off = (_softmax(hidden @ weights + bias) - one_hot[at]) / len(at)
            back = off @ weights.T
            weights -= rate * hidden.T @ off
            bias -= rate * off.sum(0)
            embedding -= rate * (x[at].T @ back) / BUCKETS**0.5
    table = (embedding @ weights / BUCKETS**0.5).astype(np.float32)
    z = x[held] @ table + bias
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.1, 10, 41)), key=loss)
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(languages, table, bias, temperature, float(np.quantile(right, 1 - PASS_RATE)) if len(right) else 1.0)


def shares(counts: dict[str, int], most_rows: int) -> dict[str, float]:
    """Share of each language's texts to take, so that rare ones are taken whole and the others get equal parts of what is left."""
    left, out = most_rows, {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(1.0, left / (len(counts) - k) / n)
        left -= out[lang] * n
    return out


def fit(labelled: DataFrame, text: Column, lang: Column, most_rows: int = TRAIN_ROWS) -> Model:
    """Train on about ``most_rows`` different texts with a language and a letter, or all if there are fewer; a hash of the text chooses them.

    Different texts are counted by language (hashes alone are shuffled, copies meet before), so that copies neither shrink the sample nor fill it.
    """
    step = 1 << 31
    rows = labelled.select(text.alias("text"), lang.alias("lang"), F.xxhash64(text, F.lit(SEED)).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang", "h").count().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    told = rows.sparkSession.createDataFrame([(k, int(step * v)) for k, v in shares(counts, most_rows).items()], "lang string, least long")
    sample = rows.join(F.broadcast(told), "lang").filter(F.pmod("h", F.lit(step)) < F.col("least")).select("text", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, values = [], [], []
            for text_, lang_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if any(map(str.isalpha, text_)):
                    counts = subwords(text_)
                    at = np.flatnonzero(counts)
                    langs.append(lang_)
                    places.append(at.astype("<u2").tobytes())
                    values.append(counts[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "counts"])

    got = sample.mapInArrow(run, "lang string, at binary, counts binary").collect()  # bounded by most_rows
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["counts"])))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["counts"], "<f4")
        x[k] = average(x[k])
    return train(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, accepted`` of every row, from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            if found:
                langs, scores, accepted = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")
