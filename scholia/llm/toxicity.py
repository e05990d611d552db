"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Fit: presence of hashed character n-grams, the log ratio r of their smoothed shares in the two classes
(Wang and Manning, 2012), then a logistic regression on presence * r, all on a bounded sample of labelled
rows on the driver. Score: the model (one float per hash slot) goes to the executors, which read whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import in_arrow, keyed_texts

_SPACE = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Toxicity:
    """weights: a float for each of 2**bits hash slots, 0 where the slot is no feature; sizes: n-gram lengths."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20

    def score(self, text: str) -> float:
        slots = [s[self.weights[s] != 0] for s in slots_of(text, self.sizes, self.bits)]
        z = self.bias + float(self.weights[np.unique(np.concatenate(slots))].sum()) if slots else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def slots_of(text: str, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """The hash slots of the character n-grams of a whole text, an array for each length: lower case, other
    than letters and digits read as one space, a space at either end."""
    flat = " " + _SPACE.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(max(sizes), len(c)) + 1):
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in sizes:
                x = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                out.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return out


def fit(texts: list[str], labels: list[int], sizes=(3, 4, 5, 6), bits=20, alpha=0.5, l2=0.2, steps=300, features=4096, errors=3.0, least=64) -> Toxicity:
    """Naive Bayes log-count ratios of presence, then a logistic regression on presence * ratio over the slots whose
    ratios lie most standard errors from 0: at most `features` of them, those of over `errors` errors, but `least` at
    least (what chance alone gives would drown a single telling word). Without both classes in the labels the score
    is the smoothed share of ones everywhere."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Toxicity(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), tuple(sizes), bits)
    rows = [np.unique(np.concatenate(slots_of(t, sizes, bits) or [np.zeros(0, np.int64)])).astype(np.int32) for t in texts]
    ones, zeros = np.zeros(1 << bits), np.zeros(1 << bits)
    for slots, label in zip(rows, y):
        (ones if label else zeros)[slots] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    r = np.log((ones + alpha) / (n1 + 2 * alpha)) - np.log((zeros + alpha) / (n0 + 2 * alpha))
    z = np.abs(r) / np.sqrt(1 / (ones + alpha) + 1 / (zeros + alpha))
    z[ones + zeros < 3] = 0.0
    best = np.argsort(-z, kind="stable")[:features]
    far = z[best] > errors
    far[:least] = z[best[:least]] > 0
    chosen = np.zeros(1 << bits, bool)
    chosen[best[far]] = True
    rows = [slots[chosen[slots]] for slots in rows]
    at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(slots) for slots in rows])
    place = np.cumsum(chosen) - 1
    col, x, size = place[at], r[at], int(chosen.sum())
    w, b = np.zeros(size), float(np.log(n1 / n0))
    m_w, v_w, m_b, v_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam over the whole sample: the same labels give the same model
        g = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * x, len(y)) + b, -30, 30))) - y) / len(y)
        gw, gb = np.bincount(col, g[row] * x, size) + l2 * w / len(y), g.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * gw, 0.999 * v_w + 0.001 * gw * gw
        m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m_w / c1) / (np.sqrt(v_w / c2) + 1e-10)
        b -= 0.05 * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-10)
    weights = np.zeros(1 << bits, np.float32)
    weights[chosen] = w * r[chosen]
    return Toxicity(weights, float(b), tuple(sizes), bits)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", sample=4000, sample_chars=12_000_000) -> Toxicity:
    """Fits on at most `sample` labelled rows (the least by a hash of the id) outside the held-out third,
    as far as their texts together stay under `sample_chars` code points, whole texts only: a text that does not
    fit is passed over, and the next ones are taken as far as they do.

    Rows whose id, text or label is null are not learnt from. Of several labels for an id each counts. Where there
    are labelled texts, but none of one class, there is nothing to learn: ValueError, if any class was passed over
    for its length, and else a model that scores every text alike.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample)
    )
    texts = keyed_texts(docs.filter(F.col(text_col).isNotNull()), id_col, text_col)
    rows = texts.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("doc_id"))  # at most `sample` ids
    rows = rows.withColumn("size", F.length("text")).orderBy("h", "doc_id", "y").limit(sample)
    kept, room, passed = [], sample_chars, set()
    for r in rows.withColumn("text", F.when(F.col("size") <= sample_chars, F.col("text"))).toLocalIterator():
        if r["size"] > room:
            passed.add(r["y"])
            continue
        room -= r["size"]
        kept.append((r["text"], r["y"]))
    if passed - {y for _, y in kept}:
        raise ValueError(f"no labelled text of class {min(passed - {y for _, y in kept})} fits into {sample_chars} code points")
    return fit([t for t, _ in kept], [y for _, y in kept])


def score(docs: DataFrame, model: Toxicity, *, id_col="doc_id", text_col="text", threshold=0.7, carry=()) -> DataFrame:
    """(doc_id, held_out, score, predicted, carried), a row for each row of docs. Null and empty texts have the
    score of a text without features; a null id is not held out. Repeated rows are scored alike. carried: the
    columns named by carry as a struct, untouched."""
    rows = keyed_texts(docs, id_col, text_col, carry=carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.array([m.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[2:]], ["doc_id", "score", *b.schema.names[2:]])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *rows.schema.fields[2:]])
    out = in_arrow(rows, run, schema)
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *rows.columns[2:],
    )
