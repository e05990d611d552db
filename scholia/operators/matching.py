"""Which texts hold which of many fixed strings: an index of grams instead of a scan for each string.

A needle of LEAST code points or more is looked up by one gram, the one whose hash is least in its first LEAST code
points. A text is cut into the grams that are least in any window of that size (a third of its positions), so it
yields the gram of every needle that it holds. Shorter needles are grams of their own length. Texts and needles meet
on hashes of grams, and what meets is compared: no text meets a needle that it shares no gram with. Where the needles
have no more than FEW grams, tasks hold these (8 bytes each, and a table of bits) and look all grams of a text up there
before the shuffle; beyond it, all grams that a text yields are shuffled. One pass over a text hashes the grams of all sizes.
No more than SCANNED needles are looked for as they are, where the texts lie: nothing is hashed, shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.sources.storage import stored

#: Code points of a gram, and of the window whose least gram is indexed.
GRAM, LEAST = 8, 12
#: Grams of needles that every task may hold; they are counted first.
FEW = 200_000
#: Needles for which a scan each costs less than grams; they are counted first.
SCANNED = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, state) for the sizes up to most: states of every run of that many code points, the next size's from this one's.
    _sealed() states are the runs' hashes; a state holds until the next is asked for."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(points), np.uint64)
    for k in range(min(most, len(points))):
        h = h[: len(points) - k]
        h ^= points[k:]
        h *= _STEP
        h ^= h >> np.uint64(29)
        yield k + 1, h


def _sealed(states: np.ndarray) -> np.ndarray:
    return states * _STEP


def _least(hashes: np.ndarray) -> np.ndarray:
    """The hashes of grams that are least in some window of LEAST code points."""
    span = LEAST - GRAM + 1
    if len(hashes) < span:
        return hashes[:0]
    least = hashes[: len(hashes) - span + 1]
    for k in range(1, span):
        least = np.minimum(least, hashes[k : len(hashes) - span + 1 + k])
    return np.unique(least)


def least_grams(text: str) -> np.ndarray:
    return _least(next((_sealed(h) for n, h in _runs(text, GRAM) if n == GRAM), np.zeros(0, np.uint64)))


class Known:
    """A few hashes of grams, looked up among many: a table of the low bits of their states leaves few to compare."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        bits = max(12, min(22, (8 * len(hashes)).bit_length()))
        self.mask, self.table = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.table[self._place(self.hashes * np.uint64(pow(int(_STEP), -1, 1 << 64)))] = True  # the states: _STEP is odd

    def _place(self, states: np.ndarray) -> np.ndarray:
        return (states & self.mask).view(np.int64)

    def among(self, states: np.ndarray) -> np.ndarray:
        """Those of the hashes whose states occur, each once."""
        found = _sealed(states[self.table[self._place(states)]])
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        seen = np.zeros(len(self.hashes), bool)
        seen[at[self.hashes[at] == found]] = True
        return self.hashes[seen]


def _of_needle(text: str) -> tuple[int, np.ndarray]:
    n = min(len(text), LEAST)
    return n, least_grams(text[:LEAST]) if n == LEAST else next(_sealed(h) for k, h in _runs(text, n) if k == n)


def _of_text(text: str, lengths: tuple[int, ...], only: dict[int, Known] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(size, grams) of a text, each gram once; a text too short for a size has none of it."""
    sizes = [n for n in lengths if n <= len(text)]
    for k, h in _runs(text, max((GRAM if n == LEAST else n for n in sizes), default=0)):
        for n in sizes:
            if k == (GRAM if n == LEAST else n):
                yield n, only[n].among(h) if only is not None else _least(_sealed(h)) if n == LEAST else np.unique(_sealed(h))


def _grams(df: DataFrame, first_only: bool, lengths: tuple[int, ...] = (), only: dict[int, np.ndarray] | None = None) -> DataFrame:
    """df (id, text) as (id, size, gram); size LEAST stands for all needles from LEAST on. only: of each size the grams that
    count; null: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if only is None else {n: Known(g) for n, g in only.items()}
        for b in batches:
            at, sizes, grams = [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                for n, g in [_of_needle(text)] if first_only else _of_text(text, lengths, known):
                    at.append(np.full(len(g), i))
                    sizes.append(np.full(len(g), n, np.int32))
                    grams.append(g)
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(join(at, np.int64))), pa.array(join(sizes, np.int32)), pa.array(join(grams, np.uint64).view(np.int64))], names=["id", "size", "gram"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, size int, gram long")


def holding(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_col: str) -> DataFrame:
    """(id_col, needle_col) for every text and distinct needle that it holds, once for each pair.

    Null texts hold nothing, null and empty needles are in nothing. Rows that share an id hold what any of them holds.
    """
    every = needles.select(F.col(needle_col).alias("text")).filter("text <> ''").distinct()
    held = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    some = [r["text"] for r in every.take(SCANNED + 1)]
    if len(some) <= SCANNED:
        found = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.contains("text", F.lit(n)), F.lit(n)) for n in some]))
        return held.select(F.col("id").alias(id_col), F.explode(found).alias(needle_col)).distinct()
    wanted = stored(_grams(every.withColumn("id", F.col("text")), True).withColumnRenamed("id", "needle"), "needles")
    counts = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count_distinct("gram").alias("n")).collect()}  # a row for each of LEAST sizes at most
    only = None
    if sum(counts.values()) <= FEW:
        grams = wanted.select("size", "gram").distinct().toPandas()
        only = {int(n): g.to_numpy(np.int64).view(np.uint64) for n, g in grams.groupby("size")["gram"]}
    pairs = _grams(held, False, tuple(sorted(counts)), only).join(wanted, ["size", "gram"]).select("id", "needle").distinct()
    return pairs.join(held, "id").filter(F.contains("text", "needle")).select(F.col("id").alias(id_col), F.col("needle").alias(needle_col)).distinct()
