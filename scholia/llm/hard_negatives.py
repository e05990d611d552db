"""Hard negatives by exact search over k-means inverted lists.

Every row lies in the list of its nearest centroid; a list knows its radius, the greatest distance of a row from the
centroid. For a query q, each score of a list lies within |q| * radius of q . centroid (Cauchy-Schwarz). A query visits
lists by their upper bound, skips those whose bounds miss its window of scores, and stops where the bound falls
strictly below the score of its k-th row so far (ties are looked at). So the result is that of all pairs, whatever the
clusters look like.

A visit is a join: queries go in blocks to the parts of the lists that they visit, lists lie in slices of bounded
size, and a pair of a block and a slice is one matrix product. Visits go in rounds of growing numbers of lists, each a
written table; rounds end when no query has a list left to visit. What grows with the data are rows, queries and
visits; the centroids (at most `lists`) are all that tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import in_arrow, stored

#: A component is held to +-2^24 (65,536 before scaling by 256): then 2^15 of them have a product sum within 64 bits.
LIMIT = 1 << 24
#: Centroids are fitted on so many rows at most, those whose hash is least; every row is indexed.
SAMPLE = 20_000
#: Lists: a quarter of the square root of the rows, so many at most.
LISTS = 1024
#: Rows of a slice, and of a part of a list: beyond it a list is dealt to several parts, each visited on its own.
SLICE, PART = 4096, 32_768
#: Queries of a block (a product with a slice holds BLOCK * SLICE scores) and lists visited in the first round; each
#: round visits GROWTH times as many.
BLOCK, FIRST, GROWTH = 256, 4, 4

_EXACT = float(1 << 53)


# ---- vectors -----------------------------------------------------------------------------------


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as int."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    fine = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of int lists as one array; shorter rows end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims).astype(np.int32)
    out = np.zeros((len(lengths), dims), np.int32)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _long(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of int rows: in doubles where no partial sum can leave 2^53, else in 64-bit integers."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    if np.sqrt((a * a).sum(1).max(initial=0.0) * (b * b).sum(1).max(initial=0.0)) < _EXACT / 2:
        return (a @ b.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


# ---- index -------------------------------------------------------------------------------------


class Index:
    """Slices of lists as a written table, and the lists' centroids, radii and numbers of parts."""

    def __init__(self, slices: DataFrame, centroids: np.ndarray, radii: np.ndarray, parts: np.ndarray, dims: int):
        self.slices, self.centroids, self.radii, self.parts, self.dims = slices, centroids, radii, parts, dims


def _centroids(rows: DataFrame, lists: int, dims: int) -> np.ndarray:
    """Of a bounded sample; one list has one centroid, the origin."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if lists == 1:
        return np.zeros((1, dims), np.float64)
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE)
    model = KMeans(k=lists, maxIter=8, initSteps=1, seed=7).fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters(), np.float64)


def build(rows: DataFrame, lists: int | None = None) -> Index | None:
    """An index of rows (vec_id long, label long, vector array<int>), a table that can be read again; None if it is empty."""
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return None
    padded = rows.select("vec_id", "label", F.concat("vector", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vector"))).alias("vector"))
    centroids = _centroids(padded, lists or min(max(isqrt(n) // 4, 1), LISTS), dims)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centroids * centroids).sum(1)
        for b in batches:
            if b.num_rows:
                m = _matrix(b["vector"], dims).astype(np.float64)
                home = np.argmin(squares - 2 * (m @ centroids.T), axis=1).astype(np.int32)
                far = np.sqrt(((m - centroids[home]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["vector"], pa.array(home), pa.array(far)], names=["vec_id", "label", "vector", "list", "far"])

    at_home = in_arrow(padded, nearest, "vec_id long, label long, vector array<int>, list int, far double")
    at_home = stored(at_home.withColumn("seat", F.monotonically_increasing_id()), "listed")
    radii, parts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in at_home.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each list
        radii[r["list"]], parts[r["list"]] = r["far"], -(-r["n"] // PART)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list and part; those of one part that a batch holds are a slice."""
        for b in batches:
            if b.num_rows:
                place = np.stack([_long(b["list"]), _long(b["part"])])
                cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1), b.num_rows]
                m, ids, labels = _matrix(b["vector"], dims), _long(b["vec_id"]), _long(b["label"])
                spans = [(s, e) for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(place[0, s]) for s, _ in spans], pa.int32()), pa.array([int(place[1, s]) for s, _ in spans], pa.int32()),
                    pa.array([ids[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([labels[s:e].tobytes() for s, e in spans], pa.binary()),
                    pa.array([m[s:e].tobytes() for s, e in spans], pa.binary()),
                ], names=["list", "part", "ids", "labels", "vectors"])

    counts = F.array(*[F.lit(int(p) or 1) for p in parts])
    dealt = at_home.withColumn("part", F.pmod(F.xxhash64("seat"), F.get(counts, F.col("list"))).cast("int")).repartition("list", "part").sortWithinPartitions("list", "part", "seat")
    rows_of_slices = dealt.select("list", "part", "vec_id", "label", "vector")
    slices = stored(_rebatched(rows_of_slices, sliced, "list int, part int, ids binary, labels binary, vectors binary", SLICE), "slices")
    return Index(slices, centroids, radii, parts, dims)


def _rebatched(df: DataFrame, fn, schema: str, size: int) -> DataFrame:
    """fn over batches of `size` rows each, whatever the session's batches are: a task's rows are joined and cut anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            while b.num_rows:
                take = min(size - count, b.num_rows)
                held.append(b.slice(0, take))
                b, count = b.slice(take), count + take
                if count == size:
                    yield from fn(iter([_one(held)]))
                    held, count = [], 0
        if count:
            yield from fn(iter([_one(held)]))

    return in_arrow(df, run, schema)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


# ---- search ------------------------------------------------------------------------------------

#: A query: key, its own id and label, its vector, the window of scores (null: open), whether it seeks its own label.
QUERY = ["query", "own", "label", "vector", "low", "high"]
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


def _visits(state: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """(list, part, block): blocks of queries for the lists that are begin-th to end-th in each query's own order."""
    centroids, radii, parts, dims = index.centroids, index.radii, index.parts, index.dims
    full = np.flatnonzero(parts)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b["vector"], dims)
            low, high, kth = _long(b["low"], _LOWEST), _long(b["high"], _HIGHEST), _long(b["kth"], _LOWEST)
            middle = q.astype(np.float64) @ centroids[full].T
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
            # rounding may not close a list that holds a row of the result
            reach = norm * radii[full] * (1 + 1e-9) + 1e-9 * (np.abs(middle) + norm * np.linalg.norm(centroids[full], axis=1)) + 1e-6
            upper = np.where((middle + reach >= low[:, None]) & (middle - reach <= high[:, None]), middle + reach, -np.inf)
            order = np.argsort(-upper, axis=1, kind="stable")[:, begin:end]
            bound = np.take_along_axis(upper, order, 1)
            visited = np.isfinite(bound) & (bound >= kth[:, None])
            members = [_long(b["query"]), _long(b["own"]), _long(b["label"]), low, high, kth]
            out = {"list": [], "part": [], "block": []}
            who, which = np.nonzero(visited)
            there = order[who, which]
            for at in np.unique(there):
                mine = who[there == at]
                block = b"".join([*(np.ascontiguousarray(c[mine]).tobytes() for c in members), q[mine].tobytes()])
                for p in range(int(parts[full[at]])):
                    out["list"].append(int(full[at]))
                    out["part"].append(p)
                    out["block"].append(block)
            yield pa.RecordBatch.from_arrays([pa.array(out["list"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["block"], pa.binary())], names=list(out))

    return _rebatched(state.select(*QUERY, "kth"), plan, "list int, part int, block binary", BLOCK)


def _scores(pairs: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """(query, vec_id, score): of every pair of a block and a slice the k best rows of each query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, labels, vectors in zip(b["block"], b["ids"], b["labels"], b["vectors"]):
                raw = block.as_py()
                m = len(raw) // (6 * 8 + 4 * dims)
                query, own, label, low, high, kth = np.frombuffer(raw, np.int64, 6 * m).reshape(6, m)
                q = np.frombuffer(raw, np.int32, m * dims, 6 * 8 * m).reshape(m, dims)
                ids, labels = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(labels.as_py(), np.int64)
                s = _products(q, np.frombuffer(vectors.as_py(), np.int32).reshape(len(ids), dims))
                alike = label[:, None] == labels[None, :]
                fits = (alike & (own[:, None] != ids[None, :]) if same else ~alike) & (s >= np.maximum(low, kth)[:, None]) & (s <= high[:, None])
                if same and k < len(ids):  # most rows of a slice are far below the k-th of their query: one cut for all
                    floor = np.partition(np.where(fits, s, _LOWEST), len(ids) - k, axis=1)[:, len(ids) - k]
                    fits &= s >= floor[:, None]
                who, row = np.nonzero(fits)
                best = s[who, row]
                order = np.lexsort((ids[row], -best, who))
                who, row, best = who[order], row[order], best[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                top = place < k
                yield pa.RecordBatch.from_arrays([pa.array(query[who[top]]), pa.array(ids[row[top]]), pa.array(best[top])], names=["query", "vec_id", "score"])

    return in_arrow(pairs, score, "query long, vec_id long, score long")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, rank, vec_id, score): for each query the k best rows of its own label (same) or of all others, within
    its window; higher scores first, ties by smaller vec_id. queries: a table with the columns of QUERY."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found, begin, width = None, 0, FIRST
    while found is None or begin < len(index.centroids):
        if found is None:
            state = queries.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            state = queries.join(kth, "query", "left")
        visits = stored(_visits(state, index, begin, begin + width), "visits")
        if found is not None and not visits.take(1):
            break
        new = _scores(visits.join(index.slices, ["list", "part"]).select("block", "ids", "labels", "vectors"), index.dims, k, same)
        every = new if found is None else new.union(found.select("query", "vec_id", "score"))
        found = stored(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        begin, width = begin + width, width * GROWTH
    return found


# ---- mining ------------------------------------------------------------------------------------


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, lists: int | None = None,
) -> DataFrame:
    """For each anchor (a row for which `anchor`, a condition on rows' columns, holds) and each of its best `positives`
    rows of its label, the best `negatives` rows of other labels that score low to high tenths of the positive.

    Rows without id or label, or whose vector is null, empty or has a null or non-finite component, take no part.
    Rows that repeat wholly are one anchor, but each can be found; an anchor does not find rows of its own id as
    positives. Shorter vectors end in zeros. Without anchors, positives or negatives there are no rows; other columns
    are not looked at.
    """
    used = rows.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    kept = stored(used.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")), "vectors")
    index = build(kept, lists)
    empty = kept.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if index is None:
        return empty
    anchors = kept.filter("anchor").select(F.col("vec_id").alias("own"), "label", "vector").distinct()
    anchors = stored(anchors.select(F.monotonically_increasing_id().alias("query"), "own", "label", "vector", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")), "anchors")
    positive = search(index, anchors, positives, True).filter("score >= 0")  # below 0 the window is empty
    tenths = lambda n, up: (F.expr("score DIV 10") * n + F.expr(f"((score % 10) * {n} + {9 if up else 0}) DIV 10"))
    windows = positive.select("query", "score").distinct().select("query", "score", tenths(low, True).alias("low"), tenths(high, False).alias("high"))
    asked = stored(anchors.select(F.col("query").alias("of"), "own", "label", "vector").join(windows.withColumnRenamed("query", "of"), "of")
                   .select(F.monotonically_increasing_id().alias("query"), "of", "score", "own", "label", "vector", "low", "high"), "windows")
    negative = search(index, asked.select(*QUERY), negatives, False).select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positive.select(F.col("query").alias("of"), F.col("vec_id").alias("positive_id"), "score")
    return asked.select("query", "of", "score", F.col("own").alias("anchor_id")).join(pairs, ["of", "score"]).join(negative, "query").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )
