"""What the training-data operators share: stored tables, word shingles, integer mixing, components.

Every operator here takes the names of its id and text columns, selects only those, and gives them
inner names at once, so extra or clashing columns of the input never meet its own.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: texts may be long, and a batch is held in a Python worker at once.
BATCH_ROWS = 512
#: Rows of a table that may be broadcast; a caller counts first and shuffles beyond it.
BROADCAST_ROWS = 200_000

WORD = re.compile(r"\w+")
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# ---- storage -----------------------------------------------------------------------------------


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session takes a
    temporary folder, and any other has an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """What stored() writes inside goes to a folder of its own, which is deleted at the end: by then the caller has
    written whatever reads it."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        deleted(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete what stored() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        deleted(df.sparkSession, path)


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, *more: str, carry=()) -> DataFrame:
    """Columns doc_id (long), text (null: empty), any more that the caller names, and carried, a struct of the
    columns to carry along if there are any."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
        *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []),
    )


def in_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """fn over df; at its end a worker gives back what it freed, for it lives on and runs the next stage."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            freed()

    tuned(df.sparkSession)
    return df.mapInArrow(run, schema)


def freed() -> None:
    """Free memory goes back to the system: Arrow's pool and, where it can, that of the C library."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- words, shingles, hashes -------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x + _GOLD) * U64(1)
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


class Vocabulary(dict):
    """word -> 64-bit hash; the table is emptied when it holds `limit` words, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """Hashes of the words of a text: maximal runs of word characters, lower-cased."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(vocabulary.__getitem__, words), U64, len(words))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of every run of `size` words; a shorter text is one shingle, a text without words has none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < size:
            h = U64(n)
            for w in words:
                h = h * U64(0x100000001B3) + w
            return mix(np.array([h], U64))
        h = words[: n - size + 1].copy()
        for k in range(1, size):
            h = h * U64(0x9FB21C651E98DF25) + words[k : n - size + 1 + k]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- connected components ----------------------------------------------------------------------


def components(links: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(id, root): for each id that a link names, the least id of its component.

    Alternating large and small stars: every step joins an edge list with one minimum per node, minima are
    combined before they are shuffled, and no component is gathered anywhere. Each step is a written table. The
    end is reached when the list is a forest of stars: no node has two parents, and no parent has one.
    Null ends and self links are ignored; an empty list of links has an empty result.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        name,
    )

    def forest(edges: DataFrame) -> bool:
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
        return not ends.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c + p > 1 AND c > 0").take(1)

    while not forest(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stored(large, name)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        nxt = stored(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(root.select("u", F.col("m").alias("v")))
            .distinct(),
            name,
        )
        discard(edges)
        discard(large)
        edges = nxt
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
