"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, each run of as many words in a document is a window. A 64-bit SimHash of the window's
five-word shingles is looked up in an index of the items of that size, cut into four 16-bit blocks: two
fingerprints within `radius` bits agree in some block but for radius // 4 bits, and the index lists each item
under every block value that near, so no fingerprint within the radius is missed. Candidates are verified by the
exact weighted similarity of the shingle counts (sum of the lesser by sum of the greater).

A window without any shingle of any item has similarity 0 to all of them; such windows are not fingerprinted.
That saves the work on nearly all text and can lose nothing that verification would accept.

The items go to the executors in blocks of at most `block` of them, however many there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import U64, Vocabulary, in_arrow, keyed_texts, shingles, word_hashes

K_WORDS, THRESHOLD, RADIUS, BLOCK = 5, 0.8, 19, 1000


def simhash(rows: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHashes of every run of `size` consecutive shingle hashes; ties count as 0."""
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.zeros((len(rows) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[size:] - sums[:-size]
    return np.packbits(2 * ones > size, axis=1).view(U64).ravel()


class ItemIndex:
    """Items of k_words words or more, by number of shingles; for each such size, items by each value of each block
    within the tolerance."""

    @classmethod
    def of(cls, items: list[tuple[int, str]], k_words: int, radius: int) -> list[ItemIndex]:
        """An index for each shingle size: an item of fewer than k_words words has shingles of its own length."""
        by_words, vocabulary = defaultdict(list), Vocabulary()
        for item, text in items:
            by_words[min(k_words, len(word_hashes(text, vocabulary)))].append((item, text))
        return [cls(some, k, radius) for k, some in sorted(by_words.items()) if k]

    def __init__(self, items: list[tuple[int, str]], k_words: int, radius: int):
        vocabulary = Vocabulary()
        self.k_words, self.radius, near = k_words, radius, radius // 4
        self.counts: list[tuple[int, Counter, int]] = []
        self.sizes: dict[int, dict] = {}
        flips = np.array([sum(1 << i for i in c) for e in range(near + 1) for c in combinations(range(16), e)], np.uint16)
        by_size, every = defaultdict(list), []
        for item, text in items:
            w = word_hashes(text, vocabulary)
            s = shingles(w, k_words)
            every.append(s)
            by_size[len(s)].append((len(self.counts), simhash(s, len(s))[0]))
            self.counts.append((item, Counter(s.tolist()), len(w)))
        for size, rows in by_size.items():
            prints = np.array([p for _, p in rows], U64)
            tables = []
            for b in range(4):
                value = ((prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.uint16)
                where = (value[:, None] ^ flips[None, :]).ravel()
                which = np.repeat(np.arange(len(rows), dtype=np.int32), len(flips))
                order = np.argsort(where, kind="stable")
                start = np.searchsorted(where[order], np.arange(65537))
                tables.append((start, which[order]))
            self.sizes[size] = {"number": np.array([n for n, _ in rows]), "prints": prints, "tables": tables}
        self.known = np.unique(np.concatenate(every))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & U64(0xFFFFF)).astype(np.int64)] = True

    def seeds(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.filter[(s & U64(0xFFFFF)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[place] == s[at]]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item number) pairs within the radius, once each."""
        own = self.sizes[size]
        w, i = [], []
        for b, (start, which) in enumerate(own["tables"]):
            value = ((prints >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
            n = start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[value], n)
            w.append(window), i.append(which[place])
        pair = np.unique(np.concatenate(w).astype(np.int64) * len(own["prints"]) + np.concatenate(i))
        window, item = np.divmod(pair, len(own["prints"]))
        close = np.bitwise_count(prints[window] ^ own["prints"][item]) <= self.radius
        return window[close], own["number"][item[close]]

    def search(self, words: np.ndarray, threshold: float, best: dict[int, tuple]) -> None:
        """Notes in best, for each item that a text of these words holds, (-similarity, first word, words) of the
        best window. A text of fewer words than a shingle holds none."""
        s = shingles(words, self.k_words) if len(words) >= self.k_words else words[:0]
        at = self.seeds(s) if len(s) else s
        if not len(at):
            return
        for size in self.sizes:
            span = min(size, len(s))
            near = np.zeros(len(s) + 1, np.int64)
            np.add.at(near, np.maximum(at - span + 1, 0), 1)
            np.add.at(near, np.minimum(at + 1, len(s)), -1)
            starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            starts = starts[starts <= len(s) - span]
            if not len(starts):
                continue
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for at_most in range(0, len(run), 4096):
                    part = run[at_most : at_most + 4096]
                    prints = simhash(s[part[0] : part[-1] + span], span)
                    for window, number in zip(*self.candidates(size, prints)):
                        first = int(part[0] + window)
                        item, counts, n_words = self.counts[number]
                        mine = Counter(s[first : first + span].tolist())
                        both = sum(min(c, counts[h]) for h, c in mine.items() if h in counts)
                        sim = both / (span + size - both)
                        if sim >= threshold and (-sim, first) < best.get(item, (1.0,))[:2]:
                            best[item] = (-sim, first, min(n_words, len(words)))


def search(indexes: list[ItemIndex], text: str, vocabulary: Vocabulary, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window for each item that the text holds."""
    words, best = word_hashes(text, vocabulary), {}
    for index in indexes:
        index.search(words, threshold, best)
    return [(item, -v[0], v[1], v[2]) for item, v in sorted(best.items())]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int):
    """Lists of at most `block` (item_id, text), read one after another."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    held = []
    for r in rows.orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                 k_words=K_WORDS, threshold=THRESHOLD, radius=RADIUS, block=BLOCK, carry=()) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, carried): a row for each row of docs and item that a window
    of it resembles by threshold or more, with the best window (the earliest of equals). carried: the columns named
    by carry as a struct, untouched.

    Null and empty texts and items match nothing, as do texts without words; null doc_ids are carried. A text of
    fewer shingles than an item is one window. An item of fewer than k_words words is one shingle of its own length
    and found wherever these words stand in a row. Items that repeat an id count as one: the better match of either.
    Exact for windows whose fingerprint is within the radius: at similarity 0.8 the expected distance is below
    10 of 64 bits.
    """
    spark, out = docs.sparkSession, None
    texts = keyed_texts(docs, id_col, text_col, carry=carry)
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", long), ("item_id", long), ("similarity", double), ("first_word", long), ("n_words", long))])
    schema = T.StructType([*schema.fields, *texts.schema.fields[2:]])
    names = schema.names
    for items in _item_blocks(benchmark, item_col, item_text_col, block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            indexes, vocabulary = ItemIndex.of(shared.value, k_words, radius), Vocabulary()
            for b in batches:
                found = [(n, d, *m) for n, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for m in search(indexes, t, vocabulary, threshold)]
                row, *columns = list(zip(*found)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                more = [c.take(pa.array(row, pa.int64())) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types)], *more], names)

        found = in_arrow(texts, run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out
