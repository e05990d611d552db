"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, hashes are
joined over the corpus, and sentences that a repeated run covers go unless the run is the first of its kind.

A sentence ends with marks that hold ., ! or ? before white space, or at a newline; a sentence of more than `longest` words is
read in parts that end after words whose hash is the least among their neighbours, so that a passage falls into the same parts
wherever it stands in a sentence. From each part on, the run that is hashed is the shortest of three or more
parts with min_words words or more: a short phrase that recurs by chance is none. Words are compared lower-cased,
without what stands between them.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import U64, WORD, discard, in_arrow, keyed_texts, mix, signed, stored

RUN, MIN_WORDS, LONGEST, NEAR = 3, 20, 10, 3
_BASE = U64(0x9FB21C651E98DF25)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
# A newline, or the rest of a run of marks from its first ., ! or ? on: each run is looked at once.
_STOP = re.compile(r"[.!?\n](?:(?<=\n)|[^\w\s]*+)")


def sentences(text: str) -> list[str]:
    """Parts that add up to the text; a sentence ends with marks that hold ., ! or ?, or with a newline."""
    ends = [e for m in _STOP.finditer(text) if (e := m.end()) == len(text) or text[e].isspace() or text[e - 1] == "\n"]
    cuts = [0, *ends] if ends and ends[-1] == len(text) else [0, *ends, len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


class _Hashes(dict):
    """Hashes of words, of a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hash_of = _Hashes().__getitem__
# So many words, each with what follows up to the next one.
_WORDS = functools.cache(lambda n: re.compile(rf"(?:\w++\W++){{{n}}}"))


def cut_words(words: list[str], longest: int) -> list[int]:
    """Where the parts of a long sentence end: after words whose hash is the least within NEAR words on both sides (of
    equal ones the first), so that NEAR words of context decide; without such a word, after `longest` words. The last part
    may have NEAR + 1 words more."""
    hashes = list(map(_hash_of, words))
    ends, last, stop = [], 0, len(words) - NEAR - 1
    low = [i for i, (x, h, y) in enumerate(zip(hashes, hashes[1:], hashes[2:]), 1) if x > h <= y]
    for c in [*[i for i in low if NEAR <= i < stop and hashes[i] < min(hashes[i - NEAR : i]) and hashes[i] <= min(hashes[i + 1 : i + NEAR + 1])], stop]:
        while (i := max(NEAR, last, last + longest - 1)) < c:
            ends.append(i + 1)
            last = i + 1
        if c < stop:
            ends.append(c + 1)
            last = c + 1
    return ends


def pieces(text: str, longest: int = LONGEST) -> tuple[list[str], list[int], np.ndarray]:
    """(parts, words, hashes): parts of the text that add up to it, how many words each has, two hashes of them.
    A part without words goes with the one before it, or the one after it at the start of the text."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    parts: list[str] = []
    words: list[int] = []
    hashes: list[bytes] = []
    open_front = ""
    for sentence in sentences(text):
        low = sentence.lower()
        found = WORD.findall(low)
        if not found:
            if parts:
                parts[-1] += sentence
            else:
                open_front += sentence
            continue
        if len(found) <= longest:
            cuts = [(sentence, found)]
        else:
            # lower-casing may rarely change where words end; where it leaves each code point one, it does not
            starts = None if len(low) == len(sentence) else [m.start() for m in WORD.finditer(sentence)]
            if starts is None or len(starts) == len(found):
                ends = cut_words(found, longest)
                places = [0, *ends, len(found)]
                if starts is None:
                    at, here = [0], WORD.search(sentence).start()
                    for i, j in zip(places, ends):
                        here = _WORDS(j - i).match(sentence, here).end()
                        at.append(here)
                    at.append(len(sentence))
                else:
                    at = [0, *[starts[i] for i in ends], len(sentence)]
                cuts = [(sentence[a:b], found[i:j]) for a, b, i, j in zip(at, at[1:], places, places[1:])]
            else:
                cuts = [(sentence, found)]
        for part, own in cuts:
            parts.append(open_front + part)
            open_front = ""
            words.append(len(own))
            hashes.append(digest(" ".join(own).encode("utf-8", "surrogatepass")))
    if open_front:
        parts.append(open_front), words.append(0), hashes.append(bytes(16))
    return parts, words, np.frombuffer(b"".join(hashes), U64).reshape(-1, 2)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse."""
    return tuple(np.multiply.accumulate(np.append(U64(1), np.full(n, x, U64))) for x in (_BASE, _INVERSE))


def runs(words: list[int], hashes: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first part, end, hash, check) of the shortest run of `run` parts or more with min_words words or more from each
    part on; the last parts of a text have none."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(n)
    end = np.maximum(first + run, np.searchsorted(total, total[:-1] + min_words)) if n else first
    first, end = first[end <= n], end[end <= n]
    with np.errstate(over="ignore"):
        power, back = (x[: n + 1] for x in (_powers(1 << n.bit_length()) if n < 1 << 16 else _powers.__wrapped__(n)))
        both = []
        for one in hashes.T:
            sums = np.append(U64(0), np.cumsum(mix(one) * power[:-1]))
            both.append(mix((sums[end] - sums[first]) * back[first] + (end - first).astype(U64)))
    return first, end, *both


def substring_dedup(docs: DataFrame, *, id_col="doc_id", text_col="text", run=RUN, min_words=MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_removed, removed): a row for each row of docs; removed: numbers (from 0) of the
    parts that went. The first of equal runs, by (doc_id, text's hash, place), covers nothing; all others do, in the
    same document too. A passage with fewer than min_words words in whole parts is never compared. Runs are told
    apart by 96 bits.

    Null and empty texts have no parts and become empty. A document is an id with a text: rows that share both lose
    the same parts, rows that share an id but not the text are documents of their own, and so are rows with a null
    id, which come after all others.
    """
    texts = keyed_texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))

    def hashed(batches):
        for b in batches:
            numbers, places, hashes, checks = [], [], [], []
            for n, text in enumerate(b.column(1).to_pylist()):
                _, words, h = pieces(text)
                at, _, own, check = runs(words, h, run, min_words)
                numbers.append(np.full(len(at), n)), places.append(at), hashes.append(own), checks.append(check)
            if numbers:
                rows = pa.array(np.concatenate(numbers).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(hashes))), pa.array((np.concatenate(checks) >> U64(32)).astype(np.uint32).view(np.int32)), b.column(0).take(rows), b.column(2).take(rows), pa.array(np.concatenate(places).astype(np.int32))],
                    ["hash", "check", "id", "version", "place"])

    spans = stored(in_arrow(texts, hashed, "hash long, check int, id long, version long, place int"), "spans")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "version", "place")).alias("first")
    repeated = spans.groupBy("hash", "check").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.version") == F.col("version")) & (F.col("first.place") == F.col("place"))
    later = spans.join(repeated.select("hash", "check", "first"), ["hash", "check"]).filter(~is_first)
    marks = later.groupBy(F.col("id").alias("marked"), F.col("version").alias("marked_version")).agg(F.collect_set("place").alias("places"))
    marks = stored(marks, "marks").hint("shuffle_hash")
    discard(spans)  # before the texts are shuffled
    joined = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("marked")) & (F.col("version") == F.col("marked_version")), "left").select("doc_id", "text", "places")

    def rewritten(batches):
        for b in batches:
            new, removed = [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone: list[int] = []
                if places:
                    parts, words, h = pieces(text)
                    end = dict(zip(*(x.tolist() for x in runs(words, h, run, min_words)[:2])))
                    lost = {j for p in places for j in range(p, end.get(p, p))}
                    gone = sorted(lost)
                    text = "".join(p for i, p in enumerate(parts) if i not in lost)
                new.append(text), removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(new, pa.string()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32()))],
                ["doc_id", "text", "n_removed", "removed"],
            )

    return in_arrow(joined, rewritten, "doc_id long, text string, n_removed long, removed array<int>")
