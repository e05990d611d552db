"""Mixture-controlled packing: deficit round-robin over source queues into sequences of a fixed length.

Every source is a queue of its documents' tokens. A window of `window` tokens visits each queue once and takes
its share: what the target proportions have promised it up to the end of this window less what it was served
before - the deficit it carries, always under one token. When a queue is empty its share goes to the others in
proportion. The tokens up to window w are a closed form of w (see Schedule), so any task can lay out any
document on its own, and deficits carry across windows and partitions without a pass over the windows.
Documents are cut where a window, a share or a sequence ends; every sequence is full but for the remainder of
the whole, which is cut into powers of two.

Tokens are made once, in the order of the input's partitions, and written to the shared folder, with running
counts for each queue of the partition; the offset of a partition in a queue is a window sum over (partition,
queue) totals. No shuffle moves tokens or texts.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import BROADCAST_ROWS, in_arrow, keyed_texts, shared_dir, stored

LENGTH, WINDOW, QUEUES, END = 1024, 32 * 1024, 1024, 0


@dataclass(frozen=True)
class Schedule:
    """totals: tokens of each queue; weights: its target share (integers). Token k of queue s is due at time
    (k + 1/2) / weight[s]; served(n) tells how many tokens of each queue are among the n that are due first,
    ties by the queue's number. All arithmetic is exact, on Python integers."""

    totals: tuple[int, ...]
    weights: tuple[int, ...]

    def served(self, n: int) -> list[int]:
        total = sum(self.totals)
        if n >= total:
            return list(self.totals)
        order = sorted(range(len(self.totals)), key=lambda s: self.totals[s] * 1.0 / self.weights[s])
        rest, rate = n, sum(self.weights)
        for s in order:  # queues that are empty before time num / den
            if self.totals[s] * rate > rest * self.weights[s]:
                break
            rest, rate = rest - self.totals[s], rate - self.weights[s]
        num, den = rest, rate
        got = [min(t, (2 * w * num + den) // (2 * den)) for t, w in zip(self.totals, self.weights)]
        over = sum(got) - n
        due = lambda twice, s: (twice << 128) // self.weights[s]  # noqa: E731  fine enough to tell any two times apart
        while over:
            if over > 0:
                s = max((s for s in range(len(got)) if got[s]), key=lambda s: (due(2 * got[s] - 1, s), s))
                got[s] -= 1
                over -= 1
            else:
                s = min((s for s in range(len(got)) if got[s] < self.totals[s]), key=lambda s: (due(2 * got[s] + 1, s), s))
                got[s] += 1
                over += 1
        return got


class Layout:
    """Places of a queue's tokens in the whole, by window; keeps the windows it was last asked for."""

    def __init__(self, schedule: Schedule, window: int):
        self.schedule, self.window, self.total = schedule, window, sum(schedule.totals)
        self.held: dict[int, list[int]] = {}

    def at(self, w: int) -> list[int]:
        if w not in self.held:
            if len(self.held) > 4096:
                self.held.clear()
            self.held[w] = self.schedule.served(min(self.total, w * self.window))
        return self.held[w]

    def runs(self, queue: int, start: int, stop: int):
        """(place in the whole, length) of the tokens [start, stop) of a queue, cut where windows end."""
        lo, hi = 0, -(-self.total // self.window)
        guess = int(start / max(1, self.schedule.totals[queue]) * hi)
        for step in (2, 16, 256):  # the share is nearly even over time
            a, b = max(0, guess - step), min(hi, guess + step)
            if self.at(a)[queue] <= start < self.at(b)[queue]:
                lo, hi = a, b
                break
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.at(mid)[queue] <= start else (lo, mid)
        w = lo
        while start < stop:
            before, after = self.at(w), self.at(w + 1)
            end = min(stop, after[queue])
            if end > start:
                base = w * self.window + sum(after[s] - before[s] for s in range(queue))
                yield base + start - before[queue], end - start
                start = end
            w += 1


def tail_cuts(total: int, length: int) -> list[int]:
    """Where sequences after the last full one begin: its remainder in falling powers of two, then the end."""
    cuts, at = [], total - total % length
    for p in range(length.bit_length(), -1, -1):
        if (total % length) >> p & 1:
            cuts.append(at)
            at += 1 << p
    return [*cuts, total]


class Encoder:
    """Token ids as little-endian 16- or 32-bit bytes; keeps the ids of words, up to a bounded number.

    Words are kept only if the vocabulary's file says that it parts words by the byte-level pattern and does nothing
    before; texts that hold one of its added tokens, and all texts of other vocabularies, are encoded as a whole.

    A Python worker has one for each vocabulary, so that what one task has learnt serves the next."""

    held: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str, limit: int = 1_200_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        self.by_words = told.get("normalizer") is None and told["model"]["type"] == "BPE" and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}
        added = [re.escape(t["content"]) for t in told.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        # fixed values: the pattern by which byte-level pre-tokenisers part words
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.ascii_parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
        self.separator = self._separator(told.get("added_tokens", []))
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.limit = limit

    @staticmethod
    def _separator(added: list[dict]) -> tuple[str, int] | None:
        """The one added token, if words can stand on either side of it and only it be found between them."""
        if len(added) != 1 or any(added[0].get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        text = added[0]["content"]
        return None if any(text.startswith(text[k:]) for k in range(1, len(text))) else (text, added[0]["id"])

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, of a call for all of them."""
        if self.separator is None:
            return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        mark, number = self.separator
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids, self.type)
        size, ends = ids.itemsize, [*np.flatnonzero(ids == number).tolist(), len(ids)]
        held = ids.tobytes()
        return [held[a * size : b * size] for a, b in zip([0, *(x + 1 for x in ends[:-1])], ends)]

    def __call__(self, text: str) -> bytes:
        if not self.by_words or self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        parts, known = (self.ascii_parts if text.isascii() else self.parts)(text), self.known
        ids = list(map(known.get, parts))
        if None in ids:
            new = list({p for p, x in zip(parts, ids) if x is None})
            if len(known) + len(new) > self.limit:
                known.clear()
                new = list(set(parts))
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                known.update(zip(some, self._words(some), strict=True))
            ids = [known[p] for p in parts]
        return b"".join(ids)


def source_queues(docs: DataFrame, source_col: str, queues: int) -> dict[str | None, int] | None:
    """The queue of each source, by name; None where there are more than `queues` sources."""
    names = [r[0] for r in docs.select(F.col(source_col).cast("string")).distinct().limit(queues + 1).collect()]
    return {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is not None, n or "")))} if len(names) <= queues else None


def encoded(docs: DataFrame, tokenizer: str, known: dict[str | None, int] | None, *, id_col="doc_id", text_col="text", source_col="source", queues=QUEUES) -> DataFrame:
    """(doc_id, queue, part, before, tokens, wide): stored. before: the queue's tokens earlier in the partition."""
    if known is not None:
        number = F.coalesce(*[F.when(F.col(source_col).cast("string").eqNullSafe(F.lit(n)), F.lit(i)) for n, i in known.items()], F.lit(0)) if known else F.lit(0)
        if len(known) > 64:  # a long chain of comparisons: a map instead
            pairs = [x for n, i in known.items() if n is not None for x in (F.lit(n), F.lit(i))]
            number = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(source_col).cast("string")), F.lit(known.get(None, 0)))
    else:
        number = F.pmod(F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))), F.lit(queues)).cast("int")
    rows = keyed_texts(docs.withColumn("__queue", number), id_col, text_col, "__queue")
    rows = rows.select("doc_id", "text", F.col("__queue").alias("queue"), F.spark_partition_id().alias("part"))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, before = Encoder.of(tokenizer), {}
        end = np.array([END], encode.type).tobytes()
        size = len(end)
        for b in batches:
            ids, at = [], []
            for t, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(encode(t) + end)
                at.append(before.get(q, 0))
                before[q] = at[-1] + len(ids[-1]) // size
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(at, pa.int64()), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "before", "n", "ids"],
            )

    return stored(in_arrow(rows, run, "doc_id long, queue int, part int, before long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", source_col="source", proportions: dict | None = None,
         length=LENGTH, window=WINDOW, queues=QUEUES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue): a row for each piece.

    proportions: source to target weight (a positive number, None names the null source); as a rule the shares of the
    tokens that the sources hold, so that all queues end together. A source that proportions leaves out is an error,
    as are proportions for more than `queues` sources. Without them, sources beyond that number share queues by a
    hash: queues keep their proportions, sources within a queue come as they lie. Null texts are empty: their one token is the closing id. Null sources are a queue. Rows that
    share an id are packed one by one. An empty table has no pieces.
    """
    spark = docs.sparkSession
    known = source_queues(docs, source_col, queues)
    if proportions is not None:
        if known is None:
            raise ValueError(f"proportions are kept for at most {queues} sources")
        if lacking := [n for n in known if not proportions.get(n, 0) > 0]:
            raise ValueError(f"no proportion for the sources {lacking}")
        proportions = {q: proportions[n] for n, q in known.items()}
    tokens = encoded(docs, tokenizer, known, id_col=id_col, text_col=text_col, source_col=source_col, queues=queues)
    sums = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("sum")), "token-sums")
    totals = {r["queue"]: r["t"] for r in sums.groupBy("queue").agg(F.sum("sum").alias("t")).collect()}  # at most `queues` rows
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")
    rank = {q: i for i, q in enumerate(sorted(totals))}
    weight = lambda q: totals[q] if proportions is None else max(1, round(proportions[q] * 10**9))
    schedule = Schedule(tuple(totals[q] for q in rank), tuple(weight(q) for q in rank))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    total = sum(totals.values())
    cuts, full = tail_cuts(total, length), total - total % length

    def run(batches):
        layout = Layout(schedule, window)

        def pieces(place, n):
            """(sequence, offset, length) of a run of the whole."""
            while n:
                if place < full:
                    seq, off = divmod(place, length)
                    room = length - off
                else:
                    k = bisect_right(cuts, place) - 1
                    seq, off, room = full // length + k, place - cuts[k], cuts[k + 1] - place
                take = min(n, room)
                yield seq, off, take
                place, n = place + take, n - take

        for b in batches:
            out = [[] for _ in range(8)]
            for doc, q, at, n, ids in zip(*(b.column(c).to_pylist() for c in range(5))):
                words = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                start = 0
                for place, run_length in layout.runs(rank[q], at, at + n):
                    for seq, off, take in pieces(place, run_length):
                        for c, v in zip(out, (doc, start, take, zlib.crc32(words[start : start + take].tobytes()), n, seq, off, q)):
                            c.append(v)
                        start += take
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.int32())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"
    return in_arrow(placed, run, schema)
