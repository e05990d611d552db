"""Near-duplicate lines: a segment-partition edit-distance join over the lines of a corpus.

Li, Deng and Feng, "PASS-JOIN" (2011): of two lines within `tau` edits, one of the tau + 1 even segments of the
shorter occurs unchanged in the longer, near its old place. Every line is indexed by its segments (length,
segment number, hash) and probes the indexes of the lengths it may meet with those of its substrings that the
multi-match rule allows; candidates are verified with a banded bit-parallel edit distance, a batch of pairs at a
time. Segment hashes come from prefix sums over a batch of texts.

A line's id holds, besides a hash, the parities of its characters in 24 classes. An edit changes two of them at
most, so candidates whose parities differ in more than 2 tau places are no pairs; the join leaves them out
before it emits a row, which keeps lines that share half their text but differ by words from meeting.

A segment that more than `crowd` indexed lines share is no join key: a family of n variants of a line would emit
n * n pairs. Its lines are compared block by block, where each pair of blocks emits no more links than it takes to
connect its lines, and compares no lines that are connected already. Where a crowd has over `hubbed` lines, they
are compared with a hub of theirs first, what stays apart with further hubs, and only what is in different classes
still goes to blocks. So every two lines within tau edits end in one class.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import U64, components, in_arrow, keyed_texts, let, mix, signed, stored

#: Two edits in ten code points leave a similarity of 0.8; shorter lines (blank ones, marks, numbers) always stay.
TAU, MIN_LENGTH = 2, 10
#: Indexed lines that may share a segment before it counts as crowded; lines of a block; crowds that try hubs first,
#: and how many of them.
CROWD, BLOCK, HUBBED, ROUNDS = 32, 256, 2048, 3
#: Pairs that are verified together.
PAIRS = 2048
#: Line ids that every task may hold to fetch their texts: 8 bytes each; more of them are joined by shuffle.
BROADCAST_IDS = 1_000_000


def edit_distance_within(a: list[np.ndarray], b: list[np.ndarray], tau: int) -> np.ndarray:
    """Edit distances of pairs of code-point arrays, tau + 1 where greater.

    Banded and bit-parallel: bit i of a word stands for the diagonal i - tau of the dynamic-programming matrix,
    and for each number of errors e <= tau one word tells which diagonals of the present column cost at most e
    (Wu and Manber's recurrence kept to the 2 tau + 1 diagonals that matter). A batch of pairs moves on together;
    pairs that no diagonal can save any more leave it.
    """
    n = len(a)
    result = np.full(n, tau + 1, np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ok = np.flatnonzero(np.abs(la - lb) <= tau)
    ok = ok[np.argsort(-lb[ok], kind="stable")]  # columns get shorter as lines end
    if not len(ok):
        return result
    width, la, lb = 2 * tau + 1, la[ok], lb[ok]
    mask = np.int64((1 << width) - 1)
    wide = np.full((len(ok), int(max(la.max(), lb[0])) + 3 * tau + 2), 0xFFFFFFFF, np.uint32)  # a, moved by tau
    text = np.full((len(ok), max(1, int(lb[0]))), 0xFFFFFFFE, np.uint32)
    for r, i in enumerate(ok):
        wide[r, tau : tau + la[r]] = a[i]
        text[r, : lb[r]] = b[i]
    wide, text = np.ascontiguousarray(wide.T), np.ascontiguousarray(text.T)
    state = [np.full(len(ok), sum(1 << (tau + i) for i in range(e + 1)), np.int64) for e in range(tau + 1)]
    live = len(ok)
    for j in range(int(lb[0])):
        while live and lb[live - 1] <= j:
            live -= 1
        equal = np.zeros(live, np.int64)
        for i in range(width):
            equal |= (wide[j + i, :live] == text[j, :live]).astype(np.int64) << np.int64(i)
        before = above = None
        for e in range(tau + 1):
            now = state[e][:live] & equal
            if e:
                now |= before | (before >> 1) | ((above << 1) & mask)
            before, above = state[e][:live].copy(), now
            state[e][:live] = now
        if j % 16 == 15:
            lost = state[tau][:live] == 0
            if 2 * np.count_nonzero(lost) > live:
                keep = np.append(~lost, np.ones(len(ok) - live, bool))
                wide, text, state = wide[:, keep], text[:, keep], [x[keep] for x in state]
                ok, la, lb, live = ok[keep], la[keep], lb[keep], live - int(lost.sum())
    end = np.int64(1) << (la - lb + tau)
    for e in range(tau, -1, -1):
        result[ok[(state[e] & end) != 0]] = e
    return result


_BASE, _SPREAD = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_CHARS = 1 << 21  # code points that are hashed at once


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, shift) of the substrings that a line looks up, by the
    multi-match rule, without those that are its own index entries."""
    out = []
    for delta in range(tau + 1):
        for number in range(1, tau + 2):
            low = max(1 - number, delta - (tau + 1 - number))
            high = min(number - 1, delta + (tau + 1 - number))
            out += [(delta, number, move) for move in range(low, high + 1) if delta or move]
    return out


def segments(length: np.ndarray, number: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """First place (from 0) and size of a segment of lines of these lengths; the last segments are the longer."""
    base, extra = np.divmod(length, tau + 1)
    short = tau + 1 - extra
    return (number - 1) * base + np.maximum(number - 1 - short, 0), base + (number > short)


@cache
def _marks() -> np.ndarray:
    """The bit of its class of every code point; newlines have none."""
    with np.errstate(over="ignore"):
        classes = ((np.arange(0x110000, dtype=U64) * _SPREAD) >> U64(40)) % U64(24)
    marks = np.uint32(1) << classes.astype(np.uint32)
    marks[10] = 0
    return marks


class Powers:
    """Powers of the base of segment hashes, and of its inverse, up to the longest run of a task so far."""

    def __init__(self):
        self.up = self.back = np.zeros(0, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """_SPREAD times the powers from 0 to n - 1, and those of the inverse from 0 to n."""
        if len(self.up) < n or not len(self.back):
            with np.errstate(over="ignore"):
                factors = np.full(n + 1, _BASE, U64)
                factors[0] = _SPREAD
                self.up = np.multiply.accumulate(factors[:n])
                factors[:] = _INVERSE
                factors[0] = 1
                self.back = np.multiply.accumulate(factors)
        return self.up[:n], self.back[: n + 1]


class Lines:
    """The lines of some texts as arrays: text number, line number, start and length in one run of code points."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        self.start = np.append(0, ends[:-1] + 1)
        self.length = ends - self.start
        first = np.append(0, np.cumsum([t.count("\n") + 1 for t in texts]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.no = np.arange(len(self.start)) - first[self.text]
        self.lines = self.joined.split("\n")

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, digest): 24 parities and 40 bits of a hash, and 64 bits more; equal for equal lines only."""
        import xxhash

        encoded = self.joined.encode("utf-8", "surrogatepass").split(b"\n")
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, encoded)), ">u8").reshape(-1, 2).astype(U64)
        low, high = both[:, 1] & U64(0xFFFFFFFFFF), both[:, 0].copy()
        marks = np.zeros(len(self.codes) + 1, np.uint32)
        np.take(_marks(), self.codes, out=marks[:-1], mode="clip")
        parity = np.bitwise_xor.reduceat(marks, np.minimum(self.start, len(marks) - 1)).astype(U64)
        parity[self.length == 0] = 0
        return (parity << U64(40)) | low, high

    def keys(self, which: np.ndarray, tau: int, probing: bool, powers: Powers | None = None) -> list[np.ndarray]:
        """For some lines, an array of keys for each index entry or probe."""
        up, back = (powers or Powers()).to(len(self.codes))
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.codes) + 1, U64)
            sums = total[1:]
            np.add(self.codes, U64(1), out=sums)
            sums *= up
            np.cumsum(sums, out=sums)
            start, length, out = self.start[which], self.length[which], []
            for delta, number, move in probes(tau) if probing else [(0, n, 0) for n in range(1, tau + 2)]:
                at, size = segments(length - delta, number, tau)
                at = start + at + move
                h = (total[at + size] - total[at]) * back[at]
                out.append(mix(h + mix((length - delta).astype(U64) * U64(16) + U64(number))))
        return out


def _blocks(texts: list[str]):
    """Runs of texts of bounded size together; a longer text is a run of its own."""
    held, size, at = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > _CHARS:
            yield at, held
            held, size, at = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _worth(lines: Lines, least: int) -> np.ndarray:
    """Numbers of the lines of `least` code points or more once stripped."""
    return np.flatnonzero(np.fromiter((len(x) >= least and len(x.strip()) >= least for x in lines.lines), bool, len(lines.lines)))


def _entries(docs: DataFrame, tau: int, least: int, probing: bool) -> DataFrame:
    """(key, id): index entries or probes of the lines of docs (text), once a task for each line."""

    def run(batches):
        seen: set[int] = set()
        powers = Powers()
        for b in batches:
            for _, texts in _blocks(b.column(0).to_pylist()):
                lines = Lines(texts)
                ids = lines.ids()[0]
                near = _worth(lines, least)
                new = []
                for i, x in zip(near.tolist(), ids[near].tolist()):
                    if x not in seen:
                        if len(seen) >= 1_000_000:  # forgetting only repeats entries
                            seen.clear()
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                which = np.array(new)
                for keys in lines.keys(which, tau, probing, powers):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(signed(ids[which]))], ["key", "id"])

    return in_arrow(docs.select("text"), run, "key long, id long")


def _among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ids are among the sorted known ones."""
    at = np.searchsorted(known, ids)
    return known[np.minimum(at, len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)


def _texts_of(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(id, line) for the wanted ids, which are distinct."""
    few = np.sort(wanted.toPandas()["id"].to_numpy(np.int64).view(U64)) if wanted.count() <= BROADCAST_IDS else None

    def run(batches):
        for b in batches:
            for _, texts in _blocks(b.column(0).to_pylist()):
                lines = Lines(texts)
                ids = lines.ids()[0]
                near = _worth(lines, least)
                if few is not None:
                    near = near[_among(ids[near], few)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(ids[near])), pa.array([lines.lines[i] for i in near], pa.string())], ["id", "line"])

    out = in_arrow(docs.select("text"), run, "id long, line string")
    return (out if few is not None else out.join(wanted, "id", "left_semi")).dropDuplicates(["id"])


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def _within(s: list[np.ndarray], t: list[np.ndarray], tau: int) -> np.ndarray:
    """Which of the pairs s[i], t[i] are within tau edits: blocks of like lengths and of bounded cells."""
    size = np.array([max(len(x), len(y)) for x, y in zip(s, t)], np.int64)
    order, good, at = np.argsort(size, kind="stable"), np.zeros(len(size), bool), 0
    while at < len(order):
        most = max(1, 4_000_000 // int(size[order[min(len(order) - 1, at + PAIRS - 1)]] + 1))
        block = order[at : at + min(PAIRS, most)]
        good[block] = edit_distance_within([s[i] for i in block], [t[i] for i in block], tau) <= tau
        at += len(block)
    return good


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Those of pairs (a, b) whose lines are within tau edits."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("s")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("t")), "b"
    ).select("a", "b", "s", "t")

    def run(batches):
        for b in batches:
            good = _within([_codes(x) for x in b.column(2).to_pylist()], [_codes(x) for x in b.column(3).to_pylist()], tau)
            yield b.filter(pa.array(good)).select([0, 1])

    return in_arrow(joined, run, "a long, b long")


def _fits(x: str, y: str, tau: int):
    """Whether the parities of two ids allow tau edits."""
    parities = lambda c: F.shiftrightunsigned(c, 40)
    return (F.col(x) != F.col(y)) & (F.bit_count(parities(x).bitwiseXOR(parities(y))) <= 2 * tau)


def connecting(ids: list[int], roots: list[int], lines: list[str], indexed: list[bool], one: list[int], other: list[int], tau: int) -> list[tuple[int, int]]:
    """Pairs (ids) of a line of one and a line of other, within tau edits, of which one at least is indexed: as many
    as connect what such pairs connect. Lines of equal roots are connected already."""
    codes, out = [_codes(x) for x in lines], []
    names, label = np.array(ids, np.int64), np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    size, index = np.array([len(x) for x in codes]), np.array(indexed, bool)
    parity, rest = names.view(U64) >> U64(40), np.array(other)

    def unite(pairs: list[np.ndarray]) -> None:
        x, y = np.concatenate(pairs, axis=1)
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
        if not len(x):
            return
        good = _within([codes[i] for i in x], [codes[j] for j in y], tau)
        for i, j in zip(x[good].tolist(), y[good].tolist()):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))

    held, n = [], 0
    for i in one:
        near = (label[rest] != label[i]) & (np.bitwise_count(parity[rest] ^ parity[i]) <= 2 * tau) & (np.abs(size[rest] - size[i]) <= tau) & (index[rest] | index[i])
        near = rest[near]
        if one is other:
            near = near[near > i]
        held.append(np.array([np.full(len(near), i), near]))
        n += len(near)
        if i == one[0] or n >= PAIRS:  # the first line joins most of its like, which need no comparison any more
            unite(held)
            held, n = [], 0
    if held:
        unite(held)
    return out


def _by_blocks(apart: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) that connect what is within tau edits in each crowd of apart (key, id, indexed, root): a crowd is
    dealt to blocks by a hash, and each pair of blocks is a group of its own."""

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, roots, lines, indexed, block = (group.column(c).to_pylist() for c in ("id", "root", "line", "indexed", "block"))
        one = [n for n, b in enumerate(block) if b == i]
        other = one if i == j else [n for n, b in enumerate(block) if b == j]
        found = connecting(ids, roots, lines, indexed, one, other, tau)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    blocks = apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), "blocks").alias("block")
    dealt = apart.join(blocks, "key").select("key", "id", "indexed", "root", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("key", "id", "indexed", "root", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return dealt.join(texts, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _past_hubs(members: DataFrame, texts: DataFrame, tau: int, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """(links, apart): tables of links (a, b) of lines with hubs of their crowds in members (key, id, indexed), and the
    members (key, id, indexed, root) of the crowds that hold different roots still."""
    weight = members.filter("indexed").groupBy("id").agg(F.count(F.lit(1)).alias("w"))
    members = stored(members.join(weight, "id", "left").select("key", "id", "indexed", F.coalesce("w", F.lit(0)).alias("w")), "line-members")
    links, tried = [], None
    apart = members.withColumn("root", F.col("id"))
    for _ in range(rounds):
        hub = F.max_by(F.struct("id", "root"), F.struct("w", -F.col("id"))).alias("hub")
        hubs = apart.filter("indexed").groupBy("key").agg(hub).select("key", F.col("hub.id").alias("h"), F.col("hub.root").alias("hub_root"))
        pairs = apart.join(hubs, "key").filter((F.col("root") != F.col("hub_root")) & _fits("id", "h", tau))
        pairs = pairs.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "line-tries")
        used = stored(hubs.select(F.col("h").alias("id")).distinct().withColumn("old", F.lit(True)), "line-hubs")
        if pairs.take(1):
            links.append(stored(_verified(pairs, texts, tau), "line-links"))
            tried = pairs if tried is None else tried.union(pairs)
        named = members.withColumn("root", F.col("id"))
        if links:
            roots = stored(components(reduce(DataFrame.union, links), "a", "b", "line-cc"), "line-roots")
            named = members.join(roots, "id", "left").select("key", "id", "indexed", "w", F.coalesce("root", "id").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
        # lines that were no hub yet stand for the next one
        apart = named.join(mixed, "key", "left_semi").join(used, "id", "left").withColumn("w", F.when(F.col("old"), -1).otherwise(F.col("w")))
        apart = stored(apart.select("key", "id", "indexed", "w", "root"), "line-apart")
        members = stored(members.join(used, "id", "left").select("key", "id", "indexed", F.when(F.col("old"), -1).otherwise(F.col("w")).alias("w")), "line-members")
    return links, apart.select("key", "id", "indexed", "root")


def similar_lines(docs: DataFrame, *, tau: int = TAU, min_length: int = MIN_LENGTH, crowd: int = CROWD, hubbed: int = HUBBED, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): ids of lines of docs (text) within tau edits of each other, a < b: every such pair whose segment
    is not crowded, and of the others enough to connect all that are within tau edits. Lines have min_length code
    points or more once stripped."""
    index = _entries(docs, tau, min_length, False).repartition("key").distinct()
    whole = Window.partitionBy("key")
    index = stored(index.select("key", "id", F.count(F.lit(1)).over(whole).alias("n"), (F.min("id").over(whole) == F.col("id")).alias("lead")), "line-index")
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    few = index.filter((F.col("n") > 1) & (F.col("n") <= crowd))
    left, right = few.select("key", F.col("id").alias("x")), few.select(F.col("key").alias("k"), F.col("id").alias("y"))
    same = left.join(right, (F.col("key") == F.col("k")) & (F.col("x") < F.col("y")) & _fits("x", "y", tau)).select(*pair)
    # a crowded key is met once, without an id: who meets it is a member of the crowd
    entries = index.filter((F.col("n") <= crowd) | F.col("lead")).select("key", F.when(F.col("n") <= crowd, F.col("id")).alias("x"))
    probe = _entries(docs, tau, min_length, True).select(F.col("key").alias("k"), F.col("id").alias("y"))
    met = entries.join(probe, (F.col("key") == F.col("k")) & (F.col("x").isNull() | _fits("x", "y", tau)))
    met = stored(met.select("key", "x", "y").distinct(), "line-met")
    pairs = stored(same.union(met.filter("x IS NOT NULL").select(*pair)).distinct(), "line-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    crowds = index.filter(F.col("n") > crowd).select("key", "id", F.lit(True).alias("indexed"))
    if not crowds.take(1):
        return _verified(pairs, stored(_texts_of(docs, stored(ids.distinct(), "line-ids"), min_length), "line-texts"), tau)
    members = crowds.union(met.filter("x IS NULL").select("key", F.col("y").alias("id"), F.lit(False).alias("indexed")))
    members = stored(members.groupBy("key", "id").agg(F.max("indexed").alias("indexed")), "line-members")
    texts = stored(_texts_of(docs, stored(ids.union(members.select("id")).distinct(), "line-ids"), min_length), "line-texts")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    huge = stored(sizes.filter(F.col("size") > hubbed).select("key"), "line-huge")
    links, apart = [_verified(pairs, texts, tau)], members.withColumn("root", F.col("id"))
    if huge.take(1):
        more, rest = _past_hubs(members.join(huge, "key", "left_semi"), texts, tau, rounds)
        links, apart = [*links, *more], apart.join(huge, "key", "left_anti").select("key", "id", "indexed", "root").union(rest)
    return reduce(DataFrame.union, [*links, _by_blocks(apart, texts, tau)]).distinct()


def _spots(docs: DataFrame, least: int) -> DataFrame:
    """(line_id, digest, doc_id, version, no): where lines of `least` code points or more, once stripped, occur."""

    def run(batches):
        for b in batches:
            docs, versions = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, texts in _blocks(b.column(1).to_pylist()):
                lines = Lines(texts)
                ids, digests = lines.ids()
                some = _worth(lines, least)
                own = (lines.text[some] + first).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(ids[some])), pa.array(signed(digests[some])), pa.array([docs[i] for i in own], pa.int64()), pa.array([versions[i] for i in own], pa.int64()), pa.array(lines.no[some].astype(np.int32))],
                    ["line_id", "digest", "doc_id", "version", "no"],
                )

    return in_arrow(docs.select("doc_id", "text", "version"), run, "line_id long, digest long, doc_id long, version long, no int")


def line_dedup(docs: DataFrame, *, id_col="doc_id", text_col="text", carry=(), tau=TAU, min_length=MIN_LENGTH, crowd=CROWD, hubbed=HUBBED, rounds=ROUNDS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, n_links, line_classes, carried): a row for each row of docs.

    Lines are what newlines part. Lines that are identical, or that pairs within tau edits connect, are a class;
    its first line by (doc_id, text's hash, line number) stays and the others are dropped. Lines under min_length
    code points once stripped (blank ones among them) always stay. line_classes: for each line the id of its
    class (null: a line like no other, or too short); n_links: how many other lines of the corpus the classes of
    the document's lines hold, summed over its lines. carried: the columns named by carry as a struct, untouched.

    Null texts count as empty: one empty line. A document is an id with a text: rows that share both lose the same
    lines together, rows that share an id but not the text are documents of their own, and so are rows with a null
    id, which come after all others. Lines are told apart by 128 bits; links between them go by 64 of these.
    """
    texts = keyed_texts(docs, id_col, text_col, carry=carry).withColumn("version", F.xxhash64("text"))
    spots = stored(_spots(texts, min_length), "spots")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "no"))
    lines = stored(spots.groupBy("line_id", "digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "lines")
    links = stored(similar_lines(texts, tau=tau, min_length=min_length, crowd=crowd, hubbed=hubbed, rounds=rounds), "line-links")
    roots = stored(components(links, "a", "b"), "line-roots")
    # lines that occur once and have no link are in no class: they go no further
    named = lines.join(roots.withColumnRenamed("id", "line_id"), "line_id", "left").filter("copies > 1 OR root IS NOT NULL")
    named = named.select("line_id", "digest", "first", "copies", F.coalesce("root", "line_id").alias("class"), F.when(F.col("root").isNull(), F.col("digest")).alias("alone"))
    heads = named.groupBy("class", "alone").agg(F.min("first").alias("head"), F.sum("copies").alias("size")).withColumnRenamed("class", "c").withColumnRenamed("alone", "o")
    repeated = stored(
        named.join(heads, (F.col("class") == F.col("c")) & F.col("alone").eqNullSafe(F.col("o"))).select("line_id", "digest", "class", "head", (F.col("size") - 1).alias("others")),
        "repeated",
    )
    hits = spots.join(repeated, ["line_id", "digest"]).withColumn(
        "drop", ~(F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.version") == F.col("version")) & (F.col("head.no") == F.col("no")))
    )
    marks = hits.groupBy(F.col("doc_id").alias("marked"), F.col("version").alias("marked_version")).agg(F.collect_set(F.struct("no", "class", "others", "drop")).alias("marks"))
    out = texts.join(marks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("marked")) & (F.col("version") == F.col("marked_version")), "left")
    parts = F.split("text", "\n", -1)
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    gone = F.transform(F.filter("marks", lambda m: m["drop"]), lambda m: m["no"])
    unmarked = F.array_except(every, F.transform("marks", lambda m: m["no"]))
    classes = F.concat(F.transform(unmarked, lambda i: F.struct(i.alias("no"), F.lit(None).cast("long").alias("class"))),
                       F.transform("marks", lambda m: F.struct(m["no"].alias("no"), m["class"].alias("class"))))
    plain = F.col("marks").isNull()
    return out.select(
        "doc_id",
        F.when(plain | (F.size(gone) == 0), F.col("text")).otherwise(let(parts, lambda p: F.array_join(F.transform(F.array_except(every, gone), lambda i: F.element_at(p, i + 1)), "\n"))).alias("text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.when(plain, F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.when(plain, F.lit(0)).otherwise(F.aggregate("marks", F.lit(0).cast("long"), lambda n, m: n + m["others"])).cast("long").alias("n_links"),
        F.when(plain, F.array_repeat(F.lit(None).cast("long"), F.size(parts))).otherwise(F.transform(F.array_sort(classes), lambda c: c["class"])).alias("line_classes"),
        *(["carried"] if carry else []),
    )
