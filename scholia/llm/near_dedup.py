"""Near-duplicate documents: DartMinHash signatures over weighted word shingles, banded joining, exact check.

Weight of a shingle: how often it occurs in the document. Similarity: weighted Jaccard of the shingle counts
(sum of the lesser counts by the sum of the greater). See Christiani, "DartMinHash" (2020).

Plan: identical texts become one class by a digest (minima are combined before the shuffle, so a hot text
costs nothing); one signature per class goes to `bands` buckets; every member of a bucket is compared with the
bucket's hub - the member that shares most buckets with others, which is the original of a family of edited
copies far more often than any other -, which emits one candidate for each member and bucket at most. The
members of buckets that hold two components still are then compared with each other, all that differ in
component, block by block, so that any two documents that share a bucket are connected or were found unlike.
With more rounds, further hubs are tried before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import U64, Vocabulary, components, discard, in_arrow, keyed_texts, mix, shingles, signed, stored, word_hashes

K_WORDS, THRESHOLD, BANDS, ROWS, ROUNDS = 5, 0.8, 20, 4, 1
#: Members and code points of a block on average: the rest of a bucket is compared by pairs of blocks, so no task holds
#: more than two, and each text is copied once for each block of its bucket.
BLOCK, BLOCK_CHARS = 256, 1_000_000
_C1, _C2, _C3 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def dart_signatures(elements: list[np.ndarray], counts: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k dart ids for each document: for each coordinate, the dart of least rank among those that
    fall below the weight of their element.

    Each element owns, for each dyadic layer of weight [0,1), [1,2), [2,4), ..., a Poisson process of darts
    ordered by rank, generated from hashes of (element, layer, number), hence the same in every document. A
    dart has a weight in the layer, a rank and a coordinate. A document of total weight W throws the darts
    of rank up to (k ln k + 2k) / W, about k ln k + 2k of them; a document with an empty coordinate left
    doubles that bound. A document without elements has a row of zeros.
    """
    n = len(elements)
    out = np.zeros((n, k), U64)
    total = np.array([c.sum() for c in counts], np.float64)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(n)
    bound[todo] = (k * np.log(k) + 2 * k) / total[todo]
    with np.errstate(over="ignore"):
        while len(todo):
            h = np.concatenate([elements[i] for i in todo])
            c = np.concatenate([counts[i] for i in todo]).astype(np.float64)
            doc = np.repeat(np.arange(len(todo)), [len(elements[i]) for i in todo])
            best = np.full(len(todo) * k, np.inf)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            layer, low, width = 0, 0.0, 1.0
            while len(h):
                rank, at, number = np.zeros(len(h)), np.arange(len(h)), 0
                key = mix(h + U64(layer) * _C1)
                while len(at):
                    number += 1
                    x = mix(key[at] + U64(number) * _C2)
                    u = ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
                    rank[at] -= np.log(u) / width
                    keep = rank[at] <= bound[todo][doc[at]]
                    at, x = at[keep], x[keep]
                    y = mix(x + _C3)
                    under = low + width * ((y >> U64(32)).astype(np.float64) * 2.0**-32) < c[at]
                    hit = at[under]
                    cell = doc[hit] * k + (y[under] & U64(0xFFFFFFFF)).astype(np.int64) % k
                    r = rank[hit]
                    np.minimum.at(best, cell, r)
                    found.append((cell, r, x[under]))
                low, width, layer = (1.0, 1.0, 1) if layer == 0 else (low + width, width * 2, layer + 1)
                more = c > low
                h, c, doc = h[more], c[more], doc[more]
            sig = np.zeros(len(todo) * k, U64)
            for cell, r, x in found:
                first = best[cell] == r
                sig[cell[first]] = x[first]
            full = np.isfinite(best).reshape(len(todo), k).all(1)
            out[todo[full]] = sig.reshape(len(todo), k)[full]
            todo = todo[~full]
            bound[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band, its number included."""
    s = signatures.reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(bands, dtype=U64), s.shape[:2]).copy()
        for j in range(rows):
            h = mix(h * _C1 + s[:, :, j])
    return h


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets given as (sorted distinct elements, counts); two empty ones have 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 0.0


def _multiset(text: str, vocabulary: Vocabulary, k_words: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(word_hashes(text, vocabulary), k_words), return_counts=True)


def _signed_texts(texts: DataFrame, k_words: int, bands: int, rows: int) -> DataFrame:
    """(digest, bands): one row for a digest in each task at least; texts without words have none."""

    def run(batches):
        vocabulary, seen = Vocabulary(), set()
        for b in batches:
            digests, elements, counts = [], [], []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest in seen:
                    continue
                if len(seen) >= 200_000:  # forgetting only costs a second computation
                    seen.clear()
                seen.add(digest)
                e, c = _multiset(text, vocabulary, k_words)
                if len(e):
                    digests.append(digest), elements.append(e), counts.append(c)
            keys = signed(band_keys(dart_signatures(elements, counts, bands * rows), bands, rows))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(list(keys), pa.list_(pa.int64()))], ["digest", "bands"])

    return in_arrow(texts.select("digest", "text"), run, "digest string, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, k_words: int, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts have the similarity; each text once a pair, in bounded batches."""

    def run(batches):
        vocabulary = Vocabulary()
        last, kept = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                x, y, s = [], [], []
                for i, j, t, u in zip(*(b.column(n).to_pylist() for n in range(4))):
                    if j != last:
                        last, kept = j, _multiset(u, vocabulary, k_words)
                    sim = weighted_jaccard(_multiset(t, vocabulary, k_words), kept)
                    if sim >= threshold:
                        x.append(i), y.append(j), s.append(sim)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return in_arrow(joined, run, "a long, b long, similarity double")


def similar_among(sets: list[tuple[np.ndarray, np.ndarray]], one: list[int], other: list[int] | None, threshold: float, skip) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of the similar pairs of one with other, or within one if other is None; skip(i, js)
    says which of js need not be compared with i. Pairs that found ones connect already are left out."""
    inside = other is None
    other = one if inside else other
    values, cells = np.unique(np.concatenate([sets[j][0] for j in other]), return_inverse=True)
    counts = np.concatenate([sets[j][1] for j in other])
    starts = np.concatenate([[0], np.cumsum([len(sets[j][0]) for j in other])])[:-1]
    totals = {j: sets[j][1].sum() for j in {*one, *other}}
    weights = np.array([totals[j] for j in other])
    names, row = np.array(other), np.zeros(len(values), np.int64)
    root = {j: j for j in totals}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for n, i in enumerate(one):
        e, c = sets[i]
        at = np.minimum(np.searchsorted(values, e), len(values) - 1)
        known = values[at] == e
        row[at[known]] = c[known]
        both = np.add.reduceat(np.minimum(row[cells], counts), starts)
        row[at[known]] = 0
        sim = both / (totals[i] + weights - both)
        hits = np.flatnonzero(sim >= threshold)
        hits = hits[hits > n] if inside else hits
        for j, drop in zip(hits, skip(i, names[hits])):
            a, b = find(i), find(int(names[j]))
            if not drop and a != b:
                root[a] = b
                out.append((i, int(names[j]), float(sim[j])))
    return out


def _verified_within(members: DataFrame, texts: DataFrame, k_words: int, threshold: float) -> DataFrame:
    """(a, b, similarity) that connect all similar pairs of different roots in each bucket of members (bucket,
    rep, root). A bucket is dealt to blocks by a hash, each pair of blocks is a group of its own; of the buckets
    that a pair shares, only the least compares it."""

    def run(group: pa.Table) -> pa.Table:
        bucket, i, j = (group.column(n)[0].as_py() for n in ("bucket", "i", "j"))
        rep, root, block = (group.column(n).to_pylist() for n in ("rep", "root", "block"))
        held, vocabulary = [set(x) for x in group.column("held").to_pylist()], Vocabulary()
        sets = [_multiset(t, vocabulary, k_words) for t in group.column("text").to_pylist()]

        def skip(x, ys):
            return [root[x] == root[y] or min(held[x] & held[y]) != bucket for y in ys]

        one, other = ([n for n, b in enumerate(block) if b == x and len(sets[n][0])] for x in (i, j))
        found = [] if not one or not other else similar_among(sets, one, None if i == j else other, threshold, skip)
        return pa.table({"a": pa.array([rep[x] for x, _, _ in found], pa.int64()), "b": pa.array([rep[y] for _, y, _ in found], pa.int64()), "similarity": pa.array([s for _, _, s in found], pa.float64())})

    sizes = texts.select(F.col("doc_id").alias("rep"), F.length("text").cast("long").alias("size"))
    whole = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_CHARS)
    blocks = members.join(sizes, "rep").groupBy("bucket").agg(F.greatest(F.ceil(whole), F.lit(1).cast("long")).alias("blocks"))
    held = members.groupBy("rep").agg(F.collect_set("bucket").alias("held"))
    block = F.pmod(F.xxhash64("rep"), "blocks").alias("block")
    dealt = members.join(blocks, "bucket").select("bucket", "rep", "root", block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("bucket", "rep", "root", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    texts = texts.select(F.col("doc_id").alias("rep"), "text").join(held, "rep")
    return dealt.join(texts, "rep").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, similarity double")


def _classes(docs: DataFrame, id_col, text_col, k_words, threshold, bands, rows, rounds) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(texts, nodes, roots): texts (doc_id, text, digest) for each row, nodes (node, digest, rep) for each distinct
    text, roots (id, root) for the nodes that similar pairs connect."""
    texts = keyed_texts(docs, id_col, text_col).withColumn("digest", F.md5("text"))
    grouped = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "rep"), "classes")
    signatures = stored(_signed_texts(texts, k_words, bands, rows), "signatures")
    buckets = signatures.dropDuplicates(["digest"]).join(nodes, "digest").select(F.col("node").alias("rep"), F.explode("bands").alias("bucket")).distinct()
    buckets = stored(buckets, "buckets")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(buckets.join(sizes, "bucket"), "members")
    weight = members.groupBy("rep").agg(F.sum("n").alias("w"))
    members = stored(members.join(weight, "rep").select("bucket", "rep", "w"), "weighted")
    involved = nodes.join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").select("node", F.col("digest").alias("d"), "rep")
    # a text is read at its least id: rows of one text are not gathered but where they share the id too
    found = texts.join(involved.hint("shuffle_hash"), (texts["digest"] == F.col("d")) & texts["doc_id"].eqNullSafe(F.col("rep")))
    candidates = stored(found.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "candidates")

    links = tried = roots = None
    hub = F.max_by("rep", F.struct("w", -F.col("rep")))
    apart = members.withColumn("root", F.col("rep"))
    for _ in range(rounds):
        hubs = apart.groupBy("bucket").agg(hub.alias("hub"), F.max_by("root", F.struct("w", -F.col("rep"))).alias("hub_root"))
        pairs = apart.join(hubs, "bucket").filter("root != hub_root").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.take(1):
            break
        found = stored(_verified(pairs, candidates, k_words, threshold), "links")
        swapped = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = swapped if tried is None else tried.union(swapped)
        if roots is None or found.take(1):
            links = found if links is None else links.union(found)
            roots = stored(components(links, "a", "b"), "roots")
        named = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "w", F.coalesce("root", "rep").alias("root"))
        mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
        used = pairs.select(F.col("b").alias("rep")).distinct()
        # members that were no hub yet stand for the next one; the rest of their bucket is compared with it
        apart = stored(named.join(mixed, "bucket", "left_semi").join(used.withColumn("old", F.lit(True)), "rep", "left")
                       .withColumn("w", F.when(F.col("old"), F.lit(0)).otherwise(F.col("w"))).drop("old"), "apart")
    if apart.take(1):
        rest = stored(_verified_within(apart.select("bucket", "rep", "root"), candidates, k_words, threshold), "links")
        if rest.take(1):
            roots = stored(components(rest if links is None else links.union(rest), "a", "b"), "roots")
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "id long, root long")
    return texts, nodes, roots


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", k_words=K_WORDS, threshold=THRESHOLD, bands=BANDS, rows=ROWS, rounds=ROUNDS) -> DataFrame:
    """(doc_id, text_class, class_id): a row for each row of docs.

    text_class: the least id with the very same text. class_id: the least id of the documents that similar
    pairs connect; a document like no other has its own id. Null texts count as empty; empty texts, and any
    texts without words, are alike only if identical. Texts are compared, not ids: rows that share an id but not
    the text are compared as any others. Where all ids of a text are null, text_class is null, and class_id where
    all ids of a class are. Shorter texts than k_words words are one shingle.

    Two different documents of the threshold's similarity share a bucket but for (1 - s**rows)**bands:
    2.6e-5 at 0.8 as set. rounds: how many hubs a bucket tries before its members are compared with each other.
    """
    texts, nodes, roots = _classes(docs, id_col, text_col, k_words, threshold, bands, rows, rounds)
    joined = nodes.join(roots, nodes["node"] == roots["id"])
    least = joined.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "r")
    linked = joined.join(least, F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "least", F.lit(True).alias("linked"))
    named = nodes.join(linked, nodes["digest"] == F.col("d"), "left").select("digest", "rep", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("class_id"))
    return texts.select("doc_id", "digest").join(named, "digest").select("doc_id", F.col("rep").alias("text_class"), "class_id")


def representatives(docs: DataFrame, *, id_col="doc_id", text_col="text", k_words=K_WORDS, threshold=THRESHOLD, bands=BANDS, rows=ROWS, rounds=ROUNDS) -> DataFrame:
    """(doc_id, digest): the document that stands for each class of near_duplicates(): the least id (null after all
    others), of equal ones the text of least MD5. digest: the MD5 of its text, null read as empty."""
    _, nodes, roots = _classes(docs, id_col, text_col, k_words, threshold, bands, rows, rounds)
    head = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("head")
    heads = nodes.join(roots, nodes["node"] == roots["id"]).groupBy("root").agg(head)
    single = nodes.join(roots, nodes["node"] == roots["id"], "left_anti")
    return heads.select(F.col("head.rep").alias("doc_id"), F.col("head.digest").alias("digest")).union(single.select(F.col("rep").alias("doc_id"), "digest"))
