"""Order MinHash fingerprints (Marcais et al., 2019), in built-in functions only.

The k-mers of a text are its runs of k words; the o-th equal one is a k-mer of its own (k-mer, o). Each of `bins`
coordinates has an order of all k-mers: those that a hash deals to the coordinate come first, by that hash, and after
them all others by a hash of the coordinate's own. A coordinate keeps the `picks` least k-mers of the text, puts them
in the order in which the text has them, and hashes that tuple. Two texts' likeness is the share of equal tuples: unlike
a set sketch it falls when the same k-mers come in another order. Each order is uniformly random and the same for all
texts, so the likeness means the same at every length; only the coordinates to which a text has fewer than `picks`
k-mers dealt - few of a long text - cost a pass over it.

Within a text all steps are array functions: sorted longs whose upper 36 bits are a hash and whose lower 28 are
a place. In a text of over 2**28 words places run into hashes: its sketch is defined, but says little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import let

K, BINS, PICKS = 2, 64, 2
_PLACE = (1 << 28) - 1
_HASH = ~_PLACE


def _bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _starts(values: Column, key) -> Column:
    """Indexes (from 0) at which the key of a sorted array changes, and the array's size."""
    changes = F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0) | (key(F.element_at(values, i + 1)) != key(F.element_at(values, F.greatest(i, F.lit(1))))),
    )
    return F.concat(changes, F.array(F.size(values)))


def sketch(text: Column, *, k: int = K, bins: int = BINS, picks: int = PICKS) -> Column:
    """array<long> of a hash for each coordinate. Words are runs of letters, digits and marks, lower-cased; a text
    of fewer than k words is one k-mer, and a text without words has nulls."""
    words = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}_]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def kmers(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - k),
            lambda i: _bits(F.xxhash64(*[F.element_at(w, i + j + 1) for j in range(k)]), _HASH).bitwiseOR(i.cast("long")),
        )
        one = F.array(_bits(F.xxhash64(w), _HASH))
        return F.when(F.size(w) >= k, many).otherwise(one)

    def numbered(s: Column, starts: Column) -> Column:
        """Each k-mer with its occurrence number hashed anew, its place kept."""
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(starts) - 1),
            lambda j: F.transform(
                F.sequence(F.element_at(starts, j), F.element_at(starts, j + 1) - 1),
                lambda i: _bits(F.xxhash64(_bits(F.element_at(s, i + 1), _HASH), i - F.element_at(starts, j)), _HASH).bitwiseOR(_bits(F.element_at(s, i + 1), _PLACE)),
            ),
        ))

    shift = 64 - (bins - 1).bit_length()

    def dealt(q: Column, starts: Column) -> Column:
        """For each coordinate that has k-mers: its number, and its least k-mers."""
        return F.transform(
            F.sequence(F.lit(1), F.size(starts) - 1),
            lambda j: F.struct(
                F.shiftrightunsigned(F.element_at(q, F.element_at(starts, j) + 1), shift).cast("int").alias("bin"),
                F.slice(q, F.element_at(starts, j) + 1, F.least(F.lit(picks), F.element_at(starts, j + 1) - F.element_at(starts, j))).alias("low"),
            ),
        )

    def completed(low: Column, q: Column, b: Column) -> Column:
        """low, and as many of the others as it lacks, by the coordinate's own hash: one least at a time, no sort."""

        def fill(low: Column, others: Column, lacking: int) -> Column:
            if not lacking:
                return low
            return F.when(F.size(low) >= picks, low).otherwise(let(F.array_min(others), lambda m: F.when(m.isNull(), low).otherwise(
                let(F.concat(low, F.array(m["x"])), lambda more: fill(more, F.filter(others, lambda s: s["r"] > m["r"]), lacking - 1)))))

        ranked = F.transform(F.filter(q, lambda x: ~F.array_contains(low, x)), lambda x: F.struct(F.xxhash64(_bits(x, _HASH), b).alias("r"), x.alias("x")))
        return F.when(F.size(low) >= picks, low).otherwise(let(ranked, lambda others: fill(low, others, picks)))

    def ordered(low: Column) -> Column:
        """The hash of some k-mers in the order of their places."""
        return F.xxhash64(F.transform(F.sort_array(F.transform(low, lambda x: F.struct(_bits(x, _PLACE).alias("p"), _bits(x, _HASH).alias("h")))), lambda x: x["h"]))

    empty, none = F.array_repeat(F.lit(None).cast("long"), bins), F.array().cast("array<long>")

    def laid(q: Column, held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: let(F.coalesce(F.try_element_at(held, b), none), lambda low: ordered(completed(low, q, b))))

    return let(words, lambda w: F.when(F.size(w) == 0, empty).otherwise(
        let(F.sort_array(kmers(w)), lambda s: let(_starts(s, lambda x: _bits(x, _HASH)), lambda a: let(
            F.sort_array(numbered(s, a)), lambda q: let(
                _starts(q, lambda x: F.shiftrightunsigned(x, shift)), lambda b: let(F.map_from_entries(dealt(q, b)), lambda held: laid(q, held))))))))


def likeness(a: Column, b: Column) -> Column:
    """Equal coordinates by all; two texts without words are alike, and a text without words is like no other."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    filled = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def written(s: Column) -> Column:
    """The fingerprint as text: 16 hex digits a bin, dashes for an empty one."""
    return F.array_join(F.transform(s, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))), "")


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", k: int = K, bins: int = BINS, picks: int = PICKS) -> DataFrame:
    """(doc_id, sketch): one row for each row of docs; null texts count as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.coalesce(F.col(text_col).cast("string"), F.lit("")), k=k, bins=bins, picks=picks).alias("sketch"))


def edited_pairs(docs: DataFrame, *, id_col="doc_id", text_col="text", k: int = K, bins: int = BINS, picks: int = PICKS) -> DataFrame:
    """(doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch): each text, and the text whose last
    floor(n_chars/2) code points are replaced by the first as many of the next document's, in ascending
    doc_id; after the last document comes the first. Nulls come first, rows of one id by their text's digest.

    Documents are dealt to ranges of ids (bounds: quantiles, four ranges for each shuffle partition), so that no
    task holds all; the first row of a range also closes the range before it. One shuffle moves each text once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = sorted(set(bounds))  # fewer than n numbers
    place, steps = F.lit(0), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if bounds:  # how many bounds lie below, by bisection
        held = F.array(*[F.lit(b).cast("long") for b in bounds])
        place = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda lo, x: F.when(F.try_element_at(held, lo + x) < F.col("doc_id"), lo + x).otherwise(lo))
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place)
    placed = rows.withColumn("range", place)
    lead = placed.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.col("doc_id").isNotNull().alias("n"), F.sha2("text", 256).alias("d"))).alias("lead")).collect()
    lead = sorted((r["range"], r["lead"]["i"], r["lead"]["n"], r["lead"]["d"]) for r in lead)  # a row for each range
    if not lead:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_text string, sketch array<long>, edited_sketch array<long>, next_sketch array<long>")
    before = [(lead[i - 1][0], *lead[i][1:]) for i in range(len(lead))]
    ends = F.broadcast(spark.createDataFrame(before, "closes int, i long, n boolean, d string"))
    closing = (
        placed.join(ends, (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("i")) & (F.col("doc_id").isNotNull() == F.col("n")) & (F.sha2("text", 256) == F.col("d")))
        .select("doc_id", "text", F.col("closes").alias("range"), F.lit(1).alias("end"), "d").dropDuplicates(["range"])
    )
    every = placed.select("doc_id", "text", "range", F.lit(0).alias("end"), F.sha2("text", 256).alias("d")).union(closing)
    every = every.repartition(n, "range").withColumn("sketch", sketch(F.col("text"), k=k, bins=bins, picks=picks))
    order = Window.partitionBy("range").orderBy("end", F.asc_nulls_first("doc_id"), "d")
    chained = every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("end = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = chained.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch",
                            F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited_text"))
    return edited.withColumn("edited_sketch", sketch(F.col("edited_text"), k=k, bins=bins, picks=picks))
