"""What each filter of a chain removes, whatever the order of the chain.

Direct replay: a document's failures (one bit for each filter) meet every order of the filters (120 for five, a
broadcast of fixed size), the first failing step of each order is found, the steps are exploded, and every count is
a conditional sum that is combined on the map side: what is shuffled are one row for each task, part, order and step.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import stored

#: Orders are broadcast: so many filters at most (5,040 orders).
MOST_FILTERS = 7

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def few_words(text: Column, least: int = 100) -> Column:
    return F.size(F.filter(F.split(text, _SPACE), lambda w: w != "")) < least


def repetitive(text: Column, percent: int = 80) -> Column:
    """Fewer distinct words than `percent` of all words; a text without words is not repetitive."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def shouting(text: Column, percent: int = 10) -> Column:
    """More capitals A-Z than `percent` of the code points."""
    return (F.length(text) - F.length(F.translate(text, _UPPER, ""))).cast("long") * 100 > F.length(text).cast("long") * percent


def marked(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Row-local filters by letter: true where a text fails.
FILTERS = {"A": few_words, "B": repetitive, "C": shouting, "D": marked}
#: The letter of the filter that looks at the whole table: a text that a smaller id has too.
REPEATED = "E"


def _failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask): a bit for each row-local filter that fails. Texts are read once and go no further."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(fails(F.col("text")), F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(FILTERS.values())), F.lit(0))
    return stored(rows.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), mask.cast("int").alias("mask")), "failures")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows with the bit of REPEATED set where a smaller id has the same text.

    The least id of each text is combined before the shuffle, and documents find out by their own id whether they are
    it: no join goes by the text, however many rows share it. A null id is never smaller than another, nor greater.
    """
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    known = rows.filter("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left")
    bit = F.when(F.col("first").isNull(), F.lit(1 << len(FILTERS))).otherwise(F.lit(0))
    return known.select("doc_id", "part", (F.col("mask") + bit).alias("mask")).union(rows.filter("doc_id IS NULL").select("doc_id", "part", "mask"))


def orders(spark, letters: str) -> DataFrame:
    """(order_id, filter_order, bits): every order of the letters, and the bit of each step's filter."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters have {factorial(len(letters))} orders; at most {MOST_FILTERS} filters are replayed")
    every = ["".join(p) for p in permutations(letters)]
    rows = [(k, o, [1 << letters.index(c) for c in o]) for k, o in enumerate(every)]
    return spark.createDataFrame(rows, "order_id int, filter_order string, bits array<int>")


def replay(rows: DataFrame, letters: str) -> DataFrame:
    """For each part, order and step of rows (part, mask, good, toxic): what the step keeps, removes and repeats.

    shapley: what the step's filter removes, summed over all orders, at any step.
    """
    every = orders(rows.sparkSession, letters)
    n = len(letters)
    fails_at = [F.when(F.col("mask").bitwiseAND(F.col("bits")[k]) != 0, F.lit(k + 1)).otherwise(F.lit(n + 1)) for k in range(n)]
    replayed = rows.crossJoin(F.broadcast(every.select("order_id", "bits"))).select("part", "mask", "good", "toxic", "order_id", "bits", F.least(*fails_at).alias("first"))
    steps = replayed.select("part", "mask", "good", "toxic", "order_id", "first", F.posexplode("bits").alias("at", "bit"))
    step, fails = F.col("at") + 1, F.col("mask").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    count = lambda c, name: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias(name)
    counted = steps.groupBy("part", "order_id", "at").agg(
        count(F.col("first") > step, "kept"), count(here, "removed"), count(fails & (F.col("first") < step), "redundant"),
        count(F.col("mask") == F.col("bit"), "unique_fails"), count(here & F.col("good"), "good_lost"), count(here & F.col("toxic"), "toxic_lost"),
    )
    named = counted.join(F.broadcast(every.select("order_id", "filter_order")), "order_id").withColumn("letter", F.expr("substring(filter_order, at + 1, 1)"))
    of_letter = Window.partitionBy("part", "letter")  # 120 rows for five filters
    return named.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(of_letter).alias("shapley")
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step of it.

    Nulls: a null text is empty, a null part the part ''; rows with a null id count, but repeat nothing and are not
    repeated. Rows that share id and text are no repeats of one another. A document is good (toxic) where any of its
    labels says 1. An empty table has no parts and no rows. Other columns are not looked at.
    """
    rows = _with_repeats(_failures(docs, id_col, text_col, part_col))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return replay(rows.join(said, "doc_id", "left").select("part", "mask", no("good"), no("toxic")), "".join(FILTERS) + REPEATED)
