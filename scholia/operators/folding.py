"""Greedy folding of records in order, without gathering them: the rule of dedup.fold() as a fixed point.

What a record merges into depends only on earlier records. Given a guess of everyone's unit, each unit's state is known
after any of its constituents (a field is filled once and stays), and each record's first matching unit follows from these
states by a sweep over keys. The sequence of guesses has one fixed point, the result of the fold: a round settles at least
the first record that was wrong, in practice all that depend on settled ones. Rounds are joins, grouping and sorts.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.sources.storage import stored

#: Where a unit's last state ends, and whether a row of a sweep asks or begins a unit's state.
_OPEN, _ASKS, _BEGINS = 2**62, 0, 1
_STRETCH = 20_000  # records of the first stretch
_FIELDS = ("doi", "pmid", "title", "year", "author")
_EVENT = ("k1", "k2", "at", "what", "unit", "until", "mask")


def _keys(doi: Column, pmid: Column, triple: Column) -> Column:
    """array of (key, mask): by which a record and a unit can match, and which ids (1: DOI, 2: PMID) they must not both have then."""
    d, p = F.when(doi != "", F.concat(F.lit("d:"), doi)), F.when(pmid != "", F.concat(F.lit("p:"), pmid))
    has_d, has_p = F.when(d.isNotNull(), 1).otherwise(0), F.when(p.isNotNull(), 2).otherwise(0)
    one = lambda key, mask: F.when(key.isNotNull(), F.struct(key.alias("key"), mask.cast("int").alias("mask")))
    return F.array_compact(F.array(one(d, F.lit(0)), one(p, has_d), one(F.concat(F.lit("t:"), triple), has_d + has_p)))


def _triple(title: Column, year: Column, surname: Column) -> Column:
    return F.concat(title, F.lit("\n"), year.cast("string"), F.lit("\n"), surname)


def _events(df: DataFrame, what: int) -> DataFrame:
    """df (part, at, unit, until, keys) as rows of a sweep; a key is two hashes, 128 bits, of its text and part."""
    key = [F.concat_ws("\n", F.col("part").cast("string"), "_k.key")]
    return df.withColumn("_k", F.explode("keys")).select(
        F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(7), *key).alias("k2"), "at", F.lit(what).alias("what"), "unit", "until", F.col("_k.mask").alias("mask"))


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each row that asks, the first unit whose state at that time has the key; itself where there is none.

    Rows come by key and time. A heap for each mask holds the units that had the key so far; those whose state ended leave
    it when they come up."""
    last, heaps = None, {}
    for pdf in batches:
        at_out, unit_out = [], []
        for k1, k2, at, what, unit, until, mask in zip(*[pdf[c].tolist() for c in _EVENT]):
            if (k1, k2) != last:
                last, heaps = (k1, k2), {}
            if what == _BEGINS:
                heappush(heaps.setdefault(mask, []), (unit, until))
                continue
            best = at
            for m, h in heaps.items():
                if not m & mask:
                    while h and h[0][1] < at:
                        heappop(h)
                    if h and h[0][0] < best:
                        best = h[0][0]
            at_out.append(at)
            unit_out.append(best)
        yield pd.DataFrame({"ordinal": at_out, "unit": unit_out}, dtype="int64")


def _found(asked: DataFrame, begun: DataFrame) -> DataFrame:
    """(ordinal, unit): the first unit that each record meets, over all of its keys."""
    rows = asked.unionByName(begun).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at", "what")
    return rows.mapInPandas(_swept, "ordinal long, unit long").groupBy("ordinal").agg(F.min("unit").alias("unit"))


def _held(records: DataFrame, assigned: DataFrame, settled: DataFrame | None) -> DataFrame:
    """(part, unit, a struct of ordinal and v for each field): which record fills it; settled: the units of earlier stretches."""
    each = records.join(assigned.select("ordinal", "unit"), "ordinal").select("part", "unit", *[F.when(F.col(c).isNotNull(), F.struct("ordinal", F.col(c).alias("v"))).alias(c) for c in _FIELDS])
    each = each if settled is None else each.unionByName(settled)
    return each.groupBy("part", "unit").agg(*[F.min(c).alias(c) for c in _FIELDS])


def _begun(held: DataFrame, low: int | None) -> DataFrame:
    """Every state that a unit takes after low, with the one it has then, as rows of a sweep: (part, at: the ordinal that
    brought it, unit, until: the last ordinal that meets it, keys)."""
    times = F.concat(F.array("unit"), F.array_compact(F.array(*[F.col(f"{c}.ordinal") for c in _FIELDS])))
    times = F.array_sort(F.array_distinct(times if low is None else F.transform(times, lambda t: F.greatest(t, F.lit(low)))))
    each = held.select("*", F.posexplode(times).alias("_i", "at"), times.alias("_times"))
    now = lambda c: F.when(F.col(f"{c}.ordinal") <= F.col("at"), F.col(f"{c}.v"))
    until = F.coalesce(F.try_element_at("_times", F.col("_i") + 2), F.lit(_OPEN))
    return _events(each.select("part", "at", "unit", until.cast("long").alias("until"), _keys(now("doi"), now("pmid"), _triple(now("title")["key"], now("year"), now("author")["key"])).alias("keys")), _BEGINS)


def _guessed(asked: DataFrame, settled: DataFrame | None, low: int | None) -> DataFrame:
    """(ordinal, unit): the unit that a record meets as the earlier stretches left it; those that meet none go to the first of them with their leading key."""
    alone = asked.filter("mask = 0").select("k1", "k2", F.col("at").alias("ordinal"))
    met = None
    if settled is not None:
        found = stored(_found(asked, _begun(settled, low)), "fold-guess")
        met = found.filter("unit != ordinal")
        alone = alone.join(found.filter("unit = ordinal").select("ordinal"), "ordinal", "left_semi")
    firsts = alone.groupBy("k1", "k2").agg(F.min("ordinal").alias("unit"))
    free = alone.join(firsts, ["k1", "k2"]).select("ordinal", "unit")
    return stored(free if met is None else free.unionByName(met.select("ordinal", "unit")), "fold-units")


def units(records: DataFrame) -> DataFrame:
    """(ordinal, unit): the ordinal of the record into which each is merged, its own if none.

    Records are settled in stretches. A later stretch meets the units of earlier ones in the state that they are in by
    then, a row for each, and its first guess is what it meets.

    records: part (records of different ones never meet), ordinal (unique), doi, pmid, title, title_key, year, authors, surname."""
    keyed = lambda there, key: F.when(there, F.struct(F.col(key).alias("key")))
    base = records.select("part", F.col("ordinal").cast("long").alias("ordinal"), "doi", "pmid", "year", keyed(F.col("title").isNotNull(), "title_key").alias("title"), keyed(F.size("authors") > 0, "surname").alias("author"))
    base = stored(base.withColumn("keys", _keys(F.col("doi"), F.col("pmid"), _triple(F.col("title.key"), F.col("year"), F.col("author.key")))), "fold-records")
    able = base.filter(F.size("keys") > 0)
    asks = stored(_events(able.select("part", F.col("ordinal").alias("at"), F.col("ordinal").alias("unit"), F.col("ordinal").alias("until"), "keys"), _ASKS), "fold-asks")
    done, settled, low = base.filter(F.size("keys") == 0).select("ordinal", F.col("ordinal").alias("unit")), None, None
    for high in [*_stretches(able.select("ordinal"), able.count()), None]:
        within = lambda df, c: df.filter((F.lit(True) if low is None else F.col(c) > low) & (F.lit(True) if high is None else F.col(c) <= high))  # noqa: B023, E731
        asked, fresh = within(asks, "at"), within(able.drop("keys"), "ordinal")
        new, moved = _guessed(asked, settled, low), True
        while moved:
            held = stored(_held(fresh, new, settled), "fold-held")
            after = _found(asked, _begun(held, low)).join(new.select("ordinal", F.col("unit").alias("before")), "ordinal")
            after = stored(after.select("ordinal", "unit", (F.col("unit") != F.col("before")).alias("moved")), "fold-units")
            new, moved = after.drop("moved"), bool(after.filter("moved").take(1))
        done, settled, low = done.unionByName(new.select("ordinal", "unit")), held, high  # none moved: held is of these units
    return done


def _stretches(rows: DataFrame, n: int) -> list[int]:
    """Ordinals that end the first _STRETCH records, the first eight times as many, and so on: about, any will do."""
    sizes = []
    while _STRETCH * 8 ** len(sizes) * 2 < n:
        sizes.append(_STRETCH * 8 ** len(sizes) / n)
    return sorted(set(rows.select(F.percentile_approx("ordinal", sizes, 10_000)).first()[0])) if sizes else []
