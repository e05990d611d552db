"""Secret scan over an incremental blob ledger, in built-in functions only.

A blob is a text, addressed by its SHA-256; a path is a document that holds it. The ledger has a row for every
(blob, rule version) that was ever scanned, with its findings. A scan takes the distinct blobs of all versions,
leaves out the pairs that the ledger has, runs the rules on the rest, and joins old and new findings back to
every path. Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import keyed_texts, let, stored

LEDGER_SCHEMA = "blob string, rules string, spans array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """pattern: Java syntax; matches are found leftmost first, without overlap. keep: group and least length
    that a match needs; other matches are dropped after they were found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which ties of a start are listed. A run of 24 and more of the
#: hex letters is a greedy run that is long enough, and so for the access keys: these need no check afterwards.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES_VERSION = "base-1"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All kept matches of a rule: the pieces between matches and the matches add up to places."""
    pattern = F.lit(rule.pattern)

    def walk(pieces: Column, found: Column, kept: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,k:int>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.length(F.element_at(pieces, i + 1))
            end = at + F.length(F.element_at(found, i + 1))
            span = F.struct(F.lit(rule.kind).alias("kind"), at.alias("start"), end.alias("end"), F.lit(order).alias("k"))
            good = F.length(F.element_at(kept, i + 1)) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<kind:string,start:int,end:int,k:int>>")
    return F.when(
        F.rlike(text, pattern),
        let(F.split(text, rule.pattern, -1), lambda pieces: let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: let(
            F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda kept: walk(pieces, found, kept)))),
    ).otherwise(none)


def find_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of all rules by start, ties in the order of the rules."""
    every = F.concat(*[_spans(text, r, k) for k, r in enumerate(rules)])
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_new_blobs(paths: DataFrame, rules: tuple[Rule, ...], version: str, ledger: DataFrame | None) -> DataFrame:
    """Ledger rows for the (blob, version) pairs of paths (doc_id, text, blob) that the ledger lacks.

    One document stands for a blob; its text is read where it is found by (blob, id), null ids included."""
    reps = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    if ledger is not None:
        reps = reps.join(ledger.filter(F.col("rules") == version).select("blob"), "blob", "left_anti")
    reps = reps.withColumnRenamed("blob", "new")
    fresh = paths.join(reps.hint("shuffle_hash"), (F.col("blob") == F.col("new")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    scanned = fresh.select("blob", F.lit(version).alias("rules"), find_spans(F.col("text"), rules).alias("spans"))
    return scanned.dropDuplicates(["blob"])


def scan(documents: DataFrame, *, id_col="doc_id", text_col="text", rules=BASE_RULES, version=RULES_VERSION, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): findings (doc_id, blob, spans) has a row for each row of documents; additions are
    the ledger's new rows, stored, to be appended to it. With a ledger that has every blob nothing is scanned.

    Null texts are empty, and the empty text is a blob as any other. Null ids are paths too. Repeated rows each
    have their row. A rule set that changes needs a new version, which scans every blob once more.
    """
    paths = keyed_texts(documents, id_col, text_col).withColumn("blob", F.sha2("text", 256))
    additions = stored(scan_new_blobs(paths, rules, version, ledger), "ledger")
    known = additions if ledger is None else additions.union(ledger.filter(F.col("rules") == version).select("blob", "rules", "spans"))
    hits = known.filter(F.size("spans") > 0).select("blob", "spans")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = paths.select("doc_id", "blob").join(hits, "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), additions
