"""Abstracts for ranking and source texts for reading: eligibility, order, admission, caps, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import capped

RECORD_ID = r"^rec_[0-9a-f]{16}$"


def enriched(considered: DataFrame) -> DataFrame:
    """considered (pmid, pubmed_abstract, pubmed_failed, inline_abstract, ...) with abstract, abstract_origin and
    title_only_reason: the fetched abstract, else the one in the search result, else why there is none."""
    fetched = F.nullif(F.regexp_replace("pubmed_abstract", r"^\s+$", ""), F.lit(""))
    inline = F.nullif("inline_abstract", F.lit(""))
    has_id = F.col("pmid").isNotNull()
    origin = F.when(has_id & fetched.isNotNull() & ~F.col("pubmed_failed"), F.lit("pubmed_efetch")).when(inline.isNotNull(), F.lit("crossref_search_result"))
    out = considered.withColumn("abstract_origin", origin)
    reason = (
        F.when(has_id & F.col("pubmed_failed"), F.lit("pubmed efetch failed; no Crossref abstract in search result"))
        .when(has_id, F.lit("no abstract in PubMed efetch or Crossref search result"))
        .otherwise(F.lit("no abstract in Crossref search result (no PMID)"))
    )
    return out.withColumn("abstract", F.when(F.col("abstract_origin") == "pubmed_efetch", F.col("pubmed_abstract")).when(
        F.col("abstract_origin") == "crossref_search_result", F.col("inline_abstract"))).withColumn("title_only_reason", F.when(F.col("abstract_origin").isNull(), reason))


def eligibility(record_id: Column, doi: Column, pmid: Column, status: Column, partial: bool = False) -> Column:
    """struct(label, reason): whether a verified record's text may be read; reason is null if so."""
    opted = F.lit(partial)
    reason = (
        F.when(~F.coalesce(record_id.rlike(RECORD_ID), F.lit(False)), F.lit("record_id is not an opaque record id"))
        .when(doi.isNull() & pmid.isNull(), F.lit("record has no PMID or DOI to fetch an abstract with"))
        .when(status == "verified", F.lit(None))
        .when((status == "partially_verified") & opted, F.lit(None))
        .when(status == "partially_verified", F.lit("partially_verified records are excluded unless explicitly opted in"))
        .otherwise(F.concat(F.lit("verification status is "), F.coalesce(status, F.lit("missing"))))
    )
    label = F.when(reason.isNotNull(), F.lit("not_eligible")).when(status == "verified", F.lit("verified")).otherwise(F.lit("partially_verified_opt_in"))
    return F.struct(label.alias("label"), reason.alias("reason"))


def admitted(candidates: DataFrame, most: int, key: str = "question_id") -> DataFrame:
    """candidates (key, ordinal, eligibility, pmid, fetched_status) with status: in reading order - verified
    first, PMID first, then as given - texts are fetched while fewer than `most` usable ones were had; a fetch
    that failed frees its slot; the rest is source_limit."""
    order = [F.when(F.col("eligibility") == "verified", 0).otherwise(1), F.when(F.col("pmid").isNotNull(), 0).otherwise(1), F.col("ordinal")]
    usable = (F.col("fetched_status") == "ok").cast("int")
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(usable).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return candidates.withColumn("place", F.row_number().over(w)).withColumn("status", F.when(before < most, F.col("fetched_status")).otherwise(F.lit("source_limit")))


def source_text(text: Column, limit: int = 4000) -> Column:
    """struct(text, sha256, original_chars, text_chars, truncated, status)."""
    cut = capped(text, limit)
    some = F.coalesce(text, F.lit("")) != ""
    return F.struct(
        F.when(some, cut["text"]).alias("text"), F.when(some, F.sha2(cut["text"], 256)).alias("sha256"), F.when(some, F.length(text)).alias("original_chars"),
        F.when(some, F.length(cut["text"])).alias("text_chars"), F.coalesce(F.when(some, cut["truncated"]), F.lit(False)).alias("truncated"),
        F.when(some, F.lit("ok")).otherwise(F.lit("no_abstract")).alias("status"),
    )


def prepared(candidates: DataFrame, cached: DataFrame, failed: DataFrame, works: DataFrame, limit: int = 4000) -> DataFrame:
    """candidates (record_id, pmid, doi) with their source text: struct source of source_text(), origin, access_level and
    problem.

    A PMID's answer comes first: cached (pmid, text: null where the answer has no abstract); a PMID of a failed request
    (pmid, status, message) ends there. Where it has no text, the DOI's work is asked: works (doi, text, status and
    message where that request failed, null else). A failed work is the candidate's failure only without a PMID; else it has
    no abstract."""
    c = candidates.join(cached.select("pmid", F.col("text").alias("p_text"), F.lit(True).alias("p_known")), "pmid", "left")
    c = c.join(failed.select("pmid", F.col("status").alias("p_status"), F.col("message").alias("p_message")), "pmid", "left")
    c = c.join(works.select("doi", F.col("text").alias("w_text"), F.col("status").alias("w_status"), F.col("message").alias("w_message"), F.lit(True).alias("w_known")), "doi", "left")
    some = lambda t: F.coalesce(F.col(t), F.lit("")) != ""
    first = F.col("p_status").isNull() & some("p_text") & F.col("pmid").isNotNull()
    second = F.col("p_status").isNull() & ~first & F.col("doi").isNotNull() & F.col("w_status").isNull() & some("w_text")
    text = F.when(first, F.col("p_text")).when(second, F.col("w_text"))
    bad = F.col("p_status").isNotNull() | (F.col("pmid").isNull() & F.col("doi").isNotNull() & F.col("w_status").isNotNull())
    source = source_text(text, limit)
    asked = F.when(F.col("pmid").isNotNull(), F.when(F.col("p_known"), F.lit("no abstract in PubMed efetch")).otherwise(F.lit("PMID not returned by efetch")))
    work = F.when(F.col("doi").isNotNull(), F.when(F.col("w_status").isNotNull(), F.col("w_message")).otherwise(F.lit("Crossref work has no abstract")))
    problem = F.when(F.col("p_status").isNotNull(), F.col("p_message")).when(bad, F.col("w_message")).when(~first & ~second, F.concat_ws("; ", asked, work))
    origin = F.when(first, F.lit("pubmed")).when(second, F.lit("crossref"))
    status = F.when(F.col("p_status").isNotNull(), F.col("p_status")).when(bad, F.col("w_status")).otherwise(source["status"])
    return c.select(*candidates.columns, source.alias("source"), origin.alias("origin"), F.concat(origin, F.lit("_abstract")).alias("access_level"), status.alias("status"), problem.alias("problem"))


def model_sources(texts: DataFrame) -> DataFrame:
    """The three fields that may be shown to a model, of usable rows only."""
    return texts.filter("status = 'ok' AND text IS NOT NULL AND text <> ''").select("record_id", "access_level", F.col("text").alias("source_text"))
