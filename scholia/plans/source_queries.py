"""Queries over prepared source texts, identifiers in text, rejections, merge logs and metadata of works."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import dedup, evidence, retrieval, sources_of, synthesis, texts
from scholia.plans.registry import query
from scholia.plans.views import relation

# a candidate for each document: answers by rules of its key, whole texts
_ASKED = """SELECT doc_id, concat('rec_', CAST(doc_id AS STRING)) AS record_id, text, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE concat('p', CAST(doc_id AS STRING)) END AS pmid, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE concat('10.1/', CAST(doc_id AS STRING)) END AS doi,
  CAST(doc_id % 6 AS INT) AS p, CAST(doc_id % 7 AS INT) AS w FROM documents WHERE text IS NOT NULL AND text <> ''"""


@query(rf"""WITH a AS ({_ASKED}), s AS (SELECT *, pmid IS NOT NULL AND p = 0 AS p_bad, pmid IS NOT NULL AND p IN (1, 2) AS p_ok, doi IS NOT NULL AND w = 0 AS w_bad, doi IS NOT NULL AND w IN (1, 2, 3) AS w_ok FROM a),
t AS (SELECT *, CASE WHEN p_bad THEN NULL WHEN p_ok THEN text WHEN w_ok THEN reverse(text) END AS chosen FROM s)
SELECT record_id, CASE WHEN p_bad THEN 'fetch_failed' WHEN pmid IS NULL AND w_bad THEN 'parse_error' WHEN chosen IS NULL THEN 'no_abstract' ELSE 'ok' END AS status, CASE WHEN chosen IS NOT NULL THEN CASE WHEN p_ok THEN 'pubmed' ELSE 'crossref' END END AS origin,
  length(chosen) AS original_chars, coalesce(length(chosen) > 4000, false) AS truncated,
  CASE WHEN p_bad THEN 'timeout' WHEN pmid IS NULL AND w_bad THEN 'bad work' WHEN chosen IS NULL THEN concat_ws('; ', CASE WHEN pmid IS NOT NULL THEN CASE WHEN p = 3 THEN 'no abstract in PubMed efetch' ELSE 'PMID not returned by efetch' END END,
    CASE WHEN doi IS NOT NULL THEN CASE WHEN w_bad THEN 'bad work' ELSE 'Crossref work has no abstract' END END) END AS problem FROM t""")
def src_prepared_texts(spark, d):
    a = relation(spark, d, _ASKED)
    cached = a.filter("pmid IS NOT NULL AND p IN (1, 2, 3)").select("pmid", F.when(F.col("p") < 3, F.col("text")).alias("text"))
    failed = a.filter("pmid IS NOT NULL AND p = 0").select("pmid", F.lit("fetch_failed").alias("status"), F.lit("timeout").alias("message"))
    bad = F.col("w") == 0
    works = a.filter("doi IS NOT NULL AND w < 5").select("doi", F.when(F.col("w").between(1, 3), F.reverse("text")).alias("text"), F.when(bad, F.lit("parse_error")).alias("status"), F.when(bad, F.lit("bad work")).alias("message"))
    out = texts.prepared(a.select("record_id", "pmid", "doi"), cached, failed, works)
    return out.select("record_id", "status", "origin", F.col("source.original_chars").cast("long").alias("original_chars"), "source.truncated", "problem")


_SALTED = """SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' doi:10.1234/x.1 and 10.1234/y' WHEN 1 THEN ' PMID: 123' WHEN 2 THEN ' arXiv:2101.00001v2' ELSE '' END) AS t FROM documents WHERE text IS NOT NULL"""
_COUNT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM ({_SALTED})" for k, p in text.IDENTIFIERS.items())


@query(f"SELECT doc_id, kind, n FROM ({_COUNT}) WHERE n > 0")
def red_identifier_hits(spark, d):
    hits = relation(spark, d, _SALTED).select("doc_id", F.explode(text.identifier_hits(F.col("t"))).alias("h"))
    return hits.groupBy("doc_id", F.col("h.kind").alias("kind")).agg(F.count("*").alias("n"))


_CLAIMS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'causal_claim' WHEN 1 THEN 'association' WHEN 2 THEN 'mechanistic_support' ELSE 'observation' END AS level, CASE o_orderkey % 3 WHEN 0 THEN 'mechanistic_support' ELSE 'association' END AS supported FROM orders"


@query(f"""SELECT o_orderkey, CASE WHEN level = 'causal_claim' THEN 'Stated at the causal-claim level; causality remains untested.' ELSE 'Causality is not established: the cited evidence supports at most ' || replace(supported, '_', ' ') || '; stated at the ' || replace(level, '_', ' ') || ' level.' END AS statement FROM ({_CLAIMS})""")
def hyp_causality(spark, d):
    return relation(spark, d, _CLAIMS).select("o_orderkey", synthesis.causality_statement(F.col("level"), F.col("supported")).alias("statement"))


@query("""SELECT doc_id, CAST(item_index AS INT) AS item_index, CASE WHEN cited_id = record_id THEN cited_id END AS source_record_id, cited_id = record_id AS supplied, CASE WHEN cited_id = record_id THEN cited_id END AS value, CASE WHEN cited_id <> record_id THEN sha256(cited_id) END AS sha256,
  length(quote) AS quote_chars, length(claim) AS claim_chars FROM v_item""")
def val_rejections(spark, d):
    c = F.col
    i = relation(spark, d, "v_item").select("doc_id", "item_index", evidence.rejection(c("cited_id"), c("cited_id") == c("record_id"), {"quote": c("quote"), "claim": c("claim")}).alias("r"))
    return i.select("doc_id", c("item_index").cast("int").alias("item_index"), "r.source_record_id", "r.supplied", "r.reported.value", "r.reported.sha256", c("r.lengths.quote").cast("long").alias("quote_chars"), c("r.lengths.claim").cast("long").alias("claim_chars"))


# records of one investigation for every twenty orders, whose DOIs meet within it
_TOGETHER = "SELECT o_orderkey AS ordinal, CAST(floor(o_orderkey / 20) AS BIGINT) AS run, concat('r', CAST(o_orderkey AS STRING)) AS record_id, concat('10.1/', CAST(o_orderkey % 7 AS STRING)) AS doi, concat('Title ', CAST(o_orderkey % 7 AS STRING)) AS title FROM orders"


@query(f"""SELECT arg_min(record_id, ordinal) AS record_id, string_agg(record_id, ',' ORDER BY ordinal) AS merged_from, string_agg(CASE WHEN n > 1 THEN 'doi' END, ',' ORDER BY ordinal) AS matched_on FROM (SELECT *, row_number() OVER (PARTITION BY run, doi ORDER BY ordinal) AS n FROM ({_TOGETHER}))
  GROUP BY run, doi HAVING count(*) > 1""")
def dup_merge_entries(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    r = relation(spark, d, _TOGETHER).select("run", "ordinal", "record_id", F.lit("pubmed").alias("source_database"), "title", none("int").alias("year"), "doi", none("string").alias("pmid"), none("string").alias("journal"), F.array().cast("array<string>").alias("authors"))
    log = dedup.merge_log(dedup.deduplicated(r, F.col("title"), "run"))
    return log.select("record_id", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("matched_on", ",").alias("matched_on"))


_WORKS = """SELECT p_partkey, concat('{"DOI":"10.5/W', CAST(p_partkey AS STRING), '","type":"', CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'journal-article' END, '","container-title":["', p_brand, '",""],"publisher":"', CASE WHEN p_partkey % 2 = 0 THEN 'bioRxiv' ELSE 'P' END, '","institution":[{"name":"', p_type, '"}]}') AS work FROM part"""


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'journal-article' END AS type, p_brand || '|' || p_type || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'bioRxiv' ELSE 'P' END AS names, '10.5/W' || p_partkey AS doi FROM part""")
def cls_work_metadata(spark, d):
    m = relation(spark, d, _WORKS).select("p_partkey", sources_of.work_metadata(F.from_json("work", retrieval.WORK)).alias("m"))
    return m.select("p_partkey", "m.type", F.array_join("m.names", "|").alias("names"), "m.doi")
