"""Bridge views: the library's input relations, derived from whatever base tables are at hand.

Each view is one SQL text for Spark and, with its array constructor renamed, for any engine that an oracle runs
in. Keys are integers, orders are explicit, duplicates come from one modulus per key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Narrow tables by their key, whose rows become long texts and lists: a file of many rows is few splits, so they are
#: dealt out by key, this many rows to a task.
DEALT = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
ROWS_OF_A_TASK = 5_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # one bibliographic record for each order; an investigation has 25 of them
    "v_record": """
SELECT o_orderkey AS ordinal, CAST(floor(o_orderkey / 25) AS BIGINT) AS question_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'pubmed' ELSE 'crossref' END AS source_database,
  CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN concat('https://doi.org/10.1234/Abc.', CAST(o_orderkey % 4001 AS STRING))
    WHEN 2 THEN concat('doi: 10.1234/ABC.', CAST(o_orderkey % 4001 AS STRING), '.') WHEN 1 THEN concat(' 10.1234%2Fabc.', CAST(o_orderkey % 4001 AS STRING), ' ')
    ELSE concat('10.1234/abc.', CAST(o_orderkey % 4001 AS STRING)) END AS doi_raw,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('PMID: ', CAST(o_orderkey % 4001 + 1 AS STRING)) ELSE concat('00', CAST(o_orderkey % 4001 + 1 AS STRING)) END AS pmid_raw,
  concat(p_name, ' ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
  CASE o_orderkey % 4 WHEN 0 THEN concat('Fam', CAST(o_custkey % 97 AS STRING), ', Given') WHEN 1 THEN concat('Fam', CAST(o_custkey % 97 AS STRING), ' AB')
    WHEN 2 THEN concat('Given Fam', CAST(o_custkey % 97 AS STRING)) ELSE NULL END AS author,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN upper(o_orderstatus) ELSE concat('Journal ', o_orderpriority) END AS journal
FROM orders JOIN part ON p_partkey = o_orderkey % 200""",
    # search hits: seven queries, two databases, an investigation for every hundred orders
    "v_hit": """
SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS question_id, CASE WHEN l_suppkey % 2 = 0 THEN 'pubmed' ELSE 'crossref' END AS database, CAST(l_linenumber AS INT) AS query,
  CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 100) AS BIGINT), l_suppkey % 2, l_linenumber ORDER BY l_orderkey, l_partkey) - 1 AS INT) AS rank,
  concat('r', CAST(l_partkey % 97 AS STRING)) AS record_id
FROM lineitem""",
    # what the identifiers resolve to, disturbed by rules of the key
    "v_lookup": """
SELECT ordinal, kind, CASE WHEN ordinal % 17 = 0 THEN 'not_found' WHEN ordinal % 19 = 0 THEN 'lookup_failed' ELSE 'resolved' END AS outcome,
  CASE WHEN ordinal % 23 = 0 THEN concat(title, ' revisited') WHEN ordinal % 29 = 0 THEN NULL ELSE upper(title) END AS title,
  CASE WHEN ordinal % 31 = 0 THEN year + 1 ELSE year END AS year,
  CASE WHEN ordinal % 37 = 0 THEN 'Other, Name' ELSE author END AS author,
  CASE WHEN ordinal % 6 = 0 THEN concat(journal, ' of Record') ELSE journal END AS journal
FROM v_record CROSS JOIN (VALUES ('doi'), ('pmid')) AS k(kind)
WHERE (kind = 'doi' AND doi_raw IS NOT NULL) OR (kind = 'pmid' AND pmid_raw IS NOT NULL)""",
    # type metadata of parts, as two databases would give it
    "v_meta": """
SELECT p_partkey AS item, CASE p_partkey % 6 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'posted-content' WHEN 2 THEN 'proceedings-article' WHEN 3 THEN 'book-chapter' WHEN 4 THEN 'dataset' ELSE NULL END AS type,
  CASE WHEN p_partkey % 4 = 1 THEN 'preprint' ELSE NULL END AS subtype,
  CASE WHEN p_partkey % 31 = 0 THEN 'bioRxiv' WHEN p_partkey % 37 = 0 THEN 'Research Square' ELSE p_brand END AS container,
  CASE WHEN p_partkey % 41 = 0 THEN '10.48550/arXiv.2101.00001' ELSE concat('10.1234/', CAST(p_partkey AS STRING)) END AS doi,
  CASE p_partkey % 5 WHEN 0 THEN 'Journal Article' WHEN 1 THEN 'Review' WHEN 2 THEN 'Congress' WHEN 3 THEN 'Preprint' ELSE 'News' END AS pubtype
FROM part""",
    # documents as source texts
    "v_text": """
SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS question_id, concat('rec_', substr({sha}(CAST(doc_id AS STRING){bits}), 1, 16)) AS record_id, text,
  CASE doc_id % 5 WHEN 0 THEN 'partially_verified' WHEN 1 THEN 'not_verified' ELSE 'verified' END AS verification,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id + 1 AS STRING) END AS pmid, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('10.1234/d', CAST(doc_id AS STRING)) END AS doi,
  CASE WHEN doc_id % 7 = 0 THEN 'fetch_failed' WHEN doc_id % 11 = 0 THEN 'no_abstract' ELSE 'ok' END AS fetched_status
FROM documents""",
    # candidate evidence: seven items for each document, some of them spoilt
    "v_item": """
SELECT doc_id, CAST(item_index AS INT) AS item_index, record_id, text AS source_text,
  CASE WHEN (doc_id + item_index) % 13 = 0 THEN 'rec_unknown' ELSE record_id END AS cited_id,
  CASE (doc_id + item_index) % 7 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 12) WHEN 2 THEN concat(substr(text, 1, 30), '#') ELSE substr(text, 1 + CAST(item_index AS INT), 40) END AS quote,
  CASE (doc_id + item_index) % 6 WHEN 0 THEN 'established' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'inference' WHEN 3 THEN 'proven' ELSE 'established' END AS category,
  CASE (doc_id + item_index) % 8 WHEN 0 THEN 'very high' WHEN 1 THEN NULL WHEN 2 THEN 'low' WHEN 3 THEN 'moderate' ELSE 'high' END AS confidence,
  CASE WHEN (doc_id + item_index) % 9 = 0 THEN ' ' ELSE concat('In ', CAST(doc_id % 50 AS STRING), ' cases the value rose by ', CAST(item_index AS STRING), ' mg') END AS claim
FROM v_text CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS k(item_index)""",
    # accepted evidence ids: one for each document, and gaps and hypotheses that refer to them, some dangling
    "v_evidence": """
SELECT doc_id, concat('ev_', CASE WHEN doc_id < 10000 THEN lpad(CAST(doc_id AS STRING), 4, '0') ELSE CAST(doc_id AS STRING) END) AS evidence_id, record_id, CAST(floor(doc_id / 3) AS BIGINT) AS source_no,
  CASE WHEN doc_id % 10 = 3 THEN concat('See ', substr(text, 1, 20), ' (1999)') ELSE substr(text, 1, 60) END AS claim, substr(text, 20, 60) AS finding,
  CASE doc_id % 4 WHEN 0 THEN 'established' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'inference' ELSE 'established' END AS category,
  CASE doc_id % 6 WHEN 0 THEN 'Platelets treated with the blocker showed lower adhesion' WHEN 1 THEN 'Binding to the receptor was seen' WHEN 2 THEN 'Values were higher and associated with age'
    WHEN 3 THEN 'The membrane was observed' WHEN 4 THEN 'Knockout abolished the response' ELSE 'Signaling increased' END AS quote,
  CASE doc_id % 5 WHEN 0 THEN 'preprint' WHEN 1 THEN 'peer-reviewed journal article' WHEN 2 THEN 'peer-reviewed journal article' WHEN 3 THEN 'unknown' ELSE 'peer-reviewed journal article' END AS source_type
FROM v_text""",
    "v_gap": """
SELECT concat('gap_', lpad(CAST(q AS STRING), 2, '0')) AS gap_id, q, ARR(concat('ev_', lpad(CAST(q * 3 AS STRING), 4, '0')), concat('ev_', lpad(CAST(q * 3 + 1 AS STRING), 4, '0'))) AS supporting,
  CASE WHEN q % 3 = 0 THEN ARR(concat('ev_', lpad(CAST(q * 3 + 2 AS STRING), 4, '0'))) WHEN q % 7 = 1 THEN ARR('ev_9999') ELSE ARR(concat('ev_', lpad(CAST(q * 3 + 1 AS STRING), 4, '0'))) END AS conflicting,
  concat('What drives ', CAST(q AS STRING), ' cases of ev_', lpad(CAST(q AS STRING), 4, '0')) AS gap_statement, CASE WHEN q % 11 = 0 THEN 'Smith et al. disagree' ELSE 'No study compared both' END AS why_unresolved,
  CASE q % 4 WHEN 0 THEN 'sure' ELSE 'low' END AS confidence
FROM (SELECT DISTINCT doc_id % 60 AS q FROM documents) AS g""",
    "v_hyp": """
SELECT concat('hyp_', lpad(CAST(q AS STRING), 2, '0')) AS hypothesis_id, q, ARR(concat('ev_', lpad(CAST(q * 2 AS STRING), 4, '0')), concat('ev_', lpad(CAST(q * 2 + 1 AS STRING), 4, '0')), concat('ev_', lpad(CAST(q + 7 AS STRING), 4, '0'))) AS evidence_ids,
  CASE WHEN q % 5 = 0 THEN ARR(concat('ev_', lpad(CAST(q AS STRING), 4, '0'))) WHEN q % 13 = 1 THEN ARR('ev_9998') ELSE ARR(concat('ev_', lpad(CAST(q * 2 AS STRING), 4, '0'))) END AS alternative_ids,
  concat('gap_', lpad(CAST((q * 7) % 64 AS STRING), 2, '0')) AS gap_id,
  CASE q % 6 WHEN 0 THEN 'Shear causes platelet activation' WHEN 1 THEN 'Shear may cause platelet activation' WHEN 2 THEN 'It is well established that lipids matter' ELSE 'Membrane tension could raise signaling' END AS hypothesis,
  CASE q % 5 WHEN 0 THEN 'Adhesion increases by a fold' WHEN 1 THEN 'Membrane tension could raise signaling' WHEN 2 THEN '' ELSE 'Higher counts are expected' END AS prediction,
  CASE q % 4 WHEN 0 THEN 'causal_claim' WHEN 1 THEN 'association' WHEN 2 THEN 'mechanistic_support' ELSE 'observation' END AS level,
  CASE q % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS confidence
FROM (SELECT DISTINCT doc_id % 60 AS q FROM documents) AS g""",
    # model attempts: a conversation is a run, its turns are attempts
    "v_attempt": """
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars, CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(length(text) % 900 AS BIGINT) END AS output_tokens,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(length(text) % 70 AS BIGINT) END AS reasoning_tokens, CAST(ceil(length(text) / 3) AS BIGINT) + 8 AS input_tokens,
  CASE WHEN turn % 2 = 0 THEN CAST(length(text) % 900 + ceil(length(text) / 3) + 20 AS BIGINT) ELSE NULL END AS total_tokens,
  CASE WHEN turn % 5 = 0 THEN CAST(length(text) AS BIGINT) * 1000003 ELSE NULL END AS ticks, CASE WHEN turn % 5 = 1 THEN CAST(length(text) AS BIGINT) * 1009 ELSE NULL END AS nano
FROM conversations""",
}


def _needed(text: str, held: dict[str, str] | None = None) -> dict[str, str]:
    """The views that a text names, with those that they name first."""
    held = {} if held is None else held
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text) and name not in held:
            _needed(VIEWS[name], held)
            held[name] = VIEWS[name]
    return held


def with_views(query: str, spark: bool) -> str:
    """query with the views that it names as common table expressions."""
    views = _needed(query)
    text = query if not views else "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n" + query
    text = text.replace("{sha}", "sha2" if spark else "sha256").replace("{bits}", ", 256" if spark else "")
    return text.replace("ARR(", "array(" if spark else "list_value(")


def relation(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A query over base tables and views, or just the name of one."""
    if re.fullmatch(r"\w+", query):
        query = f"SELECT * FROM {query}"
    text = with_views(query, True)
    direct = " ".join([query, *[v for k, v in _needed(query).items() if k != "v_record"]])  # which joins 200 parts alone
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t in DEALT and re.search(rf"\b{t}\b", direct):
                table = dealt(table, DEALT[t])
            table.createOrReplaceTempView(t)
    return spark.sql(text)


def dealt(table: DataFrame, key: str, rows: int = ROWS_OF_A_TASK) -> DataFrame:
    """table by its key in as many partitions as its rows need; one of few rows as it is."""
    n = -(-table.count() // rows)
    return table.repartition(n, key) if n > 1 else table


def oracle(query: str) -> str:
    """The text of an oracle query; a WITH of its own continues that of the views."""
    views = _needed(query)
    if views and (m := re.match(r"\s*WITH\s+(RECURSIVE\s+)?", query)):
        head = "WITH " + (m[1] or "") + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + ",\n"
        text = head + query[m.end() :]
        return text.replace("{sha}", "sha256").replace("{bits}", "").replace("ARR(", "list_value(")
    return with_views(query, False)
