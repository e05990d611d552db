"""Queries over graphs of many investigations: twenty documents are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import evidence, graph, provenance
from scholia.plans.registry import query
from scholia.plans.views import relation
from scholia.sources.storage import stored

_REC = """SELECT question_id AS graph_id, doc_id % 20 AS n, record_id, concat('Paper ', CAST(doc_id AS STRING)) AS title, ARR(concat('Fam', CAST(doc_id % 97 AS STRING), ', G'), 'Second, A') AS authors,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(1990 + doc_id % 30 AS INT) END AS year, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'Letters' END AS journal, doi, pmid, CAST(NULL AS STRING) AS source_url,
  verification AS verification_status, CASE doc_id % 3 WHEN 0 THEN 'preprint' WHEN 1 THEN 'peer-reviewed journal article' ELSE 'odd' END AS source_type, 'abstract' AS access_level, true AS abstract_only, text
FROM v_text WHERE fetched_status = 'ok'"""
_GRAPHS = f"SELECT graph_id, min(n) AS a, max(n) AS b FROM ({_REC}) AS r GROUP BY graph_id"
_EV_ID = "concat('ev_00', lpad(CAST({0} AS STRING), 2, '0'))"


def _inputs(spark, d):
    rec = relation(spark, d, _REC)
    number = lambda c: F.concat(F.lit("ev_00"), F.lpad(F.col(c).cast("string"), 2, "0"))
    ev = rec.select("graph_id", number("n").alias("evidence_id"), "record_id", F.concat(F.lit("Reading "), F.col("n").cast("string"), F.lit(" rose")).alias("claim"),
                    F.lit("Values rose").alias("finding"), F.col("text").alias("quote"), F.lit("established").alias("category"), F.lit("low").alias("confidence"))
    g = relation(spark, d, _GRAPHS)
    gaps = g.select("graph_id", F.lit("gap_01").alias("gap_id"), F.array(number("a")).alias("supporting"), F.array(number("b")).alias("conflicting"), F.lit("What drives the rise").alias("gap_statement"),
                    F.lit("No study compared both").alias("why_unresolved"), F.lit("low").alias("confidence"))
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    hyps = g.select("graph_id", F.lit("hyp_01").alias("hypothesis_id"), F.array(number("a")).alias("evidence_ids"), F.array(number("b")).alias("alternative_ids"), F.lit("gap_01").alias("gap_id"),
                    F.lit("Shear may raise counts").alias("hypothesis"), F.lit("It was seen once").alias("rationale"), texts("flow is steady").alias("assumptions"), texts("few items").alias("limitations"),
                    F.lit("Another cause").alias("alternative"), F.lit("association").alias("level"), F.lit("low").alias("confidence"), F.lit("Counts rise by a third").alias("prediction"),
                    texts("two groups", "counts", "no difference", "a clear rise").alias("tests"))
    return rec, ev, gaps, hyps


def _built(spark, d):
    rec, ev, gaps, hyps = _inputs(spark, d)
    return tuple(stored(x, name) for x, name in zip(provenance.build(rec, ev, gaps, hyps, rec), ("nodes", "edges", "excluded")))


_SPOIL = "CAST(graph_id % 10 AS INT)"
_KEYS = f"""SELECT graph_id, 'src:' || record_id AS node, n, source_type FROM ({_REC})"""


@query(f"""WITH r AS (SELECT *, {_SPOIL} AS k FROM ({_KEYS})), g AS (SELECT *, {_SPOIL} AS k FROM ({_GRAPHS})), e AS (SELECT *, {_EV_ID.format('n')} AS ev FROM r)
SELECT graph_id, 'graph_version' AS code, 'v0' AS item FROM g WHERE k = 0
UNION ALL SELECT graph_id, 'bibliographic_field_mismatch', node || ' title' FROM r WHERE k = 1
UNION ALL SELECT graph_id, 'source_type_mismatch', node FROM r WHERE k = 2
UNION ALL SELECT graph_id, 'preprint_label', node FROM r WHERE k = 3 AND source_type = 'preprint'
UNION ALL SELECT graph_id, 'evidence_mismatch', 'ev:' || ev FROM e WHERE k = 4
UNION ALL SELECT graph_id, 'hypothesis_warning', 'hyp:hyp_01' FROM g WHERE k = 5
UNION ALL SELECT graph_id, 'fabricated_citation', 'gap:gap_01' FROM g WHERE k = 6
UNION ALL SELECT graph_id, 'rejected_evidence_present', 'gap:gap_01' FROM g WHERE k = 7
UNION ALL SELECT graph_id, 'not_reproducible', CASE k WHEN 8 THEN 'edge|addresses|hyp:hyp_01|gap:gap_01' WHEN 5 THEN 'node|hyp:hyp_01' ELSE 'node|gap:gap_01' END FROM g WHERE k BETWEEN 5 AND 8
UNION ALL SELECT graph_id, 'not_reproducible', 'node|' || node FROM r WHERE k IN (1, 2) OR (k = 3 AND source_type = 'preprint')
UNION ALL SELECT graph_id, 'not_reproducible', 'node|ev:' || ev FROM e WHERE k = 4""")
def grf_attribute_violations(spark, d):
    """Nine graphs of ten are spoilt, each in one way; their rejected texts lie in one of them."""
    rec, ev, _, _ = _inputs(spark, d)
    nodes, edges, excluded = _built(spark, d)
    k, body = (F.col("graph_id") % 10).cast("int"), F.col("body")
    put = lambda n, kind, old, new: F.when((k == n) & (F.col("type") == kind), F.replace(body, F.lit(old), F.lit(new)))
    spoilt = F.coalesce(
        put(1, "source", '"title":"Paper', '"title":"paper'), put(2, "source", '"source_type":"', '"source_type":"x'), put(3, "source", '"preprint_label":"Preprint', '"preprint_label":"preprint'),
        put(4, "evidence", '"verified_quote":"', '"verified_quote":"x'), put(5, "hypothesis", '"warning":"Unvalidated', '"warning":"Validated'), put(6, "gap", "What drives", "Smith (1999) asks what drives"),
        put(7, "gap", "No study", 'A text \\"turned down\\" of no study'), body)
    changed = nodes.withColumn("body", spoilt)
    versions = relation(spark, d, _GRAPHS).select("graph_id", F.when(k == 0, F.lit("v0")).otherwise(F.lit(provenance.GRAPH_VERSION)).alias("graph_version"))
    rejected = relation(spark, d, _GRAPHS).select("graph_id", F.explode(F.array(F.lit('A text "turned down" of'), F.lit("Values rose"), F.concat(F.lit("Reading "), F.col("a").cast("string"), F.lit(" rose")))).alias("text"))
    rejected = rejected.union(relation(spark, d, _GRAPHS).select("graph_id", F.lit("never written anywhere")))
    held = edges.filter(~((k == 8) & (F.col("type") == "addresses")))
    return provenance.violations(changed, held, excluded, versions, rec, ev, rejected, (nodes, edges, excluded))


@query(f"SELECT graph_id, 'report_graph_citation_mismatch' AS code, record_id AS item FROM ({_REC}) WHERE graph_id % 4 = 1 AND n IN (SELECT a FROM ({_GRAPHS}) g WHERE g.graph_id = 1 UNION ALL SELECT 3)")
def grf_cited_violations(spark, d):
    """Graphs against what their reports cite: every fourth report leaves out some of its sources."""
    rec, ev, gaps, hyps = _inputs(spark, d)
    nodes, edges, _ = _built(spark, d)
    least = relation(spark, d, f"SELECT a FROM ({_GRAPHS}) AS g WHERE graph_id = 1").select(F.col("a").alias("n")).union(spark.range(3, 4))
    left_out = rec.filter("graph_id % 4 = 1").join(least.distinct(), "n", "left_semi").select("graph_id", "record_id")
    return graph.violations(nodes, edges, ev, gaps, hyps, rec, rec.join(left_out, ["graph_id", "record_id"], "left_anti"), provenance.PER)


@query(f"""SELECT graph_id, what, n FROM (SELECT graph_id, 'source' AS what, count(*) AS n FROM ({_REC}) GROUP BY 1 UNION ALL SELECT graph_id, 'evidence', count(*) FROM ({_REC}) GROUP BY 1
  UNION ALL SELECT graph_id, unnest(['gap', 'hypothesis', 'prediction', 'falsification_test']), 1 FROM ({_GRAPHS}))""")
def grf_nodes_of_many(spark, d):
    return _built(spark, d)[0].filter("body IS NOT NULL").groupBy("graph_id", F.col("type").alias("what")).agg(F.count("*").alias("n"))


_LINES = "SELECT doc_id % 3 AS graph_id, CAST(doc_id AS STRING) AS key, text AS line FROM documents WHERE text IS NOT NULL"


@query(f"""WITH l AS (SELECT graph_id, sha256(key) AS key, sha256(line) AS h, count(*) OVER (PARTITION BY graph_id) AS n FROM ({_LINES})),
p AS (SELECT graph_id, n, substr(key, 1, digits) AS part, sha256(string_agg(key || h, '' ORDER BY key, h)) AS h, max(digits) AS digits
      FROM (SELECT *, greatest(0, CAST(ceil(ln(n / 16.0) / ln(16.0) - 1e-12) AS INT)) AS digits FROM l) GROUP BY ALL)
SELECT graph_id, n, CASE WHEN max(digits) = 0 THEN max(h) ELSE sha256(string_agg(part || h, '' ORDER BY part)) END AS content_sha256 FROM p GROUP BY graph_id, n""")
def grf_content_hash(spark, d):
    """Documents as lines of three graphs, in parts of sixteen lines: two levels up to some thousands of lines a graph."""
    return provenance.content_hash(relation(spark, d, _LINES), 16)


@query(f"""SELECT graph_id, list_aggregate(list(record_id ORDER BY record_id), 'string_agg', ',') AS source_record_ids, list_aggregate(list({_EV_ID.format('n')} ORDER BY n), 'string_agg', ',') AS evidence_ids,
  'gap_01' AS gap_ids, 'hyp_01' AS hypothesis_ids FROM ({_REC}) GROUP BY graph_id""")
def grf_references(spark, d):
    refs = provenance.references(_built(spark, d)[0])
    return refs.select("graph_id", *[F.array_join(c, ",").alias(c) for c in ("source_record_ids", "evidence_ids", "gap_ids", "hypothesis_ids")])


_N = f"""SELECT graph_id, 'src:' || record_id AS id, 'Source' AS short, 'source' AS type, title || CASE WHEN source_type = 'preprint' THEN ' [Preprint — not peer-reviewed]' ELSE '' END AS title FROM ({_REC})
  UNION ALL SELECT graph_id, 'ev:' || {_EV_ID.format('n')}, {_EV_ID.format('n')}, 'evidence', 'Reading ' || n || ' rose' FROM ({_REC}) UNION ALL SELECT graph_id, 'gap:gap_01', 'gap_01', 'gap', 'What drives the rise' FROM ({_GRAPHS})
  UNION ALL SELECT graph_id, 'hyp:hyp_01', 'hyp_01 (unvalidated)', 'hypothesis', 'Shear may raise counts' FROM ({_GRAPHS}) UNION ALL SELECT graph_id, 'pred:hyp_01', 'Prediction hyp_01', 'prediction', 'Counts rise by a third' FROM ({_GRAPHS})
  UNION ALL SELECT graph_id, 'fals:hyp_01', 'Falsification hyp_01', 'falsification_test', 'counts' FROM ({_GRAPHS})"""
_E = f"""SELECT graph_id, 'supports' AS type, 'src:' || record_id AS s, 'ev:' || {_EV_ID.format('n')} AS t FROM ({_REC}) UNION ALL SELECT graph_id, 'supports', 'ev:' || {_EV_ID.format('a')}, 'hyp:hyp_01' FROM ({_GRAPHS})
  UNION SELECT graph_id, 'motivates', 'ev:' || {_EV_ID.format('a')}, 'gap:gap_01' FROM ({_GRAPHS}) UNION SELECT graph_id, 'motivates', 'ev:' || {_EV_ID.format('b')}, 'gap:gap_01' FROM ({_GRAPHS})
  UNION SELECT graph_id, 'contradicts', 'ev:' || {_EV_ID.format('a')}, 'ev:' || {_EV_ID.format('b')} FROM ({_GRAPHS}) WHERE a <> b UNION SELECT graph_id, 'addresses', 'hyp:hyp_01', 'gap:gap_01' FROM ({_GRAPHS})
  UNION SELECT graph_id, 'tests', unnest(['pred:hyp_01', 'fals:hyp_01']), 'hyp:hyp_01' FROM ({_GRAPHS})"""
_TEXT = lambda s: "'" + s.replace("'", "''") + "'"
_STYLE = lambda styles: "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in styles.items()) + " END"
# every title has at most two lines: a preprint's breaks before its last word
_WRAP = "CASE WHEN type = 'source' AND contains(title, '[') THEN replace(title, ' peer-reviewed]', chr(92) || 'npeer-reviewed]') ELSE title END"


@query(f"""SELECT graph_id, {_TEXT(provenance.DOT_HEAD)} || chr(10) || string_agg(line, chr(10) ORDER BY part, key) || chr(10) || {_TEXT(provenance.LEGEND)} || chr(10) || '}}' || chr(10) AS dot FROM (
  SELECT graph_id, 0 AS part, id AS key, '  "' || id || '" [label="' || short || chr(92) || 'n' || {_WRAP} || '", ' || {_STYLE(provenance.NODE_STYLE)} || '];' AS line FROM ({_N})
  UNION ALL SELECT graph_id, 1, type || '|' || s || '|' || t, '  "' || s || '" -> "' || t || '" [label="' || type || '", ' || {_STYLE(provenance.EDGE_STYLE)} || '];' FROM ({_E})) GROUP BY graph_id""")
def grf_dot_of_many(spark, d):
    nodes, edges, _ = _built(spark, d)
    return provenance.dot_texts(nodes, edges)


@query(f"""WITH n AS (SELECT graph_id, count(*) AS n_nodes FROM ({_N}) GROUP BY 1), e AS (SELECT graph_id, count(*) AS n_edges FROM ({_E}) GROUP BY 1)
SELECT graph_id, CASE WHEN graph_id % 3 = 0 THEN 'failed' ELSE 'passed' END AS status, CAST(CASE WHEN graph_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS errors, n_nodes, n_edges, CAST(0 AS BIGINT) AS n_excluded FROM n JOIN e USING (graph_id)""")
def grf_summaries(spark, d):
    nodes, edges, excluded = _built(spark, d)
    bad = relation(spark, d, _GRAPHS).filter("graph_id % 3 = 0").select("graph_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("code"))
    return provenance.summaries(nodes, edges, excluded, bad).drop("content_sha256")


@query(f"SELECT graph_id, 'gap_01' AS gap_id, {_EV_ID.format('a')} AS supporting, {_EV_ID.format('b')} AS conflicting FROM ({_GRAPHS})")
def prj_gap_view(spark, d):
    v = evidence.gap_view(_inputs(spark, d)[2], provenance.PER)
    return v.select("graph_id", "gap_id", F.array_join("supporting_evidence_ids", ",").alias("supporting"), F.array_join("conflicting_evidence_ids", ",").alias("conflicting"))
