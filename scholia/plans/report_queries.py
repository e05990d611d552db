"""Whole reports over documents: twenty documents are one investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import assembly
from scholia.operators.report import SECTIONS
from scholia.plans.registry import query
from scholia.plans.views import relation

_Q = "SELECT DISTINCT question_id AS q FROM v_text"
_EV = """SELECT question_id AS q, doc_id % 20 AS n, concat('ev_00', lpad(CAST(doc_id % 20 AS STRING), 2, '0')) AS evidence_id, record_id, concat('Claim [', CAST(doc_id AS STRING), ']') AS claim, text AS quote,
  CASE WHEN doc_id % 4 = 1 THEN 'conflicting' ELSE 'established' END AS category FROM v_text WHERE doc_id % 20 < 6 AND fetched_status = 'ok' AND question_id % 7 <> 6"""
_RECORDS = """SELECT question_id AS q, doc_id % 20 AS n, record_id, concat('Paper ', CAST(doc_id AS STRING)) AS title, doi, pmid, CASE doc_id % 3 WHEN 0 THEN 'preprint' WHEN 1 THEN 'peer-reviewed journal article' ELSE NULL END AS source_type,
  verification FROM v_text WHERE doc_id % 20 <> 3"""


def _inputs(spark, d):
    c, lit = F.col, F.lit
    q = relation(spark, d, _Q)
    reports = q.select(c("q").alias("report_id"), F.concat(lit("Question *"), c("q").cast("string"), lit("*")).alias("question"), F.when(c("q") % 3 > 0, lit("Does it rise?")).alias("restatement"), lit(None).cast("string").alias("scope"),
                       lit(None).cast("int").alias("from_year"), lit(2020).alias("to_year"), lit(7).alias("unique_records"))
    databases = reports.select("report_id", F.explode(F.array(lit("pubmed"), lit("crossref"))).alias("database"), lit("ok").alias("status"), lit(5).alias("hits"), lit(None).cast("int").alias("retrieved"))
    evidence = relation(spark, d, _EV).select(c("q").alias("report_id"), "evidence_id", c("n").alias("ordinal"), "record_id", "claim", "quote", "category", lit("low").alias("confidence"))
    none = F.array().cast("array<string>")
    gaps = reports.filter("report_id % 2 = 0").select("report_id", lit("gap_01").alias("gap_id"), lit("inference").alias("label"), lit("What drives it?").alias("gap_statement"), lit("No study did.").alias("why_unresolved"), lit("low").alias("confidence"),
                                                      F.array(lit("ev_0002"), lit("ev_0099"), lit("ev_0000")).alias("supporting"), none.alias("conflicting"))
    hyps = reports.filter("report_id % 4 = 0").select("report_id", lit("hyp_01").alias("hypothesis_id"), lit("Shear may matter").alias("hypothesis"), lit("causal_claim").alias("level"), lit("association").alias("supported_level"), lit("seen once").alias("rationale"),
                                                      lit("Counts rise").alias("prediction"), lit("gap_01").alias("gap_id"), F.array(lit("ev_0001")).alias("evidence_ids"), F.array(lit("few."), lit("old")).alias("limitations"), lit("low").alias("confidence"),
                                                      lit("not_run").alias("critic_status"), lit("not tested").alias("note"))
    records = relation(spark, d, _RECORDS).select(c("q").alias("report_id"), "record_id", F.array(lit("Fam, G")).alias("authors"), "title", lit(None).cast("string").alias("journal"), lit(1999).alias("year"), "doi", "pmid", lit(None).cast("string").alias("source_url"),
                                                  "source_type", c("verification").alias("verification_status"))
    second = evidence.filter("ordinal = 2").select("report_id", c("record_id").alias("r"))
    paragraphs = reports.filter("report_id % 5 = 1").join(second, "report_id", "left").select(
        "report_id", lit(1).alias("ordinal"), lit("key_findings").alias("section"), lit("established").alias("label"), lit(" It rose. ").alias("text"), F.array(lit("ev_0001")).alias("evidence_ids"), F.array_compact(F.array(c("r"), lit("rec_unknown"))).alias("source_ids"))
    rejected = reports.filter("report_id % 3 = 1").select("report_id", lit("evidence").alias("kind"), F.array(lit("quote_too_short")).alias("reason_codes"))
    return reports, databases, evidence, gaps, hyps, paragraphs, records, rejected


_ESC = lambda c: rf"regexp_replace(regexp_replace({c}, '[\r\n]', ' ', 'g'), '([\\`*_\[\]|<>#])', '\\\1', 'g')"
_BADGE = "CASE {0} WHEN 'preprint' THEN 'Preprint — not peer-reviewed' WHEN 'peer-reviewed journal article' THEN 'Peer-reviewed journal article (metadata label)' ELSE 'Source type unknown' END"
_HAS = "q % 5 = 1"  # reports with a paragraph of findings
_CTES = f"""WITH q AS ({_Q}), ev AS ({_EV}), rec AS ({_RECORDS}), par AS (SELECT q, (SELECT any_value(record_id) FROM ev WHERE ev.q = q.q AND n = 2) AS r FROM q WHERE {_HAS}),
uses AS (SELECT q, 3 AS s, n AS l, 1 AS p, record_id FROM ev WHERE NOT ({_HAS}) UNION ALL SELECT q, 3, 0, 1, record_id FROM ev WHERE {_HAS} AND n = 1 UNION ALL SELECT q, 3, 0, 2, r FROM par WHERE r IS NOT NULL UNION ALL SELECT q, 3, 0, 3, 'rec_unknown' FROM par
  UNION ALL SELECT q, 4, n, 1, record_id FROM ev),
num AS (SELECT q, record_id, min(s * 1000000 + l * 1000 + p) AS pos FROM uses GROUP BY ALL),
cit AS (SELECT *, CASE WHEN known THEN 'S' || row_number() OVER (PARTITION BY q, known ORDER BY pos) ELSE '[UNRESOLVED CITATION: ' || CASE WHEN regexp_matches(record_id, '^rec_[0-9a-f]{{16}}$') THEN record_id ELSE 'sha256 ' || sha256(record_id) END || ']' END AS m
  FROM (SELECT num.*, rec.record_id IS NOT NULL AS known FROM num LEFT JOIN rec USING (q, record_id)))"""


@query(f"{_CTES} SELECT q AS report_id, record_id, m AS marker, known AS resolved FROM cit")
def rep_report_citations(spark, d):
    return assembly.assembled(*_inputs(spark, d))[1].select("report_id", "record_id", "marker", "resolved")


@query(f"{_CTES} SELECT q AS report_id, {_BADGE.format('source_type')} AS badge, count(*) AS n FROM cit JOIN rec USING (q, record_id) GROUP BY ALL")
def agg_citation_types(spark, d):
    inputs = _inputs(spark, d)
    return assembly.type_counts(assembly.assembled(*inputs)[1], inputs[6])


@query("""WITH q AS (SELECT DISTINCT question_id AS q FROM v_text), ev AS (SELECT q, count(*) AS n FROM (""" + _EV + """) GROUP BY q),
n AS (SELECT q, coalesce(ev.n, 0) AS e, (q % 2 = 0)::INT + (q % 4 = 0)::INT + (q % 5 = 1)::INT AS s, (q % 3 = 1)::INT AS r FROM q LEFT JOIN ev USING (q))
SELECT q AS report_id, 'exact_quote' AS family, e + r AS checked, e AS passed, CAST(r AS BIGINT) AS failed FROM n UNION ALL SELECT q, unnest(['numeric_consistency', 'citation_validation']), e + s + r, e + s + r, 0 FROM n""")
def val_report_checks(spark, d):
    reports, _, evidence, gaps, hyps, paragraphs, _, rejected = _inputs(spark, d)
    n = lambda df, kind: df.groupBy("report_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    accepted = n(evidence, "evidence").unionByName(n(gaps, "synthesis")).unionByName(n(hyps, "synthesis")).unionByName(n(paragraphs, "synthesis"))
    return assembly.check_lines(rejected, accepted, reports)


def _line(section: str, order: str, text: str, source: str, where: str = "true") -> str:
    return f"SELECT q, {section} AS s, {order} AS l, {text} AS t FROM {source} WHERE {where}"


_REF = lambda alias: f"{alias}.evidence_id || ' [' || (SELECT m FROM cit WHERE cit.q = {alias}.q AND cit.record_id = {alias}.record_id) || ']'"
_REF_OF = lambda n: f"(SELECT {_REF('e')} FROM ev e WHERE e.q = x.q AND e.n = {n})"
_CHECK = lambda name, checked, failed, more="": f"""'- {name} (deterministic): ' || CASE WHEN {checked} > 0 THEN 'ran on ' || ({checked}) || ' item(s) — ' || ({checked} - {failed}) || ' passed, ' || {failed} || ' failed' ELSE 'not run (no items to check)' END || {more}'.'"""
_LINES = " UNION ALL ".join([
    _line("0", "0", "'# Research report'", "q"), *[_line(str(k + 1), "-2", f"chr(10) || '## {t}' || chr(10)", "q") for k, t in enumerate(SECTIONS)],
    _line("1", "0", "'- **Question (verbatim):** Question ' || chr(92) || '*' || q || chr(92) || '*'", "q"), _line("1", "1", "'- **Restatement (model-proposed):** Does it rise?'", "q", "q % 3 > 0"), _line("1", "2", "'- **Scope (model-proposed):** '", "q", "q % 3 > 0"),
    _line("1", "1", "'- Question definition unavailable; the raw question was used.'", "q", "q % 3 = 0"), _line("2", "0", "'- **Year filter:** from any to 2020'", "q"),
    _line("2", "1", "'- **crossref:** status ok, hits reported 5, candidates retrieved n/a'", "q"), _line("2", "2", "'- **pubmed:** status ok, hits reported 5, candidates retrieved n/a'", "q"), _line("2", "3", "'- **Unique records after deduplication:** 7'", "q"),
    _line("3", "n", f"'- **[' || category || ']** ' || {_ESC('claim')} || ' — evidence: ' || {_REF('x')}", "ev x", f"NOT ({_HAS})"),
    _line("3", "0", f"'- **[established]** It rose. — evidence: ' || coalesce({_REF_OF(1)}, 'none') || '; sources: ' || coalesce('[' || (SELECT m FROM cit WHERE cit.q = x.q AND record_id = r) || '], ', '') || '[' || (SELECT m FROM cit WHERE cit.q = x.q AND record_id = 'rec_unknown') || ']'", "par x", "r IS NOT NULL"),
    _line("3", "0", f"'- **[established]** It rose. — evidence: ' || coalesce({_REF_OF(1)}, 'none') || '; sources: [' || (SELECT m FROM cit WHERE cit.q = x.q AND record_id = 'rec_unknown') || ']'", "par x", "r IS NULL"),
    _line("3", "0", f"'{assembly.NO_FINDINGS}'", "q x", f"NOT ({_HAS}) AND q NOT IN (SELECT q FROM ev)"), _line("4", "0", f"'{assembly.NO_EVIDENCE}'", "q x", "q NOT IN (SELECT q FROM ev)"),
    _line("4", "-1", f"'{assembly.MATRIX}'", "(SELECT DISTINCT q FROM ev) x"),
    _line("4", "n", f"'| ' || evidence_id || ' | ' || {_ESC('claim')} || ' | ' || {_ESC('quote')} || ' | ' || category || ' | low | [' || (SELECT m FROM cit WHERE cit.q = x.q AND cit.record_id = x.record_id) || '] | **' || {_BADGE.format('(SELECT source_type FROM rec WHERE rec.q = x.q AND rec.record_id = x.record_id)')} || '** |'", "ev x"),
    _line("5", "n", f"'- **[conflicting]** ' || {_ESC('claim')} || ' — evidence: ' || {_REF('x')}", "ev x", "category = 'conflicting'"), _line("5", "0", f"'{assembly.NO_CONFLICT}'", "q x", "q NOT IN (SELECT q FROM ev WHERE category = 'conflicting')"),
    _line("6", "0", f"'{assembly.ABSTRACTS_ONLY}'", "q"), _line("6", "1", _CHECK("Exact-quote check", "e + r", "r"), "n"), _line("6", "2", _CHECK("Numeric-consistency check", "e + z + r", "0"), "n"),
    _line("6", "3", _CHECK("Citation/id validation", "e + z + r", "0", "'; citations rendered by code from verified records: ' || (SELECT count(*) FILTER (known) FROM cit WHERE cit.q = n.q) || ', unresolved: ' || (SELECT count(*) FILTER (NOT known) FROM cit WHERE cit.q = n.q) || "), "n"), _line("6", "9", f"'{assembly.NO_SEMANTIC}'", "q"),
    _line("7", "1", f"'- **gap' || chr(95) || '01** **[inference]** What drives it? Why unresolved: No study did. — supporting evidence: ' || coalesce(nullif(concat_ws(', ', {_REF_OF(2)}, {_REF_OF(0)}), ''), 'none') || '; conflicting evidence: none; confidence: low.'", "q x", "q % 2 = 0"), _line("7", "0", f"'{assembly.NO_GAPS}'", "q x", "q % 2 = 1"),
    _line("8", "-1", f"'{assembly.DISCLAIMER}'", "q"), _line("8", "0", f"'{assembly.NO_HYPOTHESES}'", "q", "q % 4 <> 0"),
    *[_line("8", str(k), t, "q x", "q % 4 = 0") for k, t in enumerate((
        "'### hyp_01'", "'- **Candidate hypothesis:** Shear may matter'", "'- **Claim level:** causal claim (cited evidence supports at most association).'", f"'- **Why it was proposed:** seen once — research gap gap_01; linked evidence: ' || coalesce({_REF_OF(1)}, 'none') || '.'",
        "'- **Prediction (measurable):** Counts rise'", "'- **Limitations:** few; old.'", "'- **Confidence (qualitative):** low.'", "'- **Critic review:** not run — not tested.'"), 1)],
    _line("9", "0", f"'{assembly.FULL_TEXT}'", "q"), _line("9", "1", f"'{assembly.DESIGN}'", "q", "q % 4 = 0"), _line("9", "2", f"'{assembly.SEARCH_GAPS}'", "q", "q % 2 = 0"),
    _line("10", "0", f"'Source types of cited sources: ' || coalesce((SELECT string_agg('**' || b || '** ' || k, ', ' ORDER BY b) FROM (SELECT {_BADGE.format('source_type')} AS b, count(*) AS k FROM cit JOIN rec USING (q, record_id) WHERE cit.q = x.q GROUP BY 1)), '') || '.'", "(SELECT DISTINCT q FROM cit) x"),
    _line("10", "pos", f"""CASE WHEN known THEN '- **[' || m || ']** **[' || {_BADGE.format('source_type')} || ']** Fam, G. *' || title || '*. journal not available. 1999. ' || coalesce('DOI: [' || doi || '](https://doi.org/' || doi || ').', 'DOI: not available.') || ' ' ||
      coalesce('PMID: [' || pmid || '](https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/).', 'PMID: not available.') || ' URL: not available. Verification: ' || verification || '. Record: `' || record_id || '`.' ELSE '- ' || m || ' — no record with this id; no citation rendered.' END""", "cit x LEFT JOIN rec USING (q, record_id)"),
    _line("10", "0", f"'{assembly.NO_SOURCES}'", "q", "q NOT IN (SELECT q FROM cit)"),
])


@query(f"""{_CTES}, n AS (SELECT q, (SELECT count(*) FROM ev WHERE ev.q = q.q) AS e, (q % 2 = 0)::INT + (q % 4 = 0)::INT + (q % 5 = 1)::INT AS z, (q % 3 = 1)::INT AS r FROM q)
SELECT q AS report_id, string_agg(t, chr(10) ORDER BY s, l) || chr(10) AS report FROM ({_LINES}) GROUP BY q""")
def rep_reports(spark, d):
    return assembly.assembled(*_inputs(spark, d))[0]
