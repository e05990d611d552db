"""Queries over searches, scoring of many questions, list stages and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import schemas
from scholia.functions.text import key_form
from scholia.functions.variants import key_paths, text_of
from scholia.operators import list_stage, progress, reviews, scoring, search, synthesis
from scholia.operators.evidence import BIBLIOGRAPHIC_KEYS, CATEGORIES
from scholia.plans.registry import query
from scholia.plans.views import relation
from scholia.sources.storage import stored

# ---- searches ----------------------------------------------------------------------------------

_HITS = "SELECT o_orderkey AS ordinal, concat(o_orderpriority, ' ', CAST(o_custkey % 97 AS STRING)) AS term, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year, concat('r', CAST(o_orderkey AS STRING)) AS record_id FROM orders"


@query(f"SELECT ordinal, record_id FROM ({_HITS}) WHERE term = '1-URGENT 5' AND year >= 1994 AND year <= 1996 ORDER BY ordinal LIMIT 1000")
def src_searched(spark, d):
    return search.searched(relation(spark, d, _HITS), "1-URGENT 5", 5000, 1994, 1996).select("ordinal", "record_id")


_SEARCHES = """SELECT c_custkey AS search_id, concat(CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '5-LOW' ELSE 'nothing' END, ' ', CAST(c_custkey % 97 AS STRING)) AS term, CAST(c_custkey % 11 * 3 - 5 AS INT) AS most,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(1993 + c_custkey % 4 AS INT) END AS from_year, CASE WHEN c_custkey % 3 = 0 THEN CAST(1995 + c_custkey % 3 AS INT) END AS to_year FROM customer"""


@query(f"""SELECT search_id, rank, ordinal FROM (SELECT search_id, most, ordinal, row_number() OVER (PARTITION BY search_id ORDER BY ordinal) - 1 AS rank FROM ({_SEARCHES}) s JOIN ({_HITS}) h USING (term)
  WHERE (from_year IS NULL AND to_year IS NULL) OR year BETWEEN coalesce(from_year, 1800) AND coalesce(to_year, 3000)) WHERE rank < least(most, 1000)""")
def src_searched_all(spark, d):
    out = search.searched_all(relation(spark, d, _HITS), relation(spark, d, _SEARCHES))
    return out.select("search_id", F.col("rank").cast("long").alias("rank"), "ordinal")


@query(f"""SELECT search_id, least(greatest(most, 0), 1000) AS retmax, CASE WHEN b THEN CAST(coalesce(from_year, 1800) AS VARCHAR) END AS mindate, CASE WHEN b THEN CAST(coalesce(to_year, 3000) AS VARCHAR) END AS maxdate,
  nullif(concat_ws(',', 'from-pub-date:' || from_year, 'until-pub-date:' || to_year), '') AS filter FROM (SELECT *, from_year IS NOT NULL OR to_year IS NOT NULL AS b FROM ({_SEARCHES}))""")
def src_search_parameters(spark, d):
    c = F.col
    s = relation(spark, d, _SEARCHES).select("search_id", search.id_search_parameters(c("term"), c("most"), c("from_year"), c("to_year")).alias("i"), search.works_search_parameters(c("term"), c("most"), c("from_year"), c("to_year")).alias("w"))
    return s.select("search_id", "i.retmax", "i.mindate", "i.maxdate", "w.filter")


# every sixth answer has another shape; of the others every third has items that are no objects
_WORKS = """SELECT p_partkey AS search_id, CASE p_partkey % 6 WHEN 1 THEN '[]' WHEN 2 THEN '{"status":"bad"}' WHEN 3 THEN concat('{"status":"ok","message":{"total-results":', CAST(p_partkey AS STRING), ',"items":[7,"x"]}}')
  ELSE concat('{"message":{"total-results":', CAST(p_partkey AS STRING), ',"items":[{"DOI":"10.5/W', CAST(p_partkey AS STRING), '","title":["', p_name, '"]}', CASE WHEN p_partkey % 6 = 4 THEN ',null' ELSE '' END, ',{"title":["Second"],"abstract":" "}]}}') END AS answer FROM part"""


@query(f"""SELECT search_id, CASE search_id % 6 WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' WHEN 4 THEN 'partial' ELSE 'ok' END AS status, CAST(CASE WHEN search_id % 6 IN (1, 2, 3) THEN 0 ELSE 2 END AS BIGINT) AS records,
  CASE WHEN search_id % 6 NOT IN (1, 2) THEN search_id END AS total FROM ({_WORKS})""")
def src_works_outcomes(spark, d):
    return search.works_found(relation(spark, d, _WORKS))[2]


@query("""SELECT p_partkey AS search_id, CAST(NULL AS INT) AS item_index, CASE p_partkey % 6 WHEN 1 THEN 'response is not a JSON object' ELSE 'reported status bad' END AS message FROM part WHERE p_partkey % 6 IN (1, 2)
  UNION ALL SELECT p_partkey, i, 'skipped malformed item at index ' || i || ' (not an object)' FROM part, (SELECT unnest([0, 1]) AS i) WHERE (p_partkey % 6 = 3) OR (p_partkey % 6 = 4 AND i = 1)""")
def src_works_errors(spark, d):
    return search.works_found(relation(spark, d, _WORKS))[1].select("search_id", "item_index", "message")


@query("""SELECT p_partkey AS search_id, CASE WHEN i = 0 THEN p_name ELSE 'Second' END AS title, CASE WHEN i = 0 THEN '10.5/w' || p_partkey END AS doi FROM part, (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 6 IN (0, 4, 5)""")
def src_works_records(spark, d):
    return search.works_found(relation(spark, d, _WORKS))[0].select("search_id", "record.title", "record.doi")


_IDS = "SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS search_id, CAST(floor(o_orderkey % 40 / 10) AS BIGINT) AS batch, CAST(o_orderkey AS STRING) AS pmid, o_orderkey FROM orders"


@query(f"""SELECT search_id, CASE WHEN count(*) FILTER (bad OR gone) = 0 THEN 'ok' WHEN count(*) FILTER (NOT bad AND NOT gone) > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) FILTER (NOT bad AND NOT gone) AS records,
  count(*) FILTER (gone AND NOT bad) AS missing FROM (SELECT search_id, (search_id % 5 = 0) OR (search_id % 3 = 0 AND batch = 1) AS bad, o_orderkey % 50 = 7 AS gone FROM ({_IDS})) GROUP BY search_id""")
def src_summaries(spark, d):
    ids = relation(spark, d, _IDS)
    failed = ids.select("search_id", "batch").distinct().filter("search_id % 5 = 0 OR (search_id % 3 = 0 AND batch = 1)").withColumn("error_type", F.lit("http_error"))
    _, errors, outcomes = search.summaries_found(ids, ids.filter("o_orderkey % 50 <> 7").select("pmid", F.lit("{}").alias("doc")), failed)
    missing = errors.filter("error_type = 'missing_summary'").groupBy("search_id").agg(F.count("*").alias("missing"))
    return outcomes.join(missing, "search_id", "left").select("search_id", "status", "records", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))


_OUTCOMES = """SELECT question_id, database, CASE WHEN (question_id + length(database)) % 7 = 0 THEN 'failed' WHEN question_id % 3 = 0 THEN 'partial' ELSE 'ok' END AS status, count(*) AS total FROM v_hit GROUP BY question_id, database"""
_CHECKED = "SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS question_id, CASE o_orderkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partially_verified' ELSE 'not_verified' END AS status FROM orders WHERE o_orderkey % 5 > 0"
_ERRORS = "SELECT question_id, database FROM v_hit WHERE rank % 13 = 5"


@query(f"""WITH o AS ({_OUTCOMES}), per AS (SELECT question_id, max(status) FILTER (database = 'pubmed') AS status_pubmed, max(status) FILTER (database = 'crossref') AS status_crossref, max(total) FILTER (database = 'pubmed') AS hits_pubmed,
  max(total) FILTER (database = 'crossref') AS hits_crossref, coalesce(string_agg(DISTINCT database, ',' ORDER BY database) FILTER (status = 'failed'), '') AS failed_databases, coalesce(string_agg(DISTINCT database, ',' ORDER BY database) FILTER (status = 'partial'), '') AS partially_failed_databases FROM o GROUP BY question_id),
r AS (SELECT question_id, count(*) AS total_retrieved, count(*) FILTER (database = 'pubmed') AS retrieved_pubmed, count(*) FILTER (database = 'crossref') AS retrieved_crossref, count(DISTINCT record_id) AS unique_records FROM v_hit GROUP BY question_id),
v AS (SELECT question_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'partially_verified') AS partially_verified, count(*) FILTER (status = 'not_verified') AS not_verified FROM ({_CHECKED}) GROUP BY question_id),
e AS (SELECT question_id, count(*) AS errors_count, string_agg(DISTINCT database, ',' ORDER BY database) AS databases_with_errors FROM ({_ERRORS}) GROUP BY question_id)
SELECT question_id, status_pubmed, status_crossref, hits_pubmed, hits_crossref, total_retrieved, retrieved_pubmed, retrieved_crossref, unique_records, coalesce(verified, 0) AS verified, coalesce(partially_verified, 0) AS partially_verified,
  coalesce(not_verified, 0) AS not_verified, coalesce(errors_count, 0) AS errors_count, total_retrieved - unique_records AS duplicates_merged, failed_databases, partially_failed_databases, coalesce(databases_with_errors, '') AS databases_with_errors
FROM per LEFT JOIN r USING (question_id) LEFT JOIN v USING (question_id) LEFT JOIN e USING (question_id)""")
def agg_run_summary(spark, d):
    hits = relation(spark, d, "v_hit")
    out = search.run_summary(relation(spark, d, _OUTCOMES), hits, hits.select("question_id", "record_id").distinct(), relation(spark, d, _CHECKED), relation(spark, d, _ERRORS))
    return out.select(*[F.array_join(c, ",").alias(c) if c.endswith("databases") or c.startswith("databases") else F.col(c) for c in out.columns])


@query("SELECT question_id, string_agg(database, ',' ORDER BY q, r, database) AS databases FROM (SELECT question_id, database, min(query * 1000000 + rank) AS m, m // 1000000 AS q, m % 1000000 AS r FROM v_hit GROUP BY question_id, database) GROUP BY question_id")
def agg_databases_seen(spark, d):
    out = search.first_seen(relation(spark, d, "v_hit"), "question_id", "database", ["query", "rank"])
    return out.select("question_id", F.array_join("values", ",").alias("databases"))


@query("SELECT question_id, ordinal, row_number() OVER (PARTITION BY question_id ORDER BY ordinal) AS place FROM v_record WHERE ordinal % 4 <> 1")
def jn_checked(spark, d):
    r = relation(spark, d, "v_record").select("question_id", "ordinal", F.col("ordinal").alias("record_id"))
    out = search.checked_in_order(r, r.filter("ordinal % 4 <> 1").union(r.filter("ordinal % 4 = 0")), "question_id", "record_id", "ordinal")
    return out.select("question_id", F.col("record_id").alias("ordinal"), F.col("place").cast("long").alias("place"))


# ---- scoring of many questions -----------------------------------------------------------------

_CATALOG = (  # concepts that occur in the names of parts
    scoring.Concept("widget", ("widget",), True, (r"\bwidgets?\b",), (r"\bcolou?r\w*", r"\bsize\w*"), (r"\bwidget\w*|\bgizmo\w*",)),
    scoring.Concept("small", ("small", "tiny"), False, (), (r"\bsize\w*",), (r"\bsmall\b|\btiny\b",)),
    scoring.Concept("metal", ("metal",), False, (), (r"\bmetals?\b",), (r"\bsteel\b|\bbrass\b|\brod\b|\bplate\b",)),
)
_ASKED = {  # question: its stems, and whether it asks for widget, small, metal
    "What size of widget meets urgent orders?": (("size", "widget", "meets", "urgent", "orders"), (True, True, False)),
    "Which metals fit low priority gears?": (("metals", "fit", "low", "priori", "gears"), (False, False, True)),
}
_ANCHOR, _SMALL, _METAL = r"\bwidget\w*|\bgizmo\w*", r"\bsmall\b|\btiny\b", r"\bsteel\b|\bbrass\b|\brod\b|\bplate\b"


def _question_sql(which: int) -> str:
    stems, (widget, small, metal) = list(_ASKED.values())[which]
    hit = lambda t, s: f"(len(list_filter(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: starts_with(w, '{s}'))) > 0)"
    has = lambda t, p, on: f"(coalesce(regexp_matches({t}, '{p}'), false) AND {str(on).lower()})"
    tw, aw = has("t", _ANCHOR, widget), has("a", _ANCHOR, widget)
    facets = [(has("t", p, on), has("a", p, on)) for p, on in ((_SMALL, small), (_METAL, metal))]
    title = f"15 * {tw}::INT + 10 * ({' + '.join(f'{t}::INT' for t, _ in facets)}) + 3 * ({' + '.join(hit('t', s) + '::INT' for s in stems)})"
    abstract = f"7 * (NOT {tw} AND {aw})::INT + 5 * ({' + '.join(f'({a} AND NOT {t})::INT' for t, a in facets)}) + ({' + '.join('(' + hit('a', s) + ' AND NOT ' + hit('t', s) + ')::INT' for s in stems)})"
    return f"SELECT *, {title} AS title_score, CASE WHEN a IS NULL THEN 0 ELSE {abstract} END AS abstract_score FROM r WHERE question_id % 2 = {which}"


@query(f"""WITH r AS (SELECT ordinal, question_id, lower(title) AS t, lower('A small steel widget of low urgency for ' || author) AS a, CASE WHEN ordinal % 7 = 1 THEN 4 ELSE 1 END - CASE WHEN ordinal % 7 = 1 THEN 1 ELSE 0 END AS o, ordinal % 50 + 1 AS br FROM v_record),
s AS ({_question_sql(0)} UNION ALL {_question_sql(1)}),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY title_score + o DESC, br, ordinal) AS n FROM s)
SELECT ordinal, question_id, n <= 4 AS considered, CAST(title_score + o + CASE WHEN n <= 4 THEN abstract_score ELSE 0 END AS BIGINT) AS base_score FROM n""")
def sco_enriched(spark, d):
    r = relation(spark, d, "v_record")
    origin = F.array(F.struct((F.col("ordinal") % 7).cast("int").alias("query"), F.col("source_database").alias("database"), (F.col("ordinal") % 50 + 1).cast("int").alias("rank")))
    candidates = r.select("ordinal", "question_id", F.lpad(F.col("ordinal").cast("string"), 12, "0").alias("record_id"), "title", origin.alias("origins"))
    texts = list(_ASKED)
    questions = r.select("question_id").distinct().select("question_id", F.when(F.col("question_id") % 2 == 0, F.lit(texts[0])).otherwise(F.lit(texts[1])).alias("question"))
    abstracts = r.select("question_id", F.lpad(F.col("ordinal").cast("string"), 12, "0").alias("record_id"), F.concat(F.lit("A small steel widget of low urgency for "), "author").alias("abstract"))
    out = scoring.enriched(candidates, questions, abstracts, 4, catalog=_CATALOG)
    return out.select("ordinal", "question_id", "considered", F.col("base_score").cast("long").alias("base_score"))


# ---- list stages -------------------------------------------------------------------------------

# one answer for each customer: its items differ by the customer's key, every eleventh is no list
_ANSWERS = """SELECT c_custkey AS run_id, c_custkey % 9 = 0 AS repaired, CASE WHEN c_custkey % 11 = 5 THEN '{"items":7}' WHEN c_custkey % 11 = 6 THEN NULL ELSE concat('{"items":[{"id":"ev_0001","claim":"', c_name, '","category":"established"},{"claim":"', c_name, '","category":"',
  CASE WHEN c_custkey % 3 = 0 THEN 'proven' ELSE 'inference' END, '"},{"claim":"x","category":"inference"', CASE WHEN c_custkey % 4 = 0 THEN ',"meta":{"Paper Title":"T"}' ELSE '' END, CASE WHEN c_custkey % 4 = 2 THEN ',"odd":1' ELSE '' END, '},"text",{"claim":"y","category":"inference"}]}') END AS answer FROM customer"""
_FIELDS = ("claim", "category", "id")
_CODES = ("malformed_item", "fabricated_bibliographic_field", "unexpected_field", "unsupported_evidence_category")


def _judge(raw):
    fields = F.try_variant_get(raw, "$", "map<string,variant>")
    keys = F.map_keys(fields)
    category = text_of(F.element_at(fields, "category"))
    bib = F.exists(key_paths(raw, depth=4), lambda p: key_form(p["key"]).isin(*BIBLIOGRAPHIC_KEYS))
    codes = [F.when(bib, F.lit(_CODES[1])), F.when(F.exists(keys, lambda k: ~k.isin(*_FIELDS)), F.lit(_CODES[2])), F.when(~F.coalesce(category.isin(*CATEGORIES), F.lit(False)), F.lit(_CODES[3]))]
    reason = lambda c: F.struct(c.alias("code"), F.lit("").alias("detail"))
    return F.when(fields.isNull(), F.array(reason(F.lit(_CODES[0])))).otherwise(F.transform(F.array_compact(F.array(*codes)), reason))


def _stage(spark, d):
    return list_stage.run(relation(spark, d, _ANSWERS), "items", _judge, _FIELDS, _CODES, BIBLIOGRAPHIC_KEYS, max_items=4, id_field="id")


_CODES_SQL = f"""SELECT run_id, i, CASE WHEN i = 4 THEN 'exceeds_item_limit' WHEN i = 3 THEN 'malformed_item' WHEN i = 1 AND run_id % 3 = 0 THEN 'unsupported_evidence_category' WHEN i = 2 AND run_id % 4 = 0 THEN 'fabricated_bibliographic_field,unexpected_field'
  WHEN i = 2 AND run_id % 4 = 2 THEN 'unexpected_field' ELSE '' END AS codes, repaired FROM ({_ANSWERS}), (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE run_id % 11 NOT IN (5, 6)"""


@query(f"""SELECT run_id, CAST(i AS INT) AS item_index, CASE i WHEN 0 THEN '{{"category":"established","claim":"' || c_name || '","id":"ev_0001"}}' WHEN 1 THEN '{{"category":"inference","claim":"' || c_name || '"}}' ELSE '{{"category":"inference","claim":"x"}}' END AS item
  FROM ({_CODES_SQL}) JOIN customer ON c_custkey = run_id WHERE codes = ''""")
def lst_accepted(spark, d):
    return _stage(spark, d).accepted.select("run_id", "item_index", "item")


@query(f"""SELECT run_id, CAST(i AS INT) AS item_index, codes, CASE WHEN i = 3 THEN 'str' ELSE 'dict' END AS item_type, CASE WHEN i <> 3 THEN 'claim,category' END AS fields_present, CASE WHEN i <> 3 THEN CASE WHEN i = 2 AND run_id % 2 = 0 THEN 1 ELSE 0 END END AS others
  FROM ({_CODES_SQL}) WHERE codes <> ''""")
def lst_rejected(spark, d):
    r = _stage(spark, d).rejected
    return r.select("run_id", "item_index", F.array_join("reason_codes", ",").alias("codes"), "diagnostics.item_type", F.when(F.col("diagnostics.fields_present").isNotNull(), F.array_join("diagnostics.fields_present", ",")).alias("fields_present"),
                    F.col("diagnostics.other_field_count").alias("others"))


@query(f"""SELECT run_id, repaired, coalesce(items, '') AS items FROM ({_ANSWERS}) LEFT JOIN (SELECT run_id, string_agg(i || ':' || CASE WHEN codes = '' THEN 'accepted' ELSE 'rejected' END, ',' ORDER BY i) AS items FROM ({_CODES_SQL}) GROUP BY run_id) USING (run_id)""")
def lst_plan(spark, d):
    one = lambda x: F.concat(x["item_index"].cast("string"), F.lit(":"), x["status"])
    return _stage(spark, d).plan.select("run_id", "repaired", F.array_join(F.transform("items", one), ",").alias("items"))


@query(f"""SELECT what, CAST(n AS BIGINT) AS n FROM (SELECT count(*) AS returned, count(*) FILTER (codes = '') AS accepted, count(*) FILTER (codes <> '') AS rejected, (SELECT count(*) FROM ({_ANSWERS}) WHERE run_id % 11 IN (5, 6)) AS failed_runs, count(*) FILTER (codes LIKE '%exceeds%') AS rejected_exceeds_item_limit,
  count(*) FILTER (codes LIKE '%malformed%') AS rejected_malformed_item, count(*) FILTER (codes LIKE '%fabricated%') AS rejected_fabricated_bibliographic_field, count(*) FILTER (codes LIKE '%unexpected%') AS rejected_unexpected_field, count(*) FILTER (codes LIKE '%category%') AS rejected_unsupported_evidence_category
  FROM ({_CODES_SQL})) UNPIVOT (n FOR what IN (returned, accepted, rejected, failed_runs, rejected_exceeds_item_limit, rejected_malformed_item, rejected_fabricated_bibliographic_field, rejected_unexpected_field, rejected_unsupported_evidence_category))""")
def lst_counts(spark, d):
    return spark.createDataFrame(sorted(_stage(spark, d).counts.items()), "what string, n long")


# ---- reviews -----------------------------------------------------------------------------------

# a run of six reviews for each customer: valid, duplicate, unknown candidate, other keys, other verdicts, valid after a malformed one
_CHECK_JSON = ",".join(f'"{k}":{{"verdict":"%s","explanation":"%s"}}' for k in reviews.CHECKS)
_BODY = lambda verdict, said: "{" + _CHECK_JSON % tuple(x for _ in reviews.CHECKS for x in (verdict, said)) + "}"
_KINDS = {
    0: ("hyp_01", _BODY("pass", "holds  up"), '["ev_0001","ev_0009"]', '[]', ""), 1: ("hyp_01", _BODY("fail", "again"), "[]", "[]", ""), 2: ("hyp_77", _BODY("pass", "x"), "[]", "[]", ""),
    3: ("hyp_02", _BODY("pass", "x"), "[]", "[]", ',"more":1'), 4: ("hyp_02", _BODY("maybe", "x"), "[]", "[]", ""), 5: ("hyp_02", _BODY("fail", "see ev_0404"), "7", '["Smith et al. say so"," ","c","d","e","f"]', ""),
}
_REVIEW = "CASE i " + " ".join(f"""WHEN {k} THEN '{{"hypothesis_id":"{h}","checks":{c},"unsupported_evidence_ids":{u},"substantive_problems":{p}{more}}}'""" for k, (h, c, u, p, more) in _KINDS.items()) + " END"
_REVIEWS = f"SELECT c_custkey AS run_id, CAST(i AS INT) AS item_index, {_REVIEW} AS review FROM customer CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(i) WHERE (c_custkey + i) % 7 <> 0"


def _reviewed(spark, d):
    runs = relation(spark, d, "SELECT c_custkey AS run_id FROM customer")
    ids = lambda *xs: F.array(*[F.lit(x) for x in xs])
    candidates = runs.select("run_id", F.explode(ids("hyp_01", "hyp_02")).alias("hypothesis_id"), ids("ev_0001", "ev_0002").alias("evidence_ids"))
    context = runs.select("run_id", ids("ev_0001", "ev_0002").alias("evidence"), ids().cast("array<string>").alias("sources"), ids("gap_01").alias("gaps"))
    return candidates, reviews.validated(relation(spark, d, _REVIEWS), candidates, context)


_DUE = """SELECT run_id, i AS item_index, CASE i WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN run_id % 7 <> 0 THEN 'duplicate_review' ELSE 'ok' END WHEN 2 THEN 'unknown_hypothesis_id' WHEN 5 THEN 'ok' ELSE 'malformed_review' END AS code
  FROM (SELECT run_id, item_index AS i FROM (""" + _REVIEWS + "))"


@query(f"""SELECT run_id, CAST(item_index AS INT) AS item_index, code, CASE WHEN code = 'ok' THEN CASE WHEN item_index = 5 THEN 'hyp_02' ELSE 'hyp_01' END END AS hypothesis_id, CASE WHEN code = 'ok' THEN CASE item_index WHEN 0 THEN 'pass:holds up' WHEN 1 THEN 'fail:again' ELSE 'fail:{reviews.WITHHELD}' END END AS first_check,
  CASE WHEN code = 'ok' THEN CASE WHEN item_index = 0 THEN 'ev_0001' ELSE '' END END AS unsupported, CASE WHEN code = 'ok' THEN CASE WHEN item_index = 5 THEN '{reviews.WITHHELD}|c|d|e' ELSE '' END END AS problems,
  CASE WHEN code = 'ok' THEN item_index > 0 END AS has_substantive_problems, CASE WHEN code = 'ok' THEN item_index = 5 END AS sanitized FROM ({_DUE})""")
def rev_validated(spark, d):
    r = _reviewed(spark, d)[1]
    joined = lambda c, sep: F.when(F.col(c).isNotNull(), F.array_join(c, sep))
    check = F.element_at("checks", reviews.CHECKS[0])
    return r.select("run_id", "item_index", "code", "hypothesis_id", F.concat(check["verdict"], F.lit(":"), check["explanation"]).alias("first_check"), joined("unsupported_evidence_ids", ",").alias("unsupported"),
                    joined("substantive_problems", "|").alias("problems"), "has_substantive_problems", "sanitized")


@query(f"""WITH r AS (SELECT c_custkey AS run_id, CASE c_custkey % 8 WHEN 3 THEN 'failed' WHEN 5 THEN 'not_run' ELSE 'ok' END AS outcome FROM customer), d AS ({_DUE}),
have AS (SELECT run_id, bool_or(code = 'ok' AND item_index < 5) AS h1, bool_or(code = 'ok' AND item_index = 5) AS h2 FROM d GROUP BY run_id),
s AS (SELECT run_id, h1, h2, CASE WHEN outcome <> 'ok' THEN outcome WHEN h1 AND h2 THEN 'completed' ELSE 'incomplete' END AS critic FROM r JOIN have USING (run_id)),
h AS (SELECT run_id, critic, unnest(['hyp_01', 'hyp_02']) AS hypothesis_id, unnest([h1, h2]) AS reviewed FROM s)
SELECT run_id, hypothesis_id, CASE WHEN reviewed OR critic IN ('not_run', 'failed') THEN critic ELSE 'incomplete' END AS critic_status,
  CASE WHEN (CASE WHEN reviewed OR critic IN ('not_run', 'failed') THEN critic ELSE 'incomplete' END) <> 'completed' THEN '{reviews.NOT_TESTED}' WHEN hypothesis_id = 'hyp_02' THEN '{reviews.REVISED}' ELSE '{reviews.COMPLETED}' END AS note FROM h""")
def rev_stress(spark, d):
    candidates, r = _reviewed(spark, d)
    r = stored(r.filter("code = 'ok'").select("run_id", "hypothesis_id", "code"), "reviews")
    calls = relation(spark, d, "SELECT c_custkey AS run_id, CASE c_custkey % 8 WHEN 3 THEN 'failed' WHEN 5 THEN 'not_run' ELSE 'ok' END AS outcome FROM customer")
    status = reviews.critic_status(candidates, r, calls)
    ok = r.filter("code = 'ok'").select("run_id", "hypothesis_id", F.lit(True).alias("has"))
    c = candidates.join(ok.hint("merge"), ["run_id", "hypothesis_id"], "left").join(status.hint("merge"), "run_id")
    revision = F.when(F.col("hypothesis_id") == "hyp_02", F.lit("revised")).otherwise(F.lit("no revision required"))
    return c.select("run_id", "hypothesis_id", reviews.stress_summary(F.coalesce("has", F.lit(False)), F.col("critic_status"), revision).alias("s")).select("run_id", "hypothesis_id", "s.critic_status", "s.note")


@query(f"SELECT run_id, 'hyp_0' || h AS hypothesis_id, min(i) AS item_index FROM (SELECT c_custkey AS run_id, i, (c_custkey + i) % 4 AS h FROM customer, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i)) WHERE h IN (1, 2) GROUP BY run_id, h")
def rev_first_revisions(spark, d):
    runs = relation(spark, d, "SELECT c_custkey AS run_id, i AS item_index, concat('hyp_0', CAST((c_custkey + i) % 4 AS STRING)) AS hypothesis_id FROM customer CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(i)")
    return reviews.first_revisions(runs, _reviewed(spark, d)[0])


# ---- progress ----------------------------------------------------------------------------------

_CALLS = """SELECT conv_id AS run_id, turn AS seq, CASE (conv_id + turn) % 8 WHEN 0 THEN 'question' WHEN 1 THEN 'extraction' WHEN 2 THEN 'extraction' WHEN 3 THEN 'gaps' WHEN 4 THEN 'hypotheses' WHEN 5 THEN 'hypothesis_critic' WHEN 6 THEN 'report' ELSE 'other' END AS call FROM conversations"""
_EVENTS = f"""SELECT run_id, seq, n, stage, state FROM (SELECT run_id, seq, before, stage AS s FROM (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM (SELECT run_id, seq, CASE call WHEN 'question' THEN 'define' WHEN 'extraction' THEN 'extract'
  WHEN 'hypothesis_critic' THEN 'hypotheses' ELSE call END AS stage FROM ({_CALLS}) WHERE call <> 'other')) WHERE before IS NULL OR before <> stage), LATERAL (SELECT before AS stage, 'done' AS state, 0 AS n WHERE before IS NOT NULL UNION ALL
  SELECT 'check', 'done', 1 WHERE before = 'extract' UNION ALL SELECT s, 'running', (before IS NOT NULL)::INT + (coalesce(before, '') = 'extract')::INT)"""


@query(f"SELECT run_id, seq, n, stage, state FROM ({_EVENTS})")
def ctl_progress_events(spark, d):
    return progress.call_events(relation(spark, d, _CALLS))


@query(f"""SELECT run_id, stage, CASE WHEN state IS NULL THEN 'skipped' WHEN state = 'running' THEN 'done' ELSE state END AS state FROM (SELECT run_id, unnest(['define', 'search', 'verify', 'extract', 'check', 'gaps', 'hypotheses', 'report']) AS stage FROM (SELECT DISTINCT conv_id AS run_id FROM conversations))
  LEFT JOIN (SELECT run_id, stage, arg_max(state, seq * 10 + n) AS state FROM ({_EVENTS}) GROUP BY ALL) USING (run_id, stage)""")
def ctl_progress_final(spark, d):
    calls = relation(spark, d, _CALLS)
    return progress.final_states(progress.call_events(calls), calls.select("run_id").distinct())


_MOVES = "SELECT conv_id AS run_id, turn AS seq, 0 AS n, CASE conv_id % 3 WHEN 0 THEN 'define' WHEN 1 THEN 'gaps' ELSE 'odd' END AS stage, CASE (conv_id * 3 + turn * 5) % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'running' END AS state FROM conversations"


@query(f"""SELECT run_id, seq, stage, state, before, stage <> 'odd' AND CASE before WHEN 'pending' THEN state IN ('running', 'done', 'skipped', 'failed') WHEN 'running' THEN state IN ('running', 'done', 'failed') WHEN 'done' THEN state IN ('running', 'done') ELSE state = before END AS legal
  FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id, stage ORDER BY seq), 'pending') AS before FROM ({_MOVES}))""")
def ctl_progress_judged(spark, d):
    return progress.judged(relation(spark, d, _MOVES)).drop("n")


# ---- schemas -----------------------------------------------------------------------------------

_SCHEMA = T.StructType([
    T.StructField("section", T.StringType(), False, {"choices": ["key_findings", "limitations"]}), T.StructField("text", T.StringType(), False), T.StructField("note", T.StringType(), True),
    T.StructField("ids", T.ArrayType(T.StringType(), False), False, {"most": 2}), T.StructField("score", T.StructType([T.StructField("n", T.LongType(), False), T.StructField("ok", T.BooleanType(), False)]), False)])
_SHAPES = """SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN concat('```json', chr(10), '{"section":"odd","text":"', p_name, '","ids":["a",3],"score":{"n":1.5,"ok":"yes"},"more":1}', chr(10), '```') WHEN 2 THEN '{"text":null,"note":7,"ids":"x","score":[]}'
  WHEN 3 THEN '[1]' WHEN 4 THEN 'no json' WHEN 5 THEN concat('{"section":"limitations","text":"', p_name, '","note":"n","ids":["a","b","c"],"score":{"n":2,"ok":true}}')
  ELSE concat('{"section":"limitations","text":"', p_name, '","note":null,"ids":["a"],"score":{"n":', CAST(p_partkey AS STRING), ',"ok":true}}') END AS answer FROM part"""


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 4 THEN 'invalid_output_json' WHEN 1 THEN 'schema_violation' WHEN 2 THEN 'schema_violation' WHEN 3 THEN 'schema_violation' WHEN 5 THEN 'schema_violation' END AS problem, CASE p_partkey % 8
  WHEN 1 THEN 'section: Input should be ''key_findings'' or ''limitations''; note: Field required; ids.1: Input should be a valid string; score.n: Input should be a valid integer; score.ok: Input should be a valid boolean; ... and 1 more'
  WHEN 2 THEN 'section: Field required; text: Input should be a valid string; note: Input should be a valid string; ids: Input should be a valid list; score: Input should be a valid dictionary'
  WHEN 3 THEN '<root>: Input should be a valid dictionary' WHEN 5 THEN 'ids: List should have at most 2 items after validation, not 3' END AS summary, CASE WHEN p_partkey % 8 IN (0, 6, 7) THEN p_partkey END AS n FROM ({_SHAPES})""")
def jsn_schema(spark, d):
    v = relation(spark, d, _SHAPES).select("p_partkey", schemas.validated(F.col("answer"), _SCHEMA, 5).alias("v"))
    return v.select("p_partkey", "v.problem", "v.summary", F.col("v.value.score.n").alias("n"))


# ---- hypotheses with all their texts -----------------------------------------------------------

# a hypothesis for each document, which cites the evidence of its document; seven of eight have one flaw
_FLAWS = """SELECT doc_id, concat('ev_', lpad(CAST(doc_id % 10000 AS STRING), 4, '0')) AS evidence_id, concat('Platelets were seen to rise. ', text) AS quote, CAST(doc_id % 8 AS INT) AS flaw FROM documents WHERE text IS NOT NULL"""


@query(f"""SELECT doc_id, CASE flaw WHEN 6 THEN 'identifier_in_text' ELSE '' END AS hard, CASE flaw WHEN 1 THEN 'untraceable_quote' WHEN 2 THEN 'unsupported_claim' WHEN 3 THEN 'unsupported_claim|procedural_protocol_detail' WHEN 4 THEN 'empty_text' WHEN 5 THEN 'self_labeled_discovery' ELSE '' END AS soft FROM ({_FLAWS})""")
def hyp_whole_flags(spark, d):
    c, lit = F.col, F.lit
    f = relation(spark, d, _FLAWS)
    flaw = lambda n, text, plain: F.when(c("flaw") == n, lit(text)).otherwise(lit(plain))
    evidence = f.select("doc_id", "evidence_id", lit("Counts rose by 12 mg").alias("claim"), lit(None).cast("string").alias("finding"), "quote", lit(None).cast("string").alias("source_text"))
    texts = {"hypothesis": lit("Shear may matter for adhesion"), "rationale": F.when(c("flaw") == 7, lit('As said: "Platelets were seen"')).otherwise(flaw(1, 'As said: "never written in any text"', "It was seen once")),
             "prediction": F.when(c("flaw") == 3, lit("Counts rise by 12 mL in all")).otherwise(flaw(2, "Counts rise by 987654321 mg", "Counts rise by 12 mg")), "alternative": lit("Another cause"), "weakening": lit("No difference"),
             "supporting": lit("A clear rise"), "compared": lit("Two groups"), "measured": lit("Adhesion of cells")}
    h = f.select("doc_id", *[x.alias(k) for k, x in texts.items()], F.array(F.when(c("flaw") == 4, lit(" ")).when(c("flaw") == 5, lit("this is a breakthrough")).when(c("flaw") == 6, lit("see 10.1234/x.1 there")).otherwise(lit("flow is steady"))).alias("assumptions"),
                 F.array(lit("few items")).alias("limitations"), F.array("evidence_id").alias("evidence_ids"), F.array().cast("array<string>").alias("alternative_ids"))
    h = synthesis.with_references(h, evidence, list(texts), ["assumptions", "limitations"], key="doc_id", per=())
    none = F.array().cast("array<string>")
    cols = {k: c(k) for k in (*texts, "assumptions", "limitations", "evidence_ids", "alternative_ids", "quote_refs", "number_problems")}
    cols |= {"basis": lit("inference"), "level": lit("observation"), "confidence": lit("low"), "gap_id": lit("gap_01"), "gaps": F.array(lit("gap_01")), "sources": none, "evidence": c("evidence_ids"), "supported_level": lit("observation")}
    hard, soft = synthesis.hypothesis_flags(cols)
    return h.select("doc_id", F.array_join(F.array_distinct(hard), "|").alias("hard"), F.array_join(soft, "|").alias("soft"))


@query(f"""WITH r AS (SELECT c_custkey AS run_id, CASE c_custkey % 8 WHEN 3 THEN 'failed' WHEN 5 THEN 'not_run' ELSE 'ok' END AS outcome FROM customer), d AS ({_DUE}),
have AS (SELECT run_id, max(item_index) FILTER (code = 'ok' AND item_index < 5) AS h1, bool_or(code = 'ok' AND item_index = 5) AS h2 FROM d GROUP BY run_id),
s AS (SELECT run_id, h1, h2, CASE WHEN outcome <> 'ok' THEN outcome WHEN h1 IS NOT NULL AND h2 THEN 'completed' ELSE 'incomplete' END AS critic FROM r JOIN have USING (run_id)),
h AS (SELECT run_id, critic, 'hyp_01' AS hypothesis_id, CASE h1 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS verdict FROM s UNION ALL SELECT run_id, critic, 'hyp_02', CASE WHEN h2 THEN 'fail' END FROM s)
SELECT run_id, hypothesis_id, CASE WHEN verdict IS NOT NULL OR critic <> 'completed' THEN critic ELSE 'incomplete' END AS critic_status, verdict FROM h""")
def rev_safe_stress(spark, d):
    candidates, r = _reviewed(spark, d)
    r = stored(r.filter("code = 'ok'").select("run_id", "hypothesis_id", "code", "checks"), "reviews")
    calls = relation(spark, d, "SELECT c_custkey AS run_id, CASE c_custkey % 8 WHEN 3 THEN 'failed' WHEN 5 THEN 'not_run' ELSE 'ok' END AS outcome FROM customer")
    status = reviews.critic_status(candidates, r, calls)
    c = candidates.join(r.filter("code = 'ok'").select("run_id", "hypothesis_id", "checks").hint("merge"), ["run_id", "hypothesis_id"], "left").join(status.hint("merge"), "run_id")
    s = reviews.safe_stress_summary(F.col("checks").isNotNull(), F.col("critic_status"), F.col("checks"))
    return c.select("run_id", "hypothesis_id", s.alias("s")).select("run_id", "hypothesis_id", "s.critic_status", F.element_at("s.critic_verdicts", reviews.CHECKS[0]).alias("verdict"))


@query(r"""SELECT ordinal, regexp_matches(lower(title), '\bsmall\b|\btiny\b|\bsteel\b|\bbrass\b|\brod\b|\bplate\b|\bwidget|\bgizmo|\bsize|\bmeets|\burgent|\borders') AS relevant FROM v_record""")
def prj_text_relevant(spark, d):
    r = relation(spark, d, "v_record")
    origin = F.array(F.struct(F.lit(1).alias("query"), F.col("source_database").alias("database"), F.lit(1).alias("rank")))
    catalog = (*_CATALOG[:2], scoring.Concept("metal", ("metal",), False, (), (r"\bsize\w*",), _CATALOG[2].text))
    s = scoring.scored(r.select("ordinal", F.col("ordinal").cast("string").alias("record_id"), "title", F.lit(None).cast("string").alias("abstract"), origin.alias("origins")), next(iter(_ASKED)), catalog)
    return s.select("ordinal", scoring.text_relevant(F.col("concepts"), F.col("keyword_hits")).alias("relevant"))
