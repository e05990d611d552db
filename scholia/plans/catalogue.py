"""Every query of the library by name, with the SQL that says the same where SQL can.

A query applies operators to bridge views over the base tables; its oracle restates the semantics in SQL over the
same views. Names begin with the family of the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import dates, identity, numbers, payloads, text
from scholia.operators import control, dedup, evidence, graph, report, retrieval, scoring, sources_of, synthesis, texts, verification
from scholia.plans import graph_queries, payload_queries, report_queries, source_queries, stage_queries  # noqa: F401 - they list their queries
from scholia.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from scholia.plans.views import relation
from scholia.sources.storage import stored

def _joined(c, sep: str = "|"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# ---- identity ----------------------------------------------------------------------------------

_DOI = r"""nullif(regexp_extract(lower(regexp_replace(trim(regexp_replace(trim(url_decode(doi_raw)), '(?i)^(?:\s*(?:(?:https?://)?(?:www\.|dx\.)?doi\.org/|doi\s*:\s*|doi\s+))+', '')), '[.,;:''"\s]+$', '')), '^10\.[0-9]+(?:\.[0-9]+)*/\S+$'), '')"""
_PMID = r"""CASE WHEN TRY_CAST(regexp_replace(trim(pmid_raw), '(?i)^pmid\s*[:#]?\s*', '') AS BIGINT) > 0 THEN CAST(TRY_CAST(regexp_replace(trim(pmid_raw), '(?i)^pmid\s*[:#]?\s*', '') AS BIGINT) AS VARCHAR) END"""
_TITLE = "nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '')"
_SURNAME = """CASE WHEN author IS NULL THEN NULL WHEN contains(author, ',') THEN regexp_replace(lower(split_part(author, ',', 1)), '[^a-z0-9]+', '', 'g')
  WHEN regexp_matches(split_part(author, ' ', -1), '^[A-Z]{1,4}$') THEN regexp_replace(lower(split_part(author, ' ', 1)), '[^a-z0-9]+', '', 'g')
  ELSE regexp_replace(lower(split_part(author, ' ', -1)), '[^a-z0-9]+', '', 'g') END"""
_IDS = f"SELECT *, {_DOI} AS doi, {_PMID} AS pmid, {_TITLE} AS title_key, {_SURNAME} AS surname FROM v_record"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    r = relation(spark, sf_dir, "v_record")
    r = r.withColumn("doi", identity.doi(c("doi_raw"))).withColumn("pmid", identity.pmid(c("pmid_raw")))
    r = r.withColumn("title_key", identity.ascii_title(c("title"))).withColumn("surname", identity.ascii_surname(c("author")))
    return r.withColumn("record_id", identity.record_id(c("source_database"), c("doi"), c("pmid"), c("title_key"), c("year"), c("surname"), F.lit(None).cast("string")))


_RECORD_ID = """concat('rec_', substr(sha256(CASE WHEN doi IS NOT NULL THEN concat(source_database, '|doi:', doi) WHEN pmid IS NOT NULL THEN concat(source_database, '|pmid:', pmid)
  ELSE concat(source_database, '|title:', coalesce(title_key, ''), '|year:', coalesce(CAST(year AS VARCHAR), 'None'), '|fa:', coalesce(surname, ''), '|url:') END), 1, 16))"""


@query(f"SELECT ordinal, doi FROM ({_IDS})")
def nrm_doi(spark, d):
    return _records(spark, d).select("ordinal", "doi")


@query(f"SELECT ordinal, pmid FROM ({_IDS})")
def nrm_pmid(spark, d):
    return _records(spark, d).select("ordinal", "pmid")


@query(f"SELECT ordinal, title_key, surname FROM ({_IDS})")
def nrm_title_surname(spark, d):
    return _records(spark, d).select("ordinal", "title_key", "surname")


@query(f"SELECT ordinal, title_key, surname FROM ({_IDS})")
def nrm_unicode_forms(spark, d):
    r = relation(spark, d, "v_record")
    return r.select("ordinal", identity.title_form("title").alias("title_key"), identity.surname_form("author").alias("surname"))


@query(f"SELECT ordinal, {_RECORD_ID} AS record_id FROM ({_IDS})")
def prj_record_id(spark, d):
    return _records(spark, d).select("ordinal", "record_id")


@query("SELECT user_id, 's1:' || sha256('scholia-live:user' || user_id || '@example.org') AS identity FROM (SELECT DISTINCT user_id FROM events)")
def prj_identity_key(spark, d):
    users = relation(spark, d, "SELECT DISTINCT user_id FROM events")
    return users.select("user_id", identity.identity_key(F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.org ")), None).alias("identity"))


@query("SELECT ordinal, CAST(year AS BIGINT) AS year FROM v_record WHERE year >= 1994 AND year <= 1996")
def prj_year_filter(spark, d):
    return relation(spark, d, "v_record").filter(F.col("year").between(1994, 1996)).select("ordinal", F.col("year").cast("long").alias("year"))


# ---- text --------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_KEYWORDS = rf"""(SELECT item_id, list(w ORDER BY i) AS words FROM (
  SELECT item_id, w, min(i) AS i FROM (SELECT item_id, regexp_replace(w, '^-+|-+$', '', 'g') AS w, i FROM (
    SELECT item_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (SELECT item_id, regexp_extract_all(regexp_replace(lower(text),
      '\b10\.\d{{4,9}}/\S+|https?://\S+|\bpmid:?\s*\d+|\S+@\S+', ' ', 'g'), '[a-z][a-z\-]*[a-z]') AS m FROM benchmark)))
  WHERE length(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY item_id, w) GROUP BY item_id)"""


@query(f"SELECT item_id, coalesce(array_to_string(words[1:8], '|'), '') AS keywords FROM benchmark LEFT JOIN {_KEYWORDS} USING (item_id)")
def txt_keywords(spark, d):
    return relation(spark, d, "benchmark").select("item_id", _joined(text.keywords(F.col("text"))).alias("keywords"))


@query(f"""SELECT item_id, coalesce(s, '') AS stems FROM benchmark LEFT JOIN (SELECT item_id, string_agg(s, '|' ORDER BY i) AS s FROM (SELECT item_id, s, min(i) AS i FROM (
  SELECT item_id, substr(p, 1, 6) AS s, i * 100 + j AS i, p FROM (SELECT item_id, i, unnest(string_split(w, '-')) AS p, generate_subscripts(string_split(w, '-'), 1) AS j FROM (
    SELECT item_id, unnest(words[1:8]) AS w, generate_subscripts(words[1:8], 1) AS i FROM {_KEYWORDS}))) WHERE length(p) >= 3 GROUP BY item_id, s) GROUP BY item_id) USING (item_id)""")
def txt_stems(spark, d):
    return relation(spark, d, "benchmark").select("item_id", _joined(text.stems(F.col("text"))).alias("stems"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(CASE WHEN NOT regexp_matches(substr(text, 301, 1), '^\s') AND cut >= 150 THEN substr(text, 1, cut) ELSE substr(text, 1, 300) END, '\s+$', '') END AS text,
  length(text) > 300 AS truncated FROM (SELECT doc_id, text, length(regexp_extract(substr(text, 1, 300), '(?s)^(.*)[ \n\t]', 1)) AS cut FROM documents)""")
def txt_cap(spark, d):
    return relation(spark, d, "documents").select("doc_id", text.capped(F.col("text"), 300).alias("c")).select("doc_id", "c.text", "c.truncated")


@query(r"SELECT doc_id, sha256(text) AS sha256, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def txt_sha_collapse(spark, d):
    return relation(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length(text.collapsed(F.col("text"))).cast("long").alias("n"))


_ENTITIES = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&amp;": "&"}


@query(rf"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)</?(?:[\w.\-]+:)?(?:{"|".join(text.INLINE_TAGS)})(?:[\s/][^>]*|)>', '', 'g'),
  '(?s)</?(?:[A-Za-z_][\w.\-]*:)?[A-Za-z_][\w.\-]*[^>]*>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS text FROM pages""")
def txt_markup(spark, d):
    return relation(spark, d, "pages").select("page_id", text.basic_markup_text(F.col("html"), _ENTITIES).alias("text"))


@query()
def txt_markup_sections(spark, d):
    return relation(spark, d, "pages").select("page_id", text.markup_text(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 3) AS BIGINT) + 8 AS tokens FROM conversations")
def tok_estimate(spark, d):
    return relation(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.length("text"), F.lit(1)).cast("long").alias("tokens"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '([\\`*_\[\]|<>#])', '\\\1', 'g') AS text FROM documents")
def txt_markdown(spark, d):
    return relation(spark, d, "documents").select("doc_id", text.markdown_escaped(F.col("text")).alias("text"))


_FOUND = lambda kinds: " || ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k},' ELSE '' END" for k, p in kinds.items())
_SALTED = """SELECT doc_id, text || CASE doc_id % 8 WHEN 0 THEN ' doi:10.1234/x.1' WHEN 1 THEN ' PMID: 123' WHEN 2 THEN ' PMC12345' WHEN 3 THEN ' see https://example.org/a' WHEN 4 THEN ' arXiv:2101.00001v2'
  WHEN 5 THEN ' (Smith et al., 1999)' WHEN 6 THEN ' Journal of Tests; title: x' ELSE '' END AS t FROM documents"""


@query(f"SELECT doc_id, {_FOUND(text.IDENTIFIERS)} AS identifiers, {_FOUND(text.CITATION_LIKE | text.EXTRA_CITATION_LIKE)} AS citations FROM ({_SALTED})")
def red_detect(spark, d):
    s = relation(spark, d, _SALTED)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(","))), "")
    return s.select("doc_id", listed(text.identifier_kinds(F.col("t"))).alias("identifiers"), listed(text.citation_kinds(F.col("t"), True)).alias("citations"))


def _nested_replace(expr: str, put: str) -> str:
    for p in text.IDENTIFIERS.values():
        expr = f"regexp_replace({expr}, '{p.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return expr


@query(f"SELECT doc_id, {_nested_replace('t', '[redacted:identifier]')} AS text FROM ({_SALTED})")
def red_identifiers(spark, d):
    return relation(spark, d, _SALTED).select("doc_id", text.without_identifiers(F.col("t")).alias("text"))


@query(r"""SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&token=abc' ELSE '?api_key=abc&tool=x&secret=s&x-api-key=9' END,
  '(?i)([?&](?:api_key|apikey|key|token|access_token|password|secret|email|mailto|authorization|x-api-key|xai_api_key)=)[^&#]*', '\1[REDACTED]', 'g') AS url FROM pages""")
def red_params(spark, d):
    u = F.concat("url", F.when(F.col("url").contains("#"), F.lit("")).when(F.col("url").contains("?"), F.lit("&token=abc")).otherwise(F.lit("?api_key=abc&tool=x&secret=s&x-api-key=9")))
    return relation(spark, d, "pages").select("page_id", text.redacted_url(u).alias("url"))


# every document with a secret of one of six kinds behind it; what the rules say of the texts' own secrets SQL repeats for the two rules that it can express
_SECRETS = """SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN ' Bearer abcdefgh1' WHEN 1 THEN ' authorization: Basic dXNlcjpwYXNz' WHEN 2 THEN ' x-api-key = k-123' WHEN 3 THEN ' xai-0123456789abcdef_x' WHEN 4 THEN ' see bearer bonds, token=a&b' ELSE ' Authorization: zzz' END AS more FROM documents"""


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(""" + "|".join(text.SENSITIVE_IN_TEXT) + r""")=[^&\s"'']+', '\1=[REDACTED]', 'g'), '\bxai-[A-Za-z0-9_\-]{16,}', '[REDACTED]', 'g') || CASE doc_id % 6 WHEN 0 THEN ' Bearer [REDACTED]' WHEN 1 THEN ' authorization: Basic [REDACTED]' WHEN 2 THEN ' x-api-key = [REDACTED]'
  WHEN 3 THEN ' [REDACTED]' WHEN 4 THEN ' see bearer bonds, token=[REDACTED]&b' ELSE ' Authorization: [REDACTED]' END AS text FROM documents""")
def red_secrets(spark, d):
    return relation(spark, d, _SECRETS).select("doc_id", text.redacted_secrets(F.concat("text", "more")).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN record_id END AS value, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE sha256('x' || record_id) END AS sha256,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(21 AS BIGINT) END AS length FROM v_text""")
def red_safe_id(spark, d):
    t = relation(spark, d, "v_text")
    s = text.safe_id(F.when(F.col("doc_id") % 3 == 0, F.col("record_id")).otherwise(F.concat(F.lit("x"), "record_id")))
    return t.select("doc_id", s.alias("s")).select("doc_id", "s.value", "s.sha256", F.col("s.length").cast("long").alias("length"))


_NEEDLES = "SELECT text AS needle FROM benchmark UNION ALL SELECT substr(text, 1, CAST(item_id % 15 AS INT)) FROM benchmark"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, needle FROM documents JOIN (SELECT DISTINCT needle FROM ({_NEEDLES}) WHERE needle <> '') ON contains(text, needle)")
def red_leak_scan(spark, d):
    docs = relation(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return report.leaks(docs, relation(spark, d, _NEEDLES))


# ---- numbers, money, dates ---------------------------------------------------------------------


@query()
def num_scan(spark, d):
    docs = relation(spark, d, "documents")
    m = docs.select("doc_id", F.explode(numbers.number_mentions("text")).alias("m"))
    return m.select("doc_id", "m.value", "m.unit", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"))


_MENTION = "SELECT l_orderkey AS item, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS value, CASE l_linenumber % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'mL' ELSE NULL END AS unit FROM lineitem"
_REFERENCE = "SELECT l_orderkey AS item, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS value, CASE l_linenumber % 2 WHEN 0 THEN 'mg' ELSE NULL END AS unit FROM lineitem WHERE l_linenumber % 4 <> 1"


@query(f"""SELECT m.item, m.value, m.unit, CASE WHEN NOT EXISTS (SELECT 1 FROM ({_REFERENCE}) r WHERE r.item = m.item AND r.value = m.value) THEN 'number_not_found' ELSE 'unit_mismatch' END AS problem
  FROM ({_MENTION}) m WHERE NOT EXISTS (SELECT 1 FROM ({_REFERENCE}) r WHERE r.item = m.item AND r.value = m.value AND (m.unit IS NULL OR m.unit = r.unit))""")
def num_consistency(spark, d):
    return numbers.number_consistency(relation(spark, d, _MENTION), relation(spark, d, _REFERENCE), "item")


@query("""SELECT conv_id, turn, CAST(CASE WHEN ticks IS NOT NULL THEN ticks / 1e10 WHEN nano IS NOT NULL THEN nano / 1e9 END AS DOUBLE) AS cost,
  CASE WHEN ticks IS NOT NULL THEN 'reported_ticks' WHEN nano IS NOT NULL THEN 'reported_nano' END AS source FROM v_attempt""")
def cost_reported(spark, d):
    a = relation(spark, d, "v_attempt").withColumn("c", numbers.reported_cost(F.col("ticks"), F.col("nano")))
    return a.select("conv_id", "turn", F.col("c.cost").cast("double").alias("cost"), "c.source")


@query("""SELECT conv_id, turn, CASE WHEN output_tokens IS NULL THEN NULL ELSE greatest(output_tokens, coalesce(output_tokens + reasoning_tokens, 0), coalesce(total_tokens - input_tokens, 0)) END AS billable,
  CASE WHEN output_tokens IS NULL OR reasoning_tokens IS NULL THEN NULL WHEN reasoning_tokens > output_tokens THEN false
    WHEN total_tokens = input_tokens + output_tokens + reasoning_tokens AND reasoning_tokens > 0 THEN false WHEN total_tokens = input_tokens + output_tokens THEN true END AS included FROM v_attempt""")
def cost_billable(spark, d):
    a, c = relation(spark, d, "v_attempt"), F.col
    args = (c("output_tokens"), c("reasoning_tokens"), c("total_tokens"), c("input_tokens"))
    return a.select("conv_id", "turn", numbers.billable_output(*args).alias("billable"), numbers.reasoning_included(*args).alias("included"))


@query("SELECT conv_id, turn, CAST((CAST(input_tokens AS DECIMAL(18,0)) * 1.25 + CAST(output_tokens AS DECIMAL(18,0)) * 10.5) / 1000000 AS DOUBLE) AS cost FROM v_attempt")
def cost_price(spark, d):
    return relation(spark, d, "v_attempt").select("conv_id", "turn", numbers.price(F.col("input_tokens"), F.col("output_tokens"), "1.25", "10.5").cast("double").alias("cost"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), ' Mar 15') WHEN 1 THEN 'Spring' WHEN 2 THEN '19945' WHEN 3 THEN '1066 Oct' ELSE NULL END AS pubdate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(CAST(year(o_orderdate) AS STRING), '/01/01 00:00') END AS sortdate FROM orders"


@query(rf"""SELECT o_orderkey, coalesce(CASE WHEN y1 BETWEEN 1500 AND 2100 THEN y1 END, CASE WHEN y2 BETWEEN 1500 AND 2100 THEN y2 END) AS year FROM (
  SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(pubdate, '^\s*([0-9]{{4}})(?:[^0-9]|$)', 1), '') AS BIGINT) AS y1, TRY_CAST(nullif(regexp_extract(sortdate, '^\s*([0-9]{{4}})(?:[^0-9]|$)', 1), '') AS BIGINT) AS y2 FROM ({_DATES}))""")
def dt_year(spark, d):
    return relation(spark, d, _DATES).select("o_orderkey", dates.leading_year(F.col("pubdate"), F.col("sortdate")).cast("long").alias("year"))


_WAITS = "SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN concat(CAST(event_id % 60 AS STRING), '') WHEN 1 THEN '-3' WHEN 2 THEN 'soon' WHEN 3 THEN NULL ELSE ' 2.5 ' END AS header FROM events"


@query(f"SELECT event_id, CASE WHEN TRY_CAST(trim(header) AS DOUBLE) IS NOT NULL THEN CAST(least(greatest(TRY_CAST(trim(header) AS DOUBLE), 0), 30) AS DOUBLE) END AS wait FROM ({_WAITS})")
def dt_retry_after(spark, d):
    return relation(spark, d, _WAITS).select("event_id", dates.retry_after(F.col("header"), F.col("ts")).alias("wait"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def dt_stamps(spark, d):
    return relation(spark, d, "events").select("event_id", dates.iso_utc(F.col("ts")).alias("iso"), dates.run_stamp(F.col("ts")).alias("stamp"))


@query(f"SELECT event_id, CAST(CASE WHEN TRY_CAST(trim(header) AS DOUBLE) IS NOT NULL THEN least(greatest(TRY_CAST(trim(header) AS DOUBLE), 0), 30) ELSE power(2.0, event_id % 4) END AS DOUBLE) AS wait FROM ({_WAITS})")
def dt_backoff(spark, d):
    w = relation(spark, d, _WAITS)
    return w.select("event_id", dates.backoff(F.lit(1.0), F.col("event_id") % 4, dates.retry_after(F.col("header"), F.col("ts"))).alias("wait"))


# ---- retrieval ---------------------------------------------------------------------------------

_MERGED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, database ORDER BY rank, query) AS position FROM (
  SELECT *, first_value(query) OVER (PARTITION BY question_id, database, record_id ORDER BY rank, query) AS owner FROM v_hit) WHERE owner = query) WHERE position <= 40"""


def _merged(spark, d):
    return retrieval.interleaved(relation(spark, d, "v_hit"), 40, ["question_id", "database"])


@query(f"SELECT question_id, database, CAST(position AS BIGINT) AS position, CAST(query AS BIGINT) AS query, CAST(rank AS BIGINT) AS rank, record_id FROM ({_MERGED})")
def ord_interleave(spark, d):
    return _merged(spark, d).select("question_id", "database", *[F.col(c).cast("long").alias(c) for c in ("position", "query", "rank")], "record_id")


@query(f"""SELECT h.question_id, h.database, CAST(h.query AS BIGINT) AS query, h.n AS retrieved, coalesce(m.n, 0) AS contributed FROM
  (SELECT question_id, database, query, count(*) AS n FROM v_hit GROUP BY ALL) h LEFT JOIN (SELECT question_id, database, query, count(*) AS n FROM ({_MERGED}) GROUP BY ALL) m USING (question_id, database, query)""")
def ord_interleave_stats(spark, d):
    out = retrieval.contributed(relation(spark, d, "v_hit"), _merged(spark, d), ["question_id", "database"])
    return out.withColumn("query", F.col("query").cast("long"))


_STATUS = "SELECT question_id, database, query, CASE WHEN question_id % 5 = 0 THEN 'failed' WHEN (question_id + query) % 9 = 0 THEN 'failed' ELSE 'ok' END AS status FROM (SELECT DISTINCT question_id, database, query FROM v_hit) AS h"


@query(f"SELECT question_id, CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS status FROM ({_STATUS}) GROUP BY question_id")
def agg_query_status(spark, d):
    return retrieval.query_status(relation(spark, d, _STATUS), "question_id")


# merged records of every investigation: those of one number by fifty are one, and each investigation has one that no query found
_PROVENANCE = """SELECT DISTINCT concat('m', CAST(question_id AS STRING), '_', CAST(CAST(substr(record_id, 2) AS INT) % 50 AS STRING)) AS record_id, concat(CAST(question_id AS STRING), '/', record_id) AS source_record_id FROM v_hit
  UNION ALL SELECT DISTINCT concat('m', CAST(question_id AS STRING), '_none'), concat(CAST(question_id AS STRING), '/none') FROM v_hit"""


@query(f"""SELECT p.record_id, coalesce(string_agg(DISTINCT CAST(h.query AS VARCHAR) || ':' || h.database || ':' || CAST(h.rank AS VARCHAR), ',' ORDER BY CAST(h.query AS VARCHAR) || ':' || h.database || ':' || CAST(h.rank AS VARCHAR)), '') AS origins
  FROM ({_PROVENANCE}) p LEFT JOIN v_hit h ON h.question_id || '/' || h.record_id = p.source_record_id GROUP BY p.record_id""")
def jn_origins(spark, d):
    hits = relation(spark, d, "v_hit").withColumn("record_id", F.concat_ws("/", F.col("question_id").cast("string"), "record_id"))
    o = retrieval.origins(relation(spark, d, _PROVENANCE), hits)
    one = lambda x: F.concat_ws(":", x["query"].cast("string"), x["database"], x["rank"].cast("string"))
    return o.select("record_id", F.array_join(F.array_sort(F.transform("origins", one)), ",").alias("origins"))


@query(f"""SELECT identifier, CASE WHEN TRY_CAST(identifier AS BIGINT) % 13 = 0 THEN 'lookup_failed' WHEN TRY_CAST(identifier AS BIGINT) % 4 = 0 THEN 'resolved' ELSE 'not_found' END AS outcome
  FROM (SELECT DISTINCT pmid AS identifier FROM ({_IDS}) WHERE pmid IS NOT NULL)""")
def src_lookup_outcome(spark, d):
    ids = _records(spark, d).select(F.col("pmid").alias("identifier"))
    every = ids.filter("identifier IS NOT NULL").distinct()
    n = F.col("identifier").cast("long")
    return retrieval.lookups(ids, every.filter(n % 4 == 0), every.filter(n % 13 == 0))


@query("SELECT o_orderkey AS ordinal, CAST(floor(o_orderkey / 200) AS BIGINT) AS batch FROM orders")
def src_batches(spark, d):
    return retrieval.batched(relation(spark, d, "SELECT o_orderkey AS ordinal FROM orders"), "ordinal").withColumn("batch", F.col("batch").cast("long"))


_PAYLOAD = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('{"esearchresult":{"count":"', CAST(c_custkey AS STRING), '","idlist":["', CAST(c_custkey + 1 AS STRING), '","007","', CAST(c_custkey + 1 AS STRING), '"]}}')
  WHEN 1 THEN '{"esearchresult":{"ERROR":"bad term"}}' WHEN 2 THEN concat('{"esearchresult":{"count":"2","idlist":["x', CAST(c_custkey AS STRING), '"]}}') ELSE '{}' END AS payload FROM customer"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey + 1 = 7 THEN '7' ELSE CAST(c_custkey + 1 AS VARCHAR) || ',7' END END AS ids, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS total,
  CASE c_custkey % 4 WHEN 1 THEN 'reported error' WHEN 2 THEN 'not an id' WHEN 3 THEN 'no result object' END AS problem FROM customer""")
def src_parse_id_search(spark, d):
    p = relation(spark, d, _PAYLOAD).select("c_custkey", retrieval.parse_id_search(F.col("payload")).alias("r"))
    return p.select("c_custkey", F.array_join("r.ids", ",").alias("ids"), "r.total", "r.problem")


_SUMMARY = """SELECT p_partkey, concat('{"title":"', p_name, ' ","pubdate":"', CAST(1990 + p_partkey % 30 AS STRING), ' May","fulljournalname":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END,
  '","source":"J","authors":[{"name":"Team","authtype":"CollectiveName"},{"name":"Fam', CAST(p_partkey % 7 AS STRING), ' AB","authtype":"Author"}],"articleids":[{"idtype":"pii","value":"x"},{"idtype":"doi","value":"10.5/ABC', CAST(p_partkey AS STRING), '"}]}') AS doc FROM part"""


@query("""SELECT p_partkey, p_name AS title, 'Fam' || CAST(p_partkey % 7 AS VARCHAR) || ' AB' AS authors, CAST(1990 + p_partkey % 30 AS BIGINT) AS year, '10.5/abc' || CAST(p_partkey AS VARCHAR) AS doi,
  CASE WHEN p_partkey % 3 = 0 THEN 'J' ELSE p_brand END AS journal, 'https://pubmed.ncbi.nlm.nih.gov/' || CAST(p_partkey + 1 AS VARCHAR) || '/' AS source_url FROM part""")
def src_record_of_summary(spark, d):
    doc = F.from_json("doc", retrieval.SUMMARY)
    r = relation(spark, d, _SUMMARY).select("p_partkey", doc.alias("doc")).select("p_partkey", retrieval.record_of_summary((F.col("p_partkey") + 1).cast("string"), F.col("doc")).alias("r"))
    return r.select("p_partkey", "r.title", F.array_join("r.authors", "; ").alias("authors"), F.col("r.year").cast("long").alias("year"), "r.doi", "r.journal", "r.source_url")


_WORK = """SELECT p_partkey, concat('{"DOI":"10.5/W', CAST(p_partkey AS STRING), '","title":[""," ', p_name, '"],"container-title":["', p_brand, '"],"author":[{"name":"Group"},{"family":"Fam', CAST(p_partkey % 7 AS STRING), '","given":"G"},{"family":"Solo"}],',
  CASE p_partkey % 3 WHEN 0 THEN '"issued":{"date-parts":[[2001,5]]}' WHEN 1 THEN '"issued":{"date-parts":[[99]]},"published-print":{"date-parts":[[1999]]}' ELSE '"URL":"u"' END, '}') AS work FROM part"""


@query("""SELECT p_partkey, p_name AS title, 'Fam' || CAST(p_partkey % 7 AS VARCHAR) || ', G; Solo' AS authors, CAST(CASE p_partkey % 3 WHEN 0 THEN 2001 WHEN 1 THEN 1999 END AS BIGINT) AS year, '10.5/w' || CAST(p_partkey AS VARCHAR) AS doi,
  p_brand AS journal, 'https://doi.org/10.5/w' || CAST(p_partkey AS VARCHAR) AS source_url FROM part""")
def src_record_of_work(spark, d):
    r = relation(spark, d, _WORK).select("p_partkey", F.from_json("work", retrieval.WORK).alias("w")).select("p_partkey", retrieval.record_of_work(F.col("w")).alias("r"))
    return r.select("p_partkey", "r.title", F.array_join("r.authors", "; ").alias("authors"), F.col("r.year").cast("long").alias("year"), "r.doi", "r.journal", "r.source_url")


# ---- deduplication -----------------------------------------------------------------------------


def _for_dedup(spark, d, keep_doi_only: bool) -> DataFrame:
    r = _records(spark, d)
    if keep_doi_only:
        r = r.filter("doi IS NOT NULL")
    return r.select("ordinal", "record_id", "source_database", "title", "year", "doi", "pmid", "journal", F.array_compact(F.array("author")).alias("authors"), "title_key")


@query(f"SELECT min(ordinal) AS ordinal, doi, count(*) AS n FROM ({_IDS}) WHERE doi IS NOT NULL GROUP BY doi")
def dup_doi_only(spark, d):
    merged = dedup.deduplicated(_for_dedup(spark, d, True), identity.ascii_title(F.col("title")))
    return merged.select("ordinal", "doi", F.size("provenance").cast("long").alias("n"))


# investigations whose records share identifiers: twenty of them are one
_RUN = "CAST(floor(ordinal % 4001 / 20) AS BIGINT)"
_MATCH = """CASE WHEN x.doi IS NOT NULL AND r.doi IS NOT NULL THEN x.doi = r.doi WHEN x.pmid IS NOT NULL AND r.pmid IS NOT NULL THEN x.pmid = r.pmid
  ELSE coalesce(x.title_key = r.title_key AND x.year = r.year AND x.surname = r.surname, false) END"""
_MERGED_FIELDS = ("title", "year", "doi", "pmid", "journal", "author", "surname", "jkey")
_DIFFER = lambda a, key="": f"CAST(coalesce(x.{a} <> r.{a}{f' AND x.{key} IS DISTINCT FROM r.{key}' if key else ''}, false) AS INT)"
_STATE = "STRUCT(ordinal BIGINT, record_id VARCHAR, title VARCHAR, year BIGINT, doi VARCHAR, pmid VARCHAR, journal VARCHAR, author VARCHAR, surname VARCHAR, jkey VARCHAR, title_key VARCHAR, constituents BIGINT[], conflicts BIGINT)[]"


@query(f"""WITH RECURSIVE s AS (SELECT *, {_RUN} AS run, {_RECORD_ID} AS record_id, nullif(trim(regexp_replace(lower(journal), '[^a-z0-9]+', ' ', 'g')), '') AS jkey, row_number() OVER (PARTITION BY {_RUN} ORDER BY ordinal) AS n FROM ({_IDS})),
f AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST([] AS {_STATE}) AS m FROM s
  UNION ALL SELECT run, n, CASE WHEN hit IS NULL THEN list_append(m, {{'ordinal': r.ordinal, 'record_id': r.record_id, {', '.join(f"'{c}': r.{c}" for c in _MERGED_FIELDS)}, 'title_key': r.title_key, 'constituents': [r.ordinal], 'conflicts': 0}})
    ELSE list_transform(m, lambda x, i: CASE WHEN i = hit THEN {{'ordinal': x.ordinal, 'record_id': x.record_id, {', '.join(f"'{c}': coalesce(x.{c}, r.{c})" for c in _MERGED_FIELDS)}, 'title_key': CASE WHEN x.title IS NULL THEN r.title_key ELSE x.title_key END,
      'constituents': list_append(x.constituents, r.ordinal), 'conflicts': x.conflicts + {_DIFFER('title', 'title_key')} + {_DIFFER('year')} + {_DIFFER('doi')} + {_DIFFER('pmid')} + {_DIFFER('journal', 'jkey')} + {_DIFFER('surname')}}} ELSE x END) END
  FROM (SELECT f.run, r.n, f.m, r, nullif(list_position(list_transform(f.m, lambda x: {_MATCH}), true), 0) AS hit FROM f JOIN s AS r ON r.run = f.run AND r.n = f.n + 1))
SELECT u.ordinal, u.record_id, u.title, u.year, u.doi, u.pmid, u.journal, array_to_string(u.constituents, ',') AS constituents, u.conflicts AS n_conflicts FROM (SELECT unnest(arg_max(m, n)) AS u FROM f GROUP BY run)""")
def dup_full(spark, d):
    run = F.floor(F.col("ordinal") % 4001 / 20).cast("long").alias("run")
    merged = dedup.deduplicated(_for_dedup(spark, d, False).select("*", run), identity.ascii_title(F.col("title")), "run", None)
    return merged.select("ordinal", "record_id", "title", F.col("year").cast("long").alias("year"), "doi", "pmid", "journal", _joined(F.transform("provenance", lambda p: p["ordinal"]), ",").alias("constituents"), F.size("conflicts").cast("long").alias("n_conflicts"))


@query()
def dup_whole_table(spark, d):
    """All records at once: keys connect them across investigations."""
    merged = dedup.deduplicated(_for_dedup(spark, d, False), identity.ascii_title(F.col("title")))
    return merged.select("ordinal", "record_id", "title", "year", "doi", "pmid", "journal", _joined(F.transform("provenance", lambda p: p["ordinal"]), ",").alias("constituents"), F.size("conflicts").cast("long").alias("n_conflicts"))


@query(f"""SELECT min(ordinal) AS ordinal, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS merged FROM ({_IDS}) WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1""")
def dup_merge_log(spark, d):
    merged = dedup.deduplicated(_for_dedup(spark, d, True), identity.ascii_title(F.col("title"))).filter(F.size("provenance") > 1)
    return merged.select("ordinal", _joined(F.transform("provenance", lambda p: p["ordinal"]), ",").alias("merged"))


# ---- scoring and ranking -----------------------------------------------------------------------

CATALOG = (  # concepts that occur in the names of parts
    scoring.Concept("widget", ("widget",), True, (r"\bwidgets?\b",), (r"\bcolou?r\w*", r"\bsize\w*"), (r"\bwidget\w*|\bgizmo\w*",)),
    scoring.Concept("small", ("small", "tiny"), False, (), (r"\bsize\w*",), (r"\bsmall\b|\btiny\b",)),
    scoring.Concept("colour", ("red", "blue"), False, (), (r"\bcolou?r\w*",), (r"\bred\b|\bblue\b|\bgreen\b",)),
    scoring.Concept("metal", ("metal",), False, (), (r"\bsize\w*",), (r"\bsteel\b|\bbrass\b|\brod\b|\bplate\b",)),
)
QUESTION = "How does the size and colour of a widget change urgent plate orders?"
_STEMS = ("size", "colour", "widget", "urgent", "plate", "orders")


def _scored(spark, d):
    r = _records(spark, d).withColumn("abstract", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("A small red plate for "), F.col("author"))))
    one = lambda q: F.struct(q.cast("int").alias("query"), F.col("source_database").alias("database"), (F.col("ordinal") % 50 + 1).cast("int").alias("rank"))
    o = r.withColumn("origins", F.when(F.col("ordinal") % 9 == 0, F.array().cast("array<struct<query:int,database:string,rank:int>>")).otherwise(F.array(one(F.col("ordinal") % 7 + 1), one(F.col("ordinal") % 4 + 1))))
    o = o.withColumn("record_id", F.concat(F.lit("r"), F.lpad(F.col("ordinal").cast("string"), 12, "0")))
    return scoring.scored(o, QUESTION, CATALOG)


_HIT = lambda t, s: f"len(list_filter(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: starts_with(w, '{s}'))) > 0"
_N = lambda t: " + ".join(f"CAST({_HIT(t, s)} AS INT)" for s in _STEMS)
_SCORE = f"""SELECT *, CASE WHEN t_widget THEN 15 ELSE 0 END + 10 * (t_small::INT + t_colour::INT + t_metal::INT) + 3 * ({_N('t')}) AS title_score,
  CASE WHEN a IS NULL THEN 0 ELSE CASE WHEN NOT t_widget AND a_widget THEN 7 ELSE 0 END + 5 * ((a_small AND NOT t_small)::INT + (a_colour AND NOT t_colour)::INT + (a_metal AND NOT t_metal)::INT)
    + ({" + ".join(f"CAST({_HIT('a', s)} AND NOT ({_HIT('t', s)}) AS INT)" for s in _STEMS)}) END AS abstract_score,
  CASE WHEN ordinal % 9 = 0 THEN 0 ELSE CASE WHEN ordinal % 7 = 0 OR ordinal % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN ordinal % 7 = ordinal % 4 THEN 1 ELSE 2 END END AS origin_score
  FROM (SELECT ordinal, question_id, t, a, regexp_matches(t, '\\bwidget\\w*|\\bgizmo\\w*') AS t_widget, regexp_matches(t, '\\bsmall\\b|\\btiny\\b') AS t_small, regexp_matches(t, '\\bred\\b|\\bblue\\b|\\bgreen\\b') AS t_colour,
    regexp_matches(t, '\\bsteel\\b|\\bbrass\\b|\\brod\\b|\\bplate\\b') AS t_metal, coalesce(regexp_matches(a, '\\bwidget\\w*|\\bgizmo\\w*'), false) AS a_widget, coalesce(regexp_matches(a, '\\bsmall\\b|\\btiny\\b'), false) AS a_small,
    coalesce(regexp_matches(a, '\\bred\\b|\\bblue\\b|\\bgreen\\b'), false) AS a_colour, coalesce(regexp_matches(a, '\\bsteel\\b|\\bbrass\\b|\\brod\\b|\\bplate\\b'), false) AS a_metal
    FROM (SELECT ordinal, question_id, lower(title) AS t, CASE WHEN ordinal % 3 = 0 THEN lower('A small red plate for ' || author) END AS a FROM v_record))"""
_SCORED = f"SELECT ordinal, question_id, CAST(title_score AS BIGINT) AS title_score, CAST(abstract_score AS BIGINT) AS abstract_score, CAST(origin_score AS BIGINT) AS origin_score, CAST(title_score + abstract_score + origin_score AS BIGINT) AS base_score FROM ({_SCORE})"


@query(_SCORED)
def sco_score(spark, d):
    return _scored(spark, d).select("ordinal", "question_id", *[F.col(c).cast("long").alias(c) for c in ("title_score", "abstract_score", "origin_score", "base_score")])


@query(f"SELECT ordinal, base_score FROM (SELECT ordinal, base_score, CASE WHEN ordinal % 9 = 0 THEN 1000000 ELSE ordinal % 50 + 1 END AS br FROM ({_SCORED})) ORDER BY base_score DESC, br, ordinal LIMIT 50")
def ord_topk_enrich(spark, d):
    return scoring.chosen_for_enrichment(_scored(spark, d), 50).select("ordinal", F.col("base_score").cast("long").alias("base_score"))


_FACET = "list_filter(['widget', 'small', 'colour', 'metal'], lambda n, i: [t_widget OR a_widget, t_small OR a_small, t_colour OR a_colour, t_metal OR a_metal][i])"
_COMMON = lambda a, b: f"len(list_intersect({a}, {b})) / len(list_distinct({a} || {b}))"


@query(f"""WITH RECURSIVE c AS (SELECT question_id, 'r' || lpad(CAST(ordinal AS VARCHAR), 12, '0') AS record_id, {_FACET} AS facets, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS tokens, CAST(title_score + abstract_score + origin_score AS BIGINT) AS base,
  CASE WHEN ordinal % 9 = 0 THEN 1000000 ELSE ordinal % 50 + 1 END AS br FROM ({_SCORE})),
g AS (SELECT DISTINCT question_id, 0 AS rank, CAST(NULL AS STRUCT(record_id VARCHAR, facets VARCHAR[], tokens VARCHAR[], score BIGINT, fresh VARCHAR[], dup VARCHAR, same BIGINT)) AS pick,
    CAST([] AS STRUCT(record_id VARCHAR, facets VARCHAR[], tokens VARCHAR[], score BIGINT, fresh VARCHAR[], dup VARCHAR, same BIGINT)[]) AS done FROM c
  UNION ALL SELECT question_id, rank + 1, best, list_append(done, best) FROM (
    SELECT question_id, rank, any_value(done) AS done, list({{'record_id': record_id, 'facets': facets, 'tokens': tokens, 'score': score, 'fresh': fresh, 'dup': dup, 'same': same}} ORDER BY score DESC, base DESC, br, record_id)[1] AS best FROM (
      SELECT *, base + 12 * len(fresh) - 15 * same - CASE WHEN dup IS NOT NULL THEN 20 ELSE 0 END AS score FROM (
        SELECT g.question_id, g.rank, g.done, c.record_id, c.facets, c.tokens, c.base, c.br,
          list_sort(list_filter(c.facets, lambda f: NOT list_contains(flatten(list_transform(g.done, lambda x: x.facets)), f))) AS fresh,
          len(list_filter(g.done, lambda x: len(x.facets) = len(c.facets) AND len(list_intersect(x.facets, c.facets)) = len(c.facets))) AS same,
          list_filter(g.done, lambda x: len(c.tokens) > 0 AND len(x.tokens) > 0 AND {_COMMON('x.tokens', 'c.tokens')} >= 0.75)[1].record_id AS dup
        FROM g JOIN c USING (question_id) WHERE NOT list_contains(list_transform(g.done, lambda x: x.record_id), c.record_id)))
    GROUP BY question_id, rank))
SELECT question_id, rank, pick.record_id, CAST(pick.score AS INT) AS selection_score, array_to_string(pick.fresh, '|') AS new_concepts, pick.dup AS near_duplicate_of, CAST(pick.same AS INT) AS same_profile FROM g WHERE rank > 0""")
def rank_greedy(spark, d):
    out = scoring.ranked(_scored(spark, d), "question_id", text.word_tokens(F.col("title")))
    return out.select("question_id", "rank", "record_id", "selection_score", _joined(F.col("new_concepts")).alias("new_concepts"), "near_duplicate_of", "same_profile")


_QUESTIONS = "SELECT c_custkey AS question_id, concat(' Does ', CASE c_custkey % 3 WHEN 0 THEN 'shear activate platelets' WHEN 1 THEN 'lipid signaling matter in clotting' ELSE 'sleep restore memory' END, ' in group ', CAST(c_custkey AS STRING), '? ') AS question FROM customer"
_EXPANSION = {
    0: ("platelet_activation", [('"platelet activation"[tiab] AND ("shear stress"[tiab] OR "shear-induced"[tiab])', "platelet activation shear stress shear-induced"),
        ('"platelet activation"[tiab] AND "mechanotransduction"[tiab]', "platelet activation mechanotransduction")]),
    1: ("words", [('(matter[tiab] AND clotting[tiab] AND group[tiab]) AND ("membrane lipids"[tiab] OR "phospholipids"[tiab])', "matter clotting group membrane lipids phospholipids"),
        ('(matter[tiab] AND clotting[tiab] AND group[tiab]) AND "phosphatidylserine"[tiab]', "matter clotting group phosphatidylserine"),
        ('(matter[tiab] AND clotting[tiab] AND group[tiab]) AND "lipid signaling"[tiab]', "matter clotting group lipid signaling")]),
}
_ROWS = ", ".join(f"({k}, {i + 2}, '{t}', '{p}')" for k, (_, qs) in _EXPANSION.items() for i, (t, p) in enumerate(qs))


@query(f"""SELECT question_id, 'q1' AS query_id, 'original' AS kind, trim(question) AS tagged, trim(question) AS plain FROM ({_QUESTIONS}) UNION ALL
  SELECT question_id, 'q' || n, 'focused', tagged, plain FROM ({_QUESTIONS}) JOIN (VALUES {_ROWS}) AS v(k, n, tagged, plain) ON question_id % 3 = k""")
def sco_expand(spark, d):
    return scoring.expanded_queries(relation(spark, d, _QUESTIONS))


_RANKING = "SELECT question_id, concat('r', CAST(ordinal AS STRING)) AS record_id, row_number() OVER (PARTITION BY question_id ORDER BY (ordinal * 7919) % 10007, ordinal) AS rank, CASE ordinal % 4 WHEN 0 THEN 'peer-reviewed journal article' WHEN 1 THEN 'preprint' WHEN 2 THEN 'unknown' ELSE NULL END AS source_status, ordinal % 3 <> 0 AS relevant FROM v_record"


def _policy(policy: str, tier: str, excluded: str) -> None:
    def run(spark, d):
        out = scoring.policy_order(relation(spark, d, _RANKING), policy)
        return out.select("question_id", "record_id", F.col("tier").cast("long").alias("tier"), "excluded", F.col("policy_position").cast("long").alias("policy_position"))

    run.__name__ = f"ord_policy_{policy}"
    query(f"""SELECT question_id, record_id, CAST(tier AS BIGINT) AS tier, excluded, CASE WHEN NOT excluded THEN row_number() OVER (PARTITION BY question_id, excluded ORDER BY tier, rank) END AS policy_position
      FROM (SELECT *, {tier} AS tier, {excluded} AS excluded FROM (SELECT *, coalesce(source_status, 'unknown') = 'peer-reviewed journal article' AS j FROM ({_RANKING})))""")(run)


_policy("allow_all", "0", "false")
_policy("prefer_peer_reviewed", "CASE WHEN relevant AND j THEN 0 WHEN relevant THEN 1 WHEN j THEN 2 ELSE 3 END", "false")
_policy("peer_reviewed_only", "0", "NOT j")

_ORDERED = "SELECT question_id, record_id, rank AS position, CASE WHEN rank % 3 = 0 THEN 'verified' WHEN rank % 5 = 0 THEN NULL WHEN rank % 2 = 0 THEN 'partially_verified' ELSE 'not_verified' END AS status FROM (" + _RANKING + ") AS r"


@query(f"""SELECT question_id, record_id, (before < 5 AND position <= 15) AS checked, (before < 5 AND position <= 15 AND coalesce(status = 'verified', false)) AS selected FROM (
  SELECT *, coalesce(sum(CAST(coalesce(status = 'verified', false) AS INT)) OVER (PARTITION BY question_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_ORDERED}))""")
def ord_backfill_selected(spark, d):
    return scoring.backfilled(relation(spark, d, _ORDERED), 5).select("question_id", "record_id", "checked", "selected")


@query(f"""WITH RECURSIVE s AS (SELECT question_id, list(CAST(coalesce(status = 'verified', false) AS INT) ORDER BY position) AS ok FROM ({_ORDERED}) GROUP BY question_id),
r AS (SELECT question_id, ok, 0 AS round, 0 AS taken, 0 AS passed, 0 AS k FROM s
  UNION ALL SELECT question_id, ok, round + 1, taken + step, CAST(coalesce(list_sum(ok[1:taken + step]), 0) AS INT), step FROM (SELECT *, least(5 - passed, 15 - taken, len(ok) - taken) AS step FROM r) WHERE step > 0)
SELECT question_id, round, k AS checked_in_round, CAST(coalesce(list_sum(ok[taken - k + 1:taken]), 0) AS INT) AS passed_in_round FROM r WHERE round > 0""")
def ord_backfill_rounds(spark, d):
    return scoring.verification_rounds(relation(spark, d, _ORDERED), 5)


# ---- classification ----------------------------------------------------------------------------

_LABELS = """SELECT item, position, status, basis FROM (
  SELECT item, 1 AS position, CASE WHEN (type = 'posted-content' AND coalesce(subtype, '') = 'preprint') OR server IS NOT NULL THEN 'preprint' WHEN type = 'journal-article' THEN 'peer-reviewed journal article'
      WHEN type = 'proceedings-article' THEN 'conference paper' WHEN type = 'book-chapter' THEN 'book/chapter' ELSE 'unknown' END AS status,
    CASE WHEN type = 'posted-content' AND coalesce(subtype, '') = 'preprint' THEN 'crossref type posted-content, subtype preprint' WHEN server IS NOT NULL THEN 'known preprint server: ' || server
      WHEN type IN ('journal-article', 'proceedings-article', 'book-chapter') THEN 'crossref type ' || type ELSE 'crossref type ' || coalesce(type, 'missing') || CASE WHEN subtype IS NULL THEN '' ELSE ', subtype ' || subtype END END AS basis
  FROM (SELECT *, CASE WHEN container = 'bioRxiv' THEN 'bioRxiv/medRxiv (container/publisher/institution name)' WHEN doi = '10.48550/arXiv.2101.00001' THEN 'arXiv (DOI pattern)'
      WHEN container = 'Research Square' THEN 'Research Square (container/publisher/institution name)' END AS server FROM v_meta)
  UNION ALL
  SELECT item, 2, CASE WHEN pubtype = 'Preprint' OR server IS NOT NULL THEN 'preprint' WHEN pubtype = 'Congress' THEN 'conference paper' WHEN pubtype IN ('Journal Article', 'Review') THEN 'peer-reviewed journal article' ELSE 'unknown' END,
    CASE WHEN pubtype = 'Preprint' THEN 'pubmed publication type Preprint' WHEN server IS NOT NULL THEN 'known preprint server: ' || server WHEN pubtype = 'Congress' THEN 'pubmed publication type Congress'
      WHEN pubtype IN ('Journal Article', 'Review') THEN 'pubmed journal present and publication type(s) ' || lower(pubtype) ELSE 'pubmed publication types do not identify a journal article' END
  FROM (SELECT *, CASE WHEN container = 'bioRxiv' THEN 'bioRxiv/medRxiv (container/publisher/institution name)' WHEN doi = '10.48550/arXiv.2101.00001' THEN 'arXiv (DOI pattern)'
      WHEN container = 'Research Square' THEN 'Research Square (container/publisher/institution name)' END AS server FROM v_meta WHERE item % 3 = 0))"""


def _labels(spark, d):
    m, c = relation(spark, d, "v_meta"), F.col
    work = m.select("item", F.lit(1).alias("position"), sources_of.label_of_work(c("type"), c("subtype"), F.array("container"), c("doi")).alias("l"))
    summary = m.filter("item % 3 = 0").select("item", F.lit(2).alias("position"), sources_of.label_of_summary(F.array("pubtype"), F.array("container"), c("doi")).alias("l"))
    return work.union(summary).select("item", F.col("position").cast("long").alias("position"), "l.status", "l.basis")


@query(_LABELS)
def cls_metadata(spark, d):
    return _labels(spark, d)


_CLASSIFIED = f"""SELECT item, CASE WHEN bool_or(status = 'preprint') THEN 'preprint' WHEN count(DISTINCT status) FILTER (status <> 'unknown') = 1 THEN max(status) FILTER (status <> 'unknown') ELSE 'unknown' END AS source_status,
  string_agg(basis, '|' ORDER BY position) || CASE WHEN NOT bool_or(status = 'preprint') AND count(DISTINCT status) FILTER (status <> 'unknown') > 1 THEN '|conflicting type metadata between sources' ELSE '' END AS basis
  FROM (SELECT item, status, basis, min(position) AS position FROM ({_LABELS}) GROUP BY item, status, basis) GROUP BY item"""


@query(_CLASSIFIED)
def cls_record(spark, d):
    return sources_of.combined(_labels(spark, d), "item").select("item", "source_status", _joined(F.col("basis")).alias("basis"))


@query(f"SELECT source_status, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY source_status")
def cls_counts(spark, d):
    return sources_of.combined(_labels(spark, d), "item").groupBy("source_status").agg(F.count(F.lit(1)).alias("n"))


# ---- verification ------------------------------------------------------------------------------

_PAIR = f"""SELECT r.ordinal, k.kind, k.outcome, {_TITLE.replace('title', 'r.title')} AS t1, {_TITLE.replace('title', 'k.title')} AS t2, r.year AS y1, k.year AS y2,
  {_SURNAME.replace('author', 'r.author')} AS a1, {_SURNAME.replace('author', 'k.author')} AS a2, {_TITLE.replace('title', 'r.journal')} AS j1, {_TITLE.replace('title', 'k.journal')} AS j2
  FROM v_record r JOIN v_lookup k USING (ordinal)"""
_FIELDS = f"""SELECT ordinal, kind, outcome, CASE WHEN t1 IS NULL OR t2 IS NULL THEN 'not_compared' WHEN t1 = t2 THEN 'match' ELSE 'mismatch' END AS title_status,
  CASE WHEN y1 IS NULL OR y2 IS NULL THEN 'not_compared' WHEN y1 = y2 THEN 'match' ELSE 'mismatch' END AS year_status,
  CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'not_compared' WHEN a1 = a2 THEN 'match' ELSE 'mismatch' END AS author_status,
  CASE WHEN j1 IS NULL OR j2 IS NULL THEN 'not_compared' WHEN j1 = j2 OR contains(j1, j2) OR contains(j2, j1) THEN 'match' ELSE 'mismatch' END AS journal_status FROM ({_PAIR})"""


def _compared(spark, d, fuzzy: bool):
    c = F.col
    r = relation(spark, d, "v_record").select("ordinal", identity.ascii_title(c("title")).alias("t1"), c("year").alias("y1"), identity.ascii_surname(c("author")).alias("a1"), identity.ascii_title(c("journal")).alias("j1"))
    k = relation(spark, d, "v_lookup").select("ordinal", "kind", "outcome", identity.ascii_title(c("title")).alias("t2"), c("year").alias("y2"), identity.ascii_surname(c("author")).alias("a2"), identity.ascii_title(c("journal")).alias("j2"))
    j = r.join(k, "ordinal")
    none = F.lit(0.0)
    t, g = (verification.similarity_ratio("t1", "t2"), verification.similarity_ratio("j1", "j2")) if fuzzy else (none, none)
    return j.select("ordinal", "kind", "outcome", verification.title_status(c("t1"), c("t2"), t).alias("title_status"), verification.three_way(c("y1"), c("y2"), c("y1") == c("y2")).alias("year_status"),
                    verification.three_way(c("a1"), c("a2"), c("a1") == c("a2")).alias("author_status"), verification.journal_status(c("j1"), c("j2"), g).alias("journal_status"))


@query(_FIELDS)
def ver_fields_exact(spark, d):
    return _compared(spark, d, False)


@query()
def ver_fields_fuzzy(spark, d):
    return _compared(spark, d, True)


_CHECKS = f"""SELECT ordinal, kind, outcome, CASE WHEN outcome <> 'resolved' THEN 'not_verified' WHEN reasons = '' THEN 'verified' ELSE 'partially_verified' END AS status, CASE WHEN outcome <> 'resolved' THEN outcome ELSE reasons END AS reasons FROM (
  SELECT *, concat_ws('|', CASE title_status WHEN 'mismatch' THEN 'title_mismatch' WHEN 'not_compared' THEN 'title_not_compared' END, CASE WHEN year_status = 'mismatch' THEN 'year_mismatch' END,
    CASE WHEN author_status = 'mismatch' THEN 'first_author_mismatch' END) AS reasons FROM ({_FIELDS}))"""


def _checks(spark, d):
    c = F.col
    return _compared(spark, d, False).select("ordinal", "kind", verification.check_status(c("outcome"), c("title_status"), c("year_status"), c("author_status")).alias("k")).select("ordinal", "kind", "k.*")


@query(_CHECKS)
def ver_check(spark, d):
    return _checks(spark, d).withColumn("reasons", _joined(F.col("reasons")))


_COMBINED = f"""SELECT o.ordinal, CASE WHEN n IS NULL OR resolved = 0 THEN 'not_verified' WHEN all_ok AND missing = 0 THEN 'verified' ELSE 'partially_verified' END AS status FROM v_record o LEFT JOIN (
  SELECT ordinal, count(*) AS n, count(*) FILTER (outcome = 'resolved') AS resolved, bool_and(status = 'verified') FILTER (outcome = 'resolved') AS all_ok, count(*) FILTER (outcome = 'not_found') AS missing FROM ({_CHECKS}) GROUP BY ordinal) c USING (ordinal)"""


def _combined(spark, d):
    return verification.combined_checks(relation(spark, d, "v_record").select("ordinal").join(_checks(spark, d), "ordinal", "left"), "ordinal")


@query(_COMBINED)
def ver_combine(spark, d):
    return _combined(spark, d).select("ordinal", "status")


@query(f"SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('verified'), ('partially_verified'), ('not_verified')) AS s(status) LEFT JOIN (SELECT status, count(*) AS n FROM ({_COMBINED}) GROUP BY status) USING (status)")
def ver_counts(spark, d):
    return verification.status_counts(_combined(spark, d), "status")


# ---- texts -------------------------------------------------------------------------------------

_CONSIDERED = "SELECT doc_id, pmid, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 5 = 0 THEN '  ' ELSE NULL END AS pubmed_abstract, doc_id % 13 = 0 AS pubmed_failed, CASE WHEN doc_id % 4 = 1 THEN reverse(text) ELSE NULL END AS inline_abstract FROM v_text"
_ENRICHED = f"""SELECT doc_id, CASE origin WHEN 'pubmed_efetch' THEN pubmed_abstract WHEN 'crossref_search_result' THEN inline_abstract END AS abstract, origin AS abstract_origin,
  CASE WHEN origin IS NOT NULL THEN NULL WHEN pmid IS NOT NULL AND pubmed_failed THEN 'pubmed efetch failed; no Crossref abstract in search result' WHEN pmid IS NOT NULL THEN 'no abstract in PubMed efetch or Crossref search result'
    ELSE 'no abstract in Crossref search result (no PMID)' END AS title_only_reason
  FROM (SELECT *, CASE WHEN pmid IS NOT NULL AND trim(pubmed_abstract) <> '' AND NOT pubmed_failed THEN 'pubmed_efetch' WHEN inline_abstract <> '' THEN 'crossref_search_result' END AS origin FROM ({_CONSIDERED}))"""


@query(_ENRICHED)
def enr_abstracts(spark, d):
    return texts.enriched(relation(spark, d, _CONSIDERED)).select("doc_id", "abstract", "abstract_origin", "title_only_reason")


@query(f"SELECT coalesce(abstract_origin, 'none') AS origin, count(*) AS n FROM ({_ENRICHED}) GROUP BY 1")
def enr_counts(spark, d):
    return texts.enriched(relation(spark, d, _CONSIDERED)).groupBy(F.coalesce("abstract_origin", F.lit("none")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


_ELIGIBLE = """SELECT doc_id, CASE WHEN reason IS NULL THEN 'verified' ELSE 'not_eligible' END AS label, reason FROM (SELECT doc_id, CASE WHEN doi IS NULL AND pmid IS NULL THEN 'record has no PMID or DOI to fetch an abstract with'
  WHEN verification = 'verified' THEN NULL WHEN verification = 'partially_verified' THEN 'partially_verified records are excluded unless explicitly opted in' ELSE 'verification status is ' || verification END AS reason FROM v_text)"""


def _eligible(spark, d):
    c = F.col
    t = relation(spark, d, "v_text")
    return t.withColumn("e", texts.eligibility(c("record_id"), c("doi"), c("pmid"), c("verification")))


@query(_ELIGIBLE)
def src_eligibility(spark, d):
    return _eligible(spark, d).select("doc_id", "e.label", "e.reason")


_ADMITTED = f"""SELECT doc_id, question_id, CASE WHEN before < 4 THEN fetched_status ELSE 'source_limit' END AS status FROM (
  SELECT *, coalesce(sum(CAST(fetched_status = 'ok' AS INT)) OVER (PARTITION BY question_id ORDER BY CASE WHEN pmid IS NULL THEN 1 ELSE 0 END, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM v_text JOIN ({_ELIGIBLE}) USING (doc_id) WHERE reason IS NULL)"""


def _admitted(spark, d):
    e = _eligible(spark, d).filter("e.reason IS NULL").select("doc_id", "question_id", "pmid", "fetched_status", F.col("doc_id").alias("ordinal"), F.col("e.label").alias("eligibility"), "text", "record_id")
    return texts.admitted(e, 4)


@query(_ADMITTED)
def ord_admission(spark, d):
    return _admitted(spark, d).select("doc_id", "question_id", "status")


@query(f"SELECT status, count(*) AS n FROM ({_ADMITTED}) GROUP BY status")
def src_counts(spark, d):
    return _admitted(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT record_id, 'abstract' AS access_level, text AS source_text FROM v_text JOIN ({_ADMITTED}) USING (doc_id) WHERE status = 'ok' AND text <> ''")
def prj_model_source(spark, d):
    return texts.model_sources(_admitted(spark, d).withColumn("access_level", F.lit("abstract")))


# ---- evidence ----------------------------------------------------------------------------------

_REASONS = """SELECT doc_id, item_index, concat_ws('|', CASE WHEN item_index >= 5 THEN 'exceeds_item_limit' END, CASE WHEN cited_id <> record_id THEN 'unknown_record_id' END,
  CASE WHEN trim(regexp_replace(quote, '\\s+', ' ', 'g')) = '' THEN 'missing_quote' WHEN length(quote) < 20 THEN 'quote_too_short' WHEN cited_id = record_id AND NOT contains(source_text, quote) THEN 'quote_not_in_source' END,
  CASE WHEN category NOT IN ('established', 'conflicting', 'inference', 'hypothesis') THEN 'unsupported_evidence_category' END,
  CASE WHEN confidence IS NULL OR confidence NOT IN ('low', 'moderate', 'high') THEN 'unsupported_confidence' END, CASE WHEN trim(claim) = '' THEN 'empty_claim' END) AS reasons, record_id, confidence FROM v_item"""


def _items(spark, d):
    c = F.col
    i = relation(spark, d, "v_item")
    supplied = c("cited_id") == c("record_id")
    return i.withColumn("reasons", evidence.item_reasons(c("item_index"), c("cited_id"), supplied, F.when(supplied, c("source_text")), c("quote"), c("category"), c("confidence"), c("claim")))


@query(f"SELECT doc_id, CAST(item_index AS BIGINT) AS item_index, reasons FROM ({_REASONS})")
def val_evidence(spark, d):
    return _items(spark, d).select("doc_id", F.col("item_index").cast("long").alias("item_index"), _joined(F.col("reasons")).alias("reasons"))


@query()
def val_evidence_numbers(spark, d):
    c = F.col
    i = relation(spark, d, "v_item").withColumn("mc", numbers.number_mentions("claim")).withColumn("mq", numbers.number_mentions("quote"))
    none = F.array().cast(numbers.MENTIONS)
    supplied = c("cited_id") == c("record_id")
    reasons = evidence.item_reasons(c("item_index"), c("cited_id"), supplied, F.when(supplied, c("source_text")), c("quote"), c("category"), c("confidence"), c("claim"),
                                    {"claim": c("mc"), "finding": none, "methods": none, "quote": c("mq"), "text": none})
    return i.select("doc_id", F.col("item_index").cast("long").alias("item_index"), _joined(reasons).alias("reasons"))


@query(f"SELECT code, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS code FROM ({_REASONS}) WHERE reasons <> '') GROUP BY code")
def val_reason_counts(spark, d):
    return evidence.reason_counts(_items(spark, d))


@query(f"""SELECT family, count(*) AS checked, count(*) - count(*) FILTER (hit) AS passed, count(*) FILTER (hit) AS failed FROM (SELECT family, regexp_matches(reasons, p) AS hit FROM ({_REASONS}) CROSS JOIN (VALUES ('exact_quote', 'quote'),
  ('numeric_consistency', 'number_not|unit_mismatch'), ('citation_validation', 'unknown_record_id')) AS f(family, p)) GROUP BY family""")
def val_claim_checks(spark, d):
    return evidence.claim_checks(_items(spark, d))


_LABEL = "CASE doc_id % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' WHEN 2 THEN 'odd' WHEN 3 THEN 'not_supported' ELSE NULL END"


@query(f"""SELECT doc_id, CAST(item_index AS BIGINT) AS item_index, CASE WHEN reasons <> '' THEN 'rejected' WHEN l IS NULL OR l = 'supported' THEN 'accepted' ELSE 'downgraded' END AS final_status,
  CASE WHEN reasons <> '' THEN 'rejected_deterministic' WHEN l IS NULL THEN 'passed_deterministic' WHEN l = 'odd' THEN 'unverifiable' ELSE l END AS final_label FROM (SELECT *, {_LABEL} AS l FROM ({_REASONS}))""")
def val_support(spark, d):
    s = evidence.support(F.size("reasons") == 0, F.expr(_LABEL))
    return _items(spark, d).select("doc_id", F.col("item_index").cast("long").alias("item_index"), s.alias("s")).select("doc_id", "item_index", "s.final_status", "s.final_label")


@query(f"""SELECT doc_id, CAST(item_index AS BIGINT) AS item_index, 'ev_' || lpad(CAST(row_number() OVER (PARTITION BY floor(doc_id / 20) ORDER BY doc_id, item_index) AS VARCHAR), 4, '0') AS item_id FROM ({_REASONS}) WHERE reasons = ''""")
def ord_dense_ids(spark, d):
    ok = _items(spark, d).filter(F.size("reasons") == 0).withColumn("question_id", F.floor(F.col("doc_id") / 20))
    return evidence.numbered(ok, ["doc_id", "item_index"], "ev_", 4, ["question_id"]).select("doc_id", F.col("item_index").cast("long").alias("item_index"), "item_id")


# ---- synthesis ---------------------------------------------------------------------------------

_KNOWN = "[concat('ev_', lpad(CAST(x AS VARCHAR), 4, '0')) FOR x IN range(0, 100)]"


def _known(n: int, prefix: str, width: int):
    return F.array(*[F.lit(f"{prefix}{i:0{width}d}") for i in range(n)])


@query(f"""SELECT gap_id, concat_ws('|', (SELECT string_agg('unknown_evidence_id', '|') FROM (SELECT unnest(supporting) AS e) WHERE NOT list_contains({_KNOWN}, e)), (SELECT string_agg('unknown_evidence_id', '|') FROM (SELECT unnest(conflicting) AS e)
  WHERE NOT list_contains({_KNOWN}, e)), CASE WHEN contains(why_unresolved, 'et al') THEN 'bibliographic_text' END, CASE WHEN confidence = 'sure' THEN 'invalid_confidence' END) AS reasons FROM v_gap""")
def val_gap(spark, d):
    c = F.col
    g = relation(spark, d, "v_gap")
    r = synthesis.gap_reasons(c("supporting"), c("conflicting"), c("gap_statement"), c("why_unresolved"), c("confidence"), _known(100, "ev_", 4), F.array().cast("array<string>"))
    return g.select("gap_id", _joined(r).alias("reasons"))


_PARAGRAPH = """SELECT q, CASE q % 4 WHEN 0 THEN 'key_findings' WHEN 1 THEN 'limitations' WHEN 2 THEN 'intro' ELSE 'conflicting_evidence' END AS section, CASE q % 5 WHEN 0 THEN 'claim' ELSE 'inference' END AS label,
  CASE q % 3 WHEN 0 THEN concat('As ev_', lpad(CAST(q AS STRING), 4, '0'), ' shows') WHEN 1 THEN 'No id here' ELSE ' ' END AS text, CASE WHEN q % 7 = 0 THEN ARR('ev_9999') ELSE ARR(concat('ev_', lpad(CAST(q + 50 AS STRING), 4, '0'))) END AS evidence_ids FROM v_gap"""


@query(f"""SELECT q, concat_ws('|', CASE WHEN section = 'intro' THEN 'invalid_section' END, CASE WHEN label = 'claim' THEN 'invalid_label' END, CASE WHEN NOT list_contains({_KNOWN}, evidence_ids[1]) THEN 'unknown_evidence_id' END,
  CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN section IN ('key_findings', 'conflicting_evidence') AND NOT list_contains({_KNOWN}, evidence_ids[1]) AND NOT starts_with(text, 'As ev_') THEN 'missing_evidence_reference' END) AS reasons
  FROM ({_PARAGRAPH})""")
def val_paragraph(spark, d):
    c = F.col
    r = synthesis.paragraph_reasons(c("section"), c("label"), c("text"), c("evidence_ids"), F.array().cast("array<string>"), _known(100, "ev_", 4), F.array().cast("array<string>"))
    return relation(spark, d, _PARAGRAPH).select("q", _joined(r).alias("reasons"))


_LEVEL = """CASE WHEN category = 'inference' THEN 'observation' WHEN category = 'conflicting' THEN CASE WHEN doc_id % 6 IN (0, 2, 5) THEN 'association' ELSE 'observation' END
  WHEN doc_id % 6 IN (0, 4) THEN 'causal_claim' WHEN doc_id % 6 IN (1, 5) THEN 'mechanistic_support' WHEN doc_id % 6 = 2 THEN 'association' ELSE 'observation' END"""


@query(f"SELECT evidence_id, {_LEVEL} AS level FROM v_evidence")
def hyp_claim_level(spark, d):
    return relation(spark, d, "v_evidence").select("evidence_id", synthesis.claim_level(F.col("category"), F.col("quote")).alias("level"))


_CITED = f"SELECT hypothesis_id, e.*, {_LEVEL} AS level FROM (SELECT hypothesis_id, unnest(list_distinct(evidence_ids)) AS evidence_id FROM v_hyp) JOIN v_evidence e USING (evidence_id)"


def _cited(spark, d):
    e = relation(spark, d, "v_evidence").withColumn("level", synthesis.claim_level(F.col("category"), F.col("quote"))).withColumn("source_record_id", F.col("source_no").cast("string"))
    h = relation(spark, d, "v_hyp").select("hypothesis_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return h.join(e, "evidence_id").withColumn("abstract_only", F.col("doc_id") % 2 == 0)


@query(f"""SELECT hypothesis_id, CASE WHEN best = 3 AND (causal < 2 OR conflict) THEN 'mechanistic_support' ELSE ['observation', 'association', 'mechanistic_support', 'causal_claim'][best + 1] END AS supported_level FROM (
  SELECT hypothesis_id, max(CASE level WHEN 'observation' THEN 0 WHEN 'association' THEN 1 WHEN 'mechanistic_support' THEN 2 ELSE 3 END) AS best,
    count(DISTINCT CASE WHEN level = 'causal_claim' AND source_type = 'peer-reviewed journal article' THEN source_no END) AS causal, bool_or(category = 'conflicting') AS conflict FROM ({_CITED}) GROUP BY hypothesis_id)""")
def hyp_supported_level(spark, d):
    return synthesis.supported_levels(_cited(spark, d))


_CEILING = f"""SELECT hypothesis_id, ['low', 'moderate', 'high'][CASE WHEN lowered THEN greatest(cap - 1, 0) ELSE cap END + 1] AS ceiling FROM (SELECT h.hypothesis_id, coalesce(pre > 0 AND pre < n, false) AS lowered, least(2,
    CASE WHEN coalesce(abstracts, false) THEN 1 ELSE 2 END, CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE 2 END, CASE WHEN n > 0 AND NOT journal THEN 1 ELSE 2 END, CASE WHEN pre > 0 AND pre = n THEN 0 ELSE 2 END,
    CASE WHEN coalesce(conflict, false) OR h.q % 3 = 0 THEN 0 ELSE 2 END, CASE WHEN n > 0 AND NOT established THEN 0 ELSE 2 END, CASE WHEN h.level = 'causal_claim' THEN 1 ELSE 2 END) AS cap
  FROM v_hyp h LEFT JOIN (SELECT hypothesis_id, bool_or(doc_id % 2 = 0) AS abstracts, count(DISTINCT source_no) AS n, bool_or(source_type = 'peer-reviewed journal article') AS journal,
    count(DISTINCT CASE WHEN source_type = 'preprint' THEN source_no END) AS pre, bool_or(category = 'conflicting') AS conflict, bool_or(category = 'established') AS established FROM ({_CITED}) GROUP BY hypothesis_id) USING (hypothesis_id))"""


def _ceilings(spark, d):
    claims = relation(spark, d, "v_hyp").select("hypothesis_id", "level", (F.col("q") % 3 == 0).alias("gap_conflicts"))
    return synthesis.confidence_ceilings(_cited(spark, d), claims)


@query(_CEILING)
def hyp_ceiling(spark, d):
    return _ceilings(spark, d).select("hypothesis_id", "ceiling")


@query(f"""SELECT hypothesis_id, CASE WHEN list_position(['low', 'moderate', 'high'], confidence) <= list_position(['low', 'moderate', 'high'], ceiling) THEN confidence ELSE ceiling END AS final FROM v_hyp JOIN ({_CEILING}) USING (hypothesis_id)""")
def hyp_final_conf(spark, d):
    h = relation(spark, d, "v_hyp").select("hypothesis_id", "confidence").join(_ceilings(spark, d), "hypothesis_id")
    return h.select("hypothesis_id", synthesis.final_confidence(F.col("confidence"), F.col("ceiling")).alias("final"))


_PLAIN = ", ".join(f"'{w.replace(chr(39), chr(39) * 2)}'" for w in text.PLAIN_WORDS)
_WORDS = lambda c: f"list_distinct([CASE WHEN length(w) > 3 AND suffix(w, 's') THEN w[:-2] ELSE w END FOR w IN regexp_extract_all(lower({c}), '[a-z0-9]+') IF length(w) >= 3 AND w NOT IN ({_PLAIN})])"


@query(f"""SELECT hypothesis_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)) END AS similarity
  FROM (SELECT hypothesis_id, {_WORDS('hypothesis')} AS a, {_WORDS('prediction')} AS b FROM v_hyp)""")
def hyp_jaccard(spark, d):
    return relation(spark, d, "v_hyp").select("hypothesis_id", text.word_jaccard(F.col("hypothesis"), F.col("prediction")).alias("similarity"))


@query("""SELECT hypothesis_id, concat_ws('|', CASE WHEN len(list_filter(alternative_ids, lambda e: NOT list_contains(evidence_ids, e))) > 0 THEN 'revision_added_evidence' END,
  CASE WHEN len(list_filter(evidence_ids, lambda e: NOT list_contains(alternative_ids, e) AND e <> evidence_ids[2])) > 0 THEN 'revision_dropped_supported_evidence' END) AS reasons FROM v_hyp""")
def hyp_links(spark, d):
    r = synthesis.revision_reasons(F.col("alternative_ids"), F.col("evidence_ids"), F.slice("evidence_ids", 2, 1))
    return relation(spark, d, "v_hyp").select("hypothesis_id", _joined(r).alias("reasons"))


_DECIDE = "SELECT q, q % 5 = 0 AS hard, q % 3 = 0 AS soft, q % 4 = 0 AS problems, CASE q % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'missing' WHEN 2 THEN 'failed' ELSE 'completed' END AS revision, q % 2 = 0 AS bad FROM v_gap"


@query(f"""SELECT q, CASE WHEN hard THEN 'rejected_at_generation' WHEN NOT soft AND NOT problems THEN 'accepted' WHEN revision = 'failed' THEN 'rejected_unresolved' WHEN revision = 'missing' OR bad THEN 'rejected_at_revision'
  ELSE 'accepted_revised' END AS decision FROM ({_DECIDE})""")
def hyp_decision(spark, d):
    codes = lambda c: F.when(F.col(c), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return relation(spark, d, _DECIDE).select("q", synthesis.decision(codes("hard"), codes("soft"), F.col("problems"), F.col("revision"), codes("bad")).alias("decision"))


@query()
def hyp_flags(spark, d):
    c = F.col
    h = relation(spark, d, "v_hyp").join(synthesis.supported_levels(_cited(spark, d)), "hypothesis_id", "left")
    plain = F.lit("Stated for testing")
    cols = {"hypothesis": c("hypothesis"), "rationale": plain, "prediction": c("prediction"), "alternative": F.lit("Another cause"), "basis": F.lit("evidence"), "weakening": F.lit("No difference"), "supporting": F.lit("A clear rise"),
            "compared": F.lit("Two groups"), "measured": F.lit("Counts after 5 mL"), "level": c("level"), "confidence": c("confidence"), "gap_id": c("gap_id"), "evidence_ids": c("evidence_ids"), "alternative_ids": c("alternative_ids"),
            "limitations": F.array(F.lit("few items")), "evidence": _known(200, "ev_", 4), "gaps": _known(60, "gap_", 2), "sources": F.array().cast("array<string>"), "supported_level": F.coalesce("supported_level", F.lit("observation"))}
    hard, soft = synthesis.hypothesis_flags(cols)
    return h.select("hypothesis_id", _joined(hard).alias("hard"), _joined(soft).alias("soft"))


# ---- graph -------------------------------------------------------------------------------------

_EV_OK = r"""SELECT e.* FROM v_evidence e JOIN (SELECT DISTINCT record_id FROM v_text WHERE fetched_status = 'ok') USING (record_id) WHERE NOT regexp_matches(claim, '\((?:1[89]|20)\d{2}[a-z]?\)')"""
_GAP_LACKS = f"SELECT gap_id FROM (SELECT gap_id, unnest(supporting || conflicting) AS e FROM v_gap) WHERE e NOT IN (SELECT evidence_id FROM ({_EV_OK}))"
_HYP_LACKS = f"SELECT hypothesis_id FROM (SELECT hypothesis_id, unnest(evidence_ids || alternative_ids) AS e FROM v_hyp) WHERE e NOT IN (SELECT evidence_id FROM ({_EV_OK}))"
_GAP_OK = f"SELECT g.* FROM v_gap g WHERE gap_id NOT IN ({_GAP_LACKS}) AND why_unresolved NOT LIKE '%et al%'"
_HYP_OK = f"SELECT h.* FROM v_hyp h WHERE hypothesis_id NOT IN ({_HYP_LACKS}) AND gap_id IN (SELECT gap_id FROM ({_GAP_OK})) AND trim(prediction) <> ''"
_NODES = f"""SELECT 'src:' || record_id AS node_id, 'source' AS type, record_id AS item_id FROM (SELECT DISTINCT record_id FROM ({_EV_OK})) UNION ALL SELECT 'ev:' || evidence_id, 'evidence', evidence_id FROM ({_EV_OK})
  UNION ALL SELECT 'gap:' || gap_id, 'gap', gap_id FROM ({_GAP_OK}) UNION ALL SELECT p || hypothesis_id, t, hypothesis_id FROM ({_HYP_OK}), (VALUES ('hyp:', 'hypothesis'), ('pred:', 'prediction'), ('fals:', 'falsification_test')) AS x(p, t)"""
_EDGES = f"""SELECT type || '|' || source || '|' || target AS edge_id, type, source, target, coalesce(string_agg(DISTINCT g, ',' ORDER BY g), '') AS recorded_by FROM (
  SELECT 'supports' AS type, 'src:' || record_id AS source, 'ev:' || evidence_id AS target, NULL AS g FROM ({_EV_OK})
  UNION ALL SELECT 'motivates', 'ev:' || e, 'gap:' || gap_id, NULL FROM (SELECT gap_id, unnest(supporting || conflicting) AS e FROM ({_GAP_OK}))
  UNION ALL SELECT 'contradicts', 'ev:' || least(s, c), 'ev:' || greatest(s, c), gap_id FROM (SELECT gap_id, s, unnest(conflicting) AS c FROM (SELECT gap_id, conflicting, unnest(supporting) AS s FROM ({_GAP_OK}))) WHERE s <> c
  UNION ALL SELECT 'supports', 'ev:' || e, 'hyp:' || hypothesis_id, NULL FROM (SELECT hypothesis_id, unnest(evidence_ids) AS e FROM ({_HYP_OK}))
  UNION ALL SELECT 'addresses', 'hyp:' || hypothesis_id, 'gap:' || gap_id, NULL FROM ({_HYP_OK})
  UNION ALL SELECT 'tests', p || hypothesis_id, 'hyp:' || hypothesis_id, NULL FROM ({_HYP_OK}), (VALUES ('pred:'), ('fals:')) AS x(p)) GROUP BY type, source, target"""


def _graph(spark, d):
    ev = relation(spark, d, "v_evidence").select("evidence_id", "record_id", "claim", "finding", "quote")
    eligible = relation(spark, d, "v_text").filter("fetched_status = 'ok'").select("record_id")
    tests = F.array(*[F.lit(x) for x in ("groups", "counts", "no difference", "a rise")])
    hyps = relation(spark, d, "v_hyp").withColumn("tests", tests)
    gaps = relation(spark, d, "v_gap")
    return (*graph.build(ev, gaps, hyps, eligible), ev, gaps, hyps, eligible)


@query(_NODES)
def grf_nodes(spark, d):
    return _graph(spark, d)[0]


@query(_EDGES)
def grf_edges(spark, d):
    return _graph(spark, d)[1].withColumn("recorded_by", F.array_join("recorded_by", ","))


@query(f"""SELECT 'ev:' || evidence_id AS item, CASE WHEN record_id NOT IN (SELECT record_id FROM v_text WHERE fetched_status = 'ok') THEN 'source_not_verified_record' ELSE 'bibliographic_text_in_model_text' END AS reason FROM v_evidence
  WHERE evidence_id NOT IN (SELECT evidence_id FROM ({_EV_OK})) UNION ALL SELECT 'gap:' || gap_id, CASE WHEN gap_id IN ({_GAP_LACKS}) THEN
  'gap_references_missing_evidence' ELSE 'bibliographic_text_in_model_text' END FROM v_gap WHERE gap_id NOT IN (SELECT gap_id FROM ({_GAP_OK})) UNION ALL SELECT 'hyp:' || hypothesis_id, CASE WHEN hypothesis_id IN ({_HYP_LACKS}) THEN 'hypothesis_references_missing_evidence' WHEN gap_id NOT IN (SELECT gap_id FROM ({_GAP_OK})) THEN 'hypothesis_references_missing_gap'
  ELSE 'hypothesis_missing_prediction_or_falsification' END FROM v_hyp WHERE hypothesis_id NOT IN (SELECT hypothesis_id FROM ({_HYP_OK}))""")
def grf_excluded(spark, d):
    return _graph(spark, d)[2]


@query(f"""SELECT w.what, coalesce(n, 0) AS n FROM (VALUES ('source'), ('evidence'), ('gap'), ('hypothesis'), ('prediction'), ('falsification_test'), ('edges_supports'), ('edges_contradicts'), ('edges_motivates'), ('edges_addresses'),
  ('edges_tests')) AS w(what) LEFT JOIN (SELECT type AS what, count(*) AS n FROM ({_NODES}) GROUP BY 1 UNION ALL SELECT 'edges_' || type, count(*) FROM ({_EDGES}) GROUP BY 1) USING (what)""")
def grf_counts(spark, d):
    nodes, edges = _graph(spark, d)[:2]
    return graph.counts(nodes, edges)


@query("SELECT 'x' AS code, 'x' AS item WHERE false")
def grf_violations(spark, d):
    nodes, edges, _, ev, gaps, hyps, eligible = _graph(spark, d)
    return graph.violations(stored(nodes, "nodes"), stored(edges, "edges"), ev, gaps, hyps, eligible)


@query(f"""SELECT 'dangling_edge' AS code, edge_id AS item FROM ({_EDGES}) WHERE contains(edge_id, 'gap:') UNION ALL SELECT 'hypothesis_gap_link', 'hyp:' || hypothesis_id FROM ({_HYP_OK})""")
def grf_violations_spoilt(spark, d):
    nodes, edges, _, ev, gaps, hyps, eligible = _graph(spark, d)
    return graph.violations(stored(nodes.filter("type <> 'gap'"), "nodes"), stored(edges, "edges"), ev, gaps, hyps, eligible)


@query(f"""SELECT node_id, direction, edge_type, string_agg(other, ',' ORDER BY other) AS related FROM (SELECT source AS node_id, 'out' AS direction, type AS edge_type, target AS other FROM ({_EDGES})
  UNION ALL SELECT target, 'in', type, source FROM ({_EDGES})) GROUP BY ALL""")
def grf_neighbours(spark, d):
    nodes, edges = _graph(spark, d)[:2]
    return graph.neighbours(nodes, edges).withColumn("related", F.array_join("related", ","))


@query(f"""SELECT 'digraph evidence {{' || chr(10) || string_agg(line, chr(10) ORDER BY part, k) || chr(10) || '}}' AS dot FROM (SELECT 0 AS part, node_id AS k, '  "' || node_id || '" [label="' || item_id || '"];' AS line FROM ({_NODES})
  UNION ALL SELECT 1, edge_id, '  "' || source || '" -> "' || target || '" [label="' || type || '"];' FROM ({_EDGES}))""")
def grf_dot(spark, d):
    nodes, edges = _graph(spark, d)[:2]
    return graph.dot_text(nodes, edges)


# ---- reports -----------------------------------------------------------------------------------

_USES = "SELECT CAST(floor(ordinal / 50) AS BIGINT) AS report_id, ordinal AS position, concat('r', CAST((ordinal * 31) % 23 AS STRING)) AS record_id FROM v_record"


@query(f"""SELECT report_id, record_id, CASE WHEN ok THEN 'S' || row_number() OVER (PARTITION BY report_id, ok ORDER BY first, record_id) END AS ref, CASE WHEN ok THEN 'resolved' ELSE 'unresolved' END AS status
  FROM (SELECT report_id, record_id, min(position) AS first, CAST(substr(record_id, 2) AS INT) % 5 <> 0 AS ok FROM ({_USES}) GROUP BY report_id, record_id)""")
def rep_citations(spark, d):
    known = relation(spark, d, "SELECT DISTINCT concat('r', CAST((ordinal * 31) % 23 AS STRING)) AS record_id FROM v_record").filter(F.substring("record_id", 2, 9).cast("int") % 5 != 0)
    return report.numbered_citations(relation(spark, d, _USES), known).select("report_id", "record_id", "ref", "status")


_REPORT = """SELECT doc_id AS report_id, concat('intro', chr(10), '## A. Research Question', chr(10), chr(10), text, chr(10), '## C. Key Findings', chr(10), 'see ', source, chr(10), '## Other', chr(10), 'x ', lang, ' ', chr(10)) AS report FROM documents"""


@query(r"""SELECT doc_id AS report_id, 'A. Research Question' AS title, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM documents
  UNION ALL SELECT doc_id, 'C. Key Findings', concat('see ', source, chr(10), '## Other', chr(10), 'x ', lang) FROM documents""")
def rep_sections(spark, d):
    return report.sections(relation(spark, d, _REPORT))


_MD = lambda c: rf"regexp_replace(regexp_replace({c}, '[\r\n]', ' ', 'g'), '([\\`*_\[\]|<>#])', '\\\1', 'g')"


@query(f"""SELECT ordinal, '- **[S' || ordinal || ']** **[Preprint — not peer-reviewed]** ' || coalesce({_MD('author')}, 'authors not available') || '. ' || coalesce('*' || {_MD('title')} || '*', 'title not available') || '. ' || coalesce({_MD('journal')}, 'journal not available')
  || '. ' || coalesce(CAST(year AS VARCHAR), 'year not available') || '. ' || coalesce('DOI: [' || {_MD('doi')} || '](https://doi.org/' || doi || ').', 'DOI: not available.') || ' ' ||
  coalesce('PMID: [' || pmid || '](https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/).', 'PMID: not available.') || ' URL: not available. Verification: verified. Record: `' || {_RECORD_ID} || '`.' AS line FROM ({_IDS})""")
def rep_source_lines(spark, d):
    c = F.col
    r = _records(spark, d)
    line = report.citation_line(F.concat(F.lit("S"), c("ordinal").cast("string")), {"authors": F.array_compact(F.array("author")), "title": c("title"), "journal": c("journal"), "year": c("year"), "doi": c("doi"), "pmid": c("pmid"),
                                "url": F.lit(None).cast("string"), "verification": F.lit("verified"), "status": F.lit("preprint"), "record_id": c("record_id")})
    return r.select("ordinal", line.alias("line"))


@query(f"""SELECT hypothesis_id, CAST(sum(n) AS BIGINT) AS items, CAST(count(*) AS BIGINT) AS sources FROM (SELECT hypothesis_id, source_no, count(*) AS n FROM ({_CITED}) GROUP BY ALL) GROUP BY hypothesis_id""")
def rep_source_quality(spark, d):
    s = report.source_quality(_cited(spark, d))
    n = lambda p: F.regexp_extract("summary", p, 1).cast("long")
    return s.select("hypothesis_id", n(r"^(\d+) evidence").alias("items"), n(r"from (\d+) distinct").alias("sources"))


# ---- control and state -------------------------------------------------------------------------

_SWITCH = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'False ' WHEN 3 THEN 'true' WHEN 4 THEN '0' ELSE 'off' END AS raw FROM events"


@query(f"SELECT event_id, event_id % 6 > 2 AS killed, event_id % 6 = 3 AS open, event_id % 6 <> 2 AS sign_in FROM ({_SWITCH})")
def ctl_kill(spark, d):
    r = F.col("raw")
    return relation(spark, d, _SWITCH).select("event_id", control.kill_switch(r).alias("killed"), control.gate(r).alias("open"), control.requires_sign_in(r).alias("sign_in"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'auth_not_required' WHEN event_id % 7 = 0 THEN 'auth_not_configured' WHEN event_id % 5 = 0 THEN 'anonymous' WHEN event_id % 3 = 0 THEN 'email_unverified' WHEN event_id % 13 = 0 THEN 'no_email'
  WHEN user_id % 2 = 0 THEN 'allowed' ELSE 'not_allowlisted' END AS reason FROM events""")
def ctl_access(spark, d):
    e = relation(spark, d, "events")
    n = lambda k: F.col("event_id") % k != 0
    email = F.when(n(13), F.concat(F.lit(" U"), (F.col("user_id") % 2).cast("string"), F.lit("@x.org")))
    return e.select("event_id", control.access_reason(n(11), n(7), n(5), F.when(n(3), F.lit(None).cast("boolean")).otherwise(F.lit(False)), email, control.allow_list(F.lit("u0@X.org, ,z@x.org"))).alias("reason"))


_REQUEST = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'short' ELSE 'A question that is long enough' END AS question, CAST(1790 + event_id % 40 AS INT) AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1800 + event_id % 7 AS INT) END AS b, CAST(event_id % 25 AS INT) AS n, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'demo' END AS mode FROM events"


@query(f"""SELECT event_id, concat_ws('|', CASE event_id % 4 WHEN 0 THEN 'question_missing' WHEN 1 THEN 'question_too_short' END, CASE WHEN a < 1800 THEN 'from_year' END, CASE WHEN a > b THEN 'year_order' END, CASE WHEN n < 1 OR n > 20 THEN 'max_sources' END,
  CASE WHEN mode = 'test' THEN 'mode' END) AS errors FROM ({_REQUEST})""")
def ctl_validate_request(spark, d):
    c = F.col
    return relation(spark, d, _REQUEST).select("event_id", _joined(control.request_errors(c("question"), c("a"), c("b"), c("n"), c("mode"))).alias("errors"))


@query("SELECT user_id, event_type AS stage, arg_max(value, event_id) AS state FROM events GROUP BY user_id, event_type")
def ctl_progress(spark, d):
    e = relation(spark, d, "SELECT user_id, event_type AS stage, value AS state, event_id FROM events")
    return control.last_states(e, "user_id", "stage", "state", "event_id")


_RUNS = "SELECT user_id AS identity, ts, event_id FROM events"
_QUOTA = f"""WITH RECURSIVE runs AS (SELECT identity, ts, event_id, row_number() OVER (PARTITION BY identity ORDER BY ts, event_id) AS n FROM ({_RUNS})),
fold AS (SELECT identity, n, event_id, ts, [ts] AS live, true AS granted, CAST(1 AS BIGINT) AS used, CAST(NULL AS DOUBLE) AS retry FROM runs WHERE n = 1
  UNION ALL SELECT r.identity, r.n, r.event_id, r.ts, CASE WHEN len(kept) < 3 THEN kept || [r.ts] ELSE kept END, len(kept) < 3, CASE WHEN len(kept) < 3 THEN len(kept) + 1 ELSE len(kept) END,
    CASE WHEN len(kept) < 3 THEN NULL ELSE greatest(0.0, epoch_us(kept[1]) / 1e6 + 86400 - epoch_us(r.ts) / 1e6) END
  FROM (SELECT f.identity, f.n, r.ts AS t, list_filter(f.live, lambda x: x > r.ts - INTERVAL 24 HOUR) AS kept FROM fold f JOIN runs r ON r.identity = f.identity AND r.n = f.n + 1) k JOIN runs r ON r.identity = k.identity AND r.n = k.n + 1)"""


@query(_QUOTA + " SELECT identity, event_id, granted, used FROM fold")
def quota_rolling(spark, d):
    return control.rolling_quota(relation(spark, d, _RUNS), 3).select("identity", "event_id", "granted", F.col("used").cast("long").alias("used"))


@query(_QUOTA + " SELECT identity, event_id, CAST(round(retry) AS BIGINT) AS retry_after_s FROM fold WHERE NOT granted")
def quota_retry_after(spark, d):
    out = control.rolling_quota(relation(spark, d, _RUNS), 3).filter("NOT granted")
    return out.select("identity", "event_id", F.round("retry_after_s").cast("long").alias("retry_after_s"))


_SPEND = "SELECT conv_id, turn, input_tokens, coalesce(output_tokens, 100) AS output_tokens, CAST(input_tokens AS DECIMAL(18,0)) + CAST(coalesce(output_tokens, 100) AS DECIMAL(18,0)) AS cost FROM v_attempt"


@query(f"""SELECT conv_id, turn, CAST(sum(input_tokens) OVER w AS BIGINT) AS input_total, CAST(sum(output_tokens) OVER w AS BIGINT) AS output_total, CAST(sum(cost) OVER w AS DOUBLE) AS spend_total FROM ({_SPEND})
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def budget_record(spark, d):
    return control.recorded_spend(relation(spark, d, _SPEND), "conv_id", "turn").withColumn("spend_total", F.col("spend_total").cast("double"))


@query("""WITH RECURSIVE a AS (SELECT conv_id, turn, input_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM v_attempt),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS tokens, CAST(NULL AS VARCHAR) AS stop, false AS granted, CAST(NULL AS VARCHAR) AS why FROM (SELECT DISTINCT conv_id FROM a)
  UNION ALL SELECT conv_id, n, turn, used + ok::INT, tokens + CASE WHEN ok THEN input_tokens ELSE 0 END, coalesce(stop, CASE WHEN ok AND used + 1 >= 4 THEN 'max_attempts' WHEN ok AND tokens + input_tokens >= 900 THEN 'max_input_tokens' END, why), ok, why
  FROM (SELECT *, why IS NULL AS ok FROM (SELECT f.conv_id, a.n, a.turn, f.used, f.tokens, f.stop, a.input_tokens, CASE WHEN f.stop IS NOT NULL THEN f.stop WHEN f.used + 1 > 4 THEN 'max_attempts' WHEN f.tokens + a.input_tokens > 900 THEN 'max_input_tokens' END AS why
    FROM f JOIN a ON a.conv_id = f.conv_id AND a.n = f.n + 1)))
SELECT conv_id, turn, granted, why AS stopped_by FROM f WHERE n > 0""")
def budget_reserve(spark, d):
    a = relation(spark, d, "v_attempt").select("conv_id", "turn", F.col("input_tokens").alias("estimate"), F.lit(0).alias("worst_cost"), "input_tokens", F.lit(0).alias("cost"), F.lit(0).alias("keep"))
    return control.reserved(a, 4, 900, None, "conv_id", "turn")


@query(f"""WITH RECURSIVE r AS (SELECT identity, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY identity ORDER BY ts, event_id) AS n FROM ({_RUNS})),
f AS (SELECT identity, n, event_id, t AS sent_us FROM r WHERE n = 1 UNION ALL SELECT r.identity, r.n, r.event_id, greatest(r.t, f.sent_us + 3600000000) FROM f JOIN r ON r.identity = f.identity AND r.n = f.n + 1)
SELECT identity, event_id, sent_us FROM f""")
def rate_limit(spark, d):
    return control.rate_limited(relation(spark, d, _RUNS), 3_600_000_000, "identity", "ts", "event_id").select("identity", "event_id", "sent_us")


# ---- payloads ----------------------------------------------------------------------------------

_ANSWER = """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN concat('{"status":"completed","output":[{"type":"reasoning"},{"type":"message","role":"assistant","content":[{"type":"output_text","text":"a', CAST(conv_id AS STRING), '"},{"type":"output_text","text":"b"}]}],"usage":{"prompt_tokens":',
  CAST(conv_id AS STRING), ',"output_tokens":7,"total_tokens":-1,"cost_in_usd_ticks":5}}') WHEN 1 THEN '{"error":{"message":"busy"}}' WHEN 2 THEN '{"status":"incomplete","incomplete_details":{"reason":"length"},"usage":{"input_tokens":true}}'
  WHEN 3 THEN '{"status":"completed","output":[{"content":[{"type":"refusal","refusal":"no"}]}]}' WHEN 4 THEN '{"status":"completed","output":[]}' ELSE '[]' END AS payload FROM conversations"""


@query(f"""SELECT conv_id, turn, turn % 6 IN (0, 2) AS reported, CASE WHEN turn % 6 = 0 THEN conv_id END AS input, CASE WHEN turn % 6 = 0 THEN CAST(7 AS BIGINT) END AS output, CAST(NULL AS BIGINT) AS total, CASE WHEN turn % 6 = 0 THEN CAST(5 AS BIGINT) END AS ticks FROM conversations""")
def jsn_usage(spark, d):
    u = relation(spark, d, _ANSWER).select("conv_id", "turn", payloads.usage(F.col("payload")).alias("u"))
    return u.select("conv_id", "turn", "u.reported", "u.input", "u.output", "u.total", "u.ticks")


@query("""SELECT conv_id, turn, CASE WHEN turn % 6 = 0 THEN 'a' || CAST(conv_id AS VARCHAR) || 'b' END AS text, CASE turn % 6 WHEN 1 THEN 'provider_error' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'refusal' WHEN 4 THEN 'missing_output_text'
  WHEN 5 THEN 'malformed_payload' END AS problem FROM conversations""")
def jsn_output_text(spark, d):
    return relation(spark, d, _ANSWER).select("conv_id", "turn", payloads.output_text(F.col("payload")).alias("o")).select("conv_id", "turn", "o.text", "o.problem")


_ENVELOPE = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('```json', chr(10), '{"items": [1, ', CAST(conv_id AS STRING), ']}', chr(10), '```') WHEN 1 THEN '{"items": {}}' WHEN 2 THEN '{"items": [], "more": 1}' WHEN 3 THEN 'not json' ELSE '[1]' END AS answer FROM conversations"""


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN CAST(2 AS BIGINT) END AS n, CASE turn % 5 WHEN 1 THEN 'not_a_list' WHEN 2 THEN 'unexpected_field' WHEN 3 THEN 'invalid_output_json' WHEN 4 THEN 'not_an_object' END AS problem FROM conversations""")
def jsn_envelope(spark, d):
    e = relation(spark, d, _ENVELOPE).select("conv_id", "turn", payloads.envelope(F.col("answer"), "items").alias("e"))
    return e.select("conv_id", "turn", F.col("e.n").cast("long").alias("n"), "e.problem")


_XML = """SELECT c_custkey, concat('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>0', CAST(c_custkey + 1 AS STRING), '</PMID><Article><Abstract><AbstractText Label="AIM">To  <i>see</i></AbstractText><AbstractText>Then.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>',
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '</PubmedArticleSet>' END) AS xml FROM customer"""


@query("SELECT c_custkey, CAST(c_custkey + 1 AS VARCHAR) AS pmid, 'AIM: To see Then.' AS abstract FROM customer WHERE c_custkey % 3 <> 0")
def txt_xml_abstracts(spark, d):
    x = relation(spark, d, _XML).select("c_custkey", F.explode(payloads.xml_abstracts("xml")).alias("a"))
    return x.select("c_custkey", "a.pmid", "a.abstract")


@query("SELECT conv_id, turn, text AS value FROM conversations WHERE length(text) >= 12 AND NOT starts_with(text, 'rec_')")
def red_rejected_texts(spark, d):
    raw = relation(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct("text", F.lit("rec_0123456789abcdef").alias("id"), F.lit("short").alias("s")).alias("item"))).alias("raw"))
    return raw.select("conv_id", "turn", F.explode(payloads.rejected_texts("raw")).alias("value"))


# ---- extensions: not in the reference, marked as such ------------------------------------------


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def ext_tumbling(spark, d):
    e = relation(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("day_us"), "event_type", "n")


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def ext_session(spark, d):
    e = relation(spark, d, "events")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


# ---- quota stores: runs as they arrive, their clocks disturbed -----------------------------------

_ARRIVALS = """SELECT user_id AS identity, CASE event_id % 5 WHEN 0 THEN ts + INTERVAL '2' DAY WHEN 1 THEN ts + INTERVAL '4' MINUTE WHEN 2 THEN ts - INTERVAL '9' HOUR ELSE ts END AS ts, event_id FROM events"""


def _store_oracle(counted: str, denied: str, first: str) -> str:
    return f"""WITH RECURSIVE runs AS (SELECT identity, ts, event_id, row_number() OVER (PARTITION BY identity ORDER BY event_id) AS n FROM ({_ARRIVALS})),
fold AS (SELECT identity, n, event_id, [ts] AS live, true AS granted, CAST(1 AS BIGINT) AS used, CAST(NULL AS DOUBLE) AS retry FROM runs WHERE n = 1
  UNION ALL SELECT identity, n, event_id, CASE WHEN len(kept) < 3 THEN kept || [ts] ELSE {denied} END, len(kept) < 3, CASE WHEN len(kept) < 3 THEN len(kept) + 1 ELSE len(kept) END,
    CASE WHEN len(kept) < 3 THEN NULL ELSE greatest(0.0, (epoch_us({first}) + 86400000000 - epoch_us(ts)) / 1e6) END
  FROM (SELECT r.identity, r.n, r.event_id, r.ts, f.live AS old, list_filter(f.live, lambda x: {counted}) AS kept FROM fold f JOIN runs r ON r.identity = f.identity AND r.n = f.n + 1))
SELECT identity, event_id, granted, used, CAST(round(retry) AS BIGINT) AS retry_after_s FROM fold"""


def _decided(df):
    return df.select("identity", "event_id", "granted", F.col("used").cast("long").alias("used"), F.round("retry_after_s").cast("long").alias("retry_after_s"))


@query(_store_oracle("x > r.ts - INTERVAL 24 HOUR", "kept", "list_min(kept)"))
def quota_sql_store(spark, d):
    return _decided(control.quota_of_sql_store(relation(spark, d, _ARRIVALS), 3))


@query(_store_oracle("x > r.ts - INTERVAL 24 HOUR AND x <= r.ts + INTERVAL 300 SECOND", "old", "list_sort(kept)[len(kept) - 2]"))
def quota_file_store(spark, d):
    return _decided(control.quota_of_file_store(relation(spark, d, _ARRIVALS), 3))


@query("SELECT event_id, CAST(CASE WHEN value IS NULL OR value <= 1 THEN 1 ELSE ceil(value) END AS BIGINT) AS hours FROM events")
def quota_message(spark, d):
    return relation(spark, d, "events").select("event_id", control.quota_message_hours(F.col("value") * 3600).alias("hours"))


# ---- statuses and failures ---------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'kill_switch' WHEN event_id % 7 = 0 THEN 'gate_closed' WHEN event_id % 5 = 0 THEN 'missing_credentials' WHEN event_id % 3 = 0 THEN 'quota_store_unavailable'
  WHEN user_id % 2 = 0 THEN 'available' ELSE 'anonymous' END AS status FROM events""")
def ctl_availability(spark, d):
    n = lambda k: F.col("event_id") % k
    reason = F.when(F.col("user_id") % 2 == 0, F.when(n(2) == 0, F.lit("allowed")).otherwise(F.lit("auth_not_required"))).otherwise(F.lit("anonymous"))
    problem = F.when(n(3) == 0, F.lit("quota_store_unavailable"))
    return relation(spark, d, "events").select("event_id", control.availability(n(11) == 0, n(7) != 0, n(5) != 0, problem, reason).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'budget_exhausted' WHEN event_id % 5 = 0 THEN 'model_auth_error' WHEN event_id % 3 = 0 THEN 'degraded' ELSE 'ok' END AS status FROM events")
def ctl_run_status(spark, d):
    n = lambda k: F.col("event_id") % k == 0
    return relation(spark, d, "events").select("event_id", control.run_status(n(7), n(5), n(3)).alias("status"))


_FAILURES = """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'model_error' WHEN 1 THEN 'config_error' WHEN 2 THEN 'http_error' WHEN 3 THEN 'auth_error' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'timeout' WHEN 6 THEN 'connection_error'
  WHEN 7 THEN 'parse_error' WHEN 8 THEN 'incomplete' WHEN 9 THEN 'refused' WHEN 10 THEN 'schema_violation' WHEN 11 THEN 'budget_exhausted' ELSE NULL END AS kind,
  CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE NULL END AS status FROM events"""


@query("""SELECT event_id, event_id % 13 IN (4, 5, 6) OR (event_id % 13 = 2 AND event_id % 4 IN (0, 1)) AS retryable FROM events""")
def ctl_retryable(spark, d):
    return relation(spark, d, _FAILURES).select("event_id", control.retryable(F.col("kind"), F.col("status")).alias("retryable"))


_FOUND_COUNTS = "SELECT event_id, event_id % 3 AS ids, event_id % 2 AS docs, event_id % 5 AS errors FROM events"


@query(f"SELECT event_id, CASE WHEN errors = 0 THEN 'ok' WHEN ids + docs = 0 THEN 'failed' ELSE 'partial' END AS status FROM ({_FOUND_COUNTS})")
def src_search_status(spark, d):
    c = F.col
    return relation(spark, d, _FOUND_COUNTS).select("event_id", retrieval.search_status(c("ids"), c("docs"), c("errors")).alias("status"))


@query(f"SELECT event_id, CASE WHEN ids > 0 THEN 'issues' WHEN docs > 0 THEN 'passed_with_rejections' ELSE 'passed' END AS status FROM ({_FOUND_COUNTS})")
def rep_status(spark, d):
    return relation(spark, d, _FOUND_COUNTS).select("event_id", report.report_status(F.col("ids"), F.col("docs")).alias("status"))


_SPEND_BY_SOURCE = "SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'reported_ticks' WHEN 1 THEN 'estimated' ELSE NULL END AS cost_source, CAST(chars AS DECIMAL(18,0)) AS cost FROM v_attempt"


@query(f"SELECT conv_id, cost_source, CAST(sum(cost) AS DOUBLE) AS spend, count(*) AS n FROM ({_SPEND_BY_SOURCE}) GROUP BY conv_id, cost_source")
def agg_spend_by_source(spark, d):
    return control.spend_by_source(relation(spark, d, _SPEND_BY_SOURCE), "conv_id").withColumn("spend", F.col("spend").cast("double"))


# ---- names, ids, orders ------------------------------------------------------------------------

_STAGES = "SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'extraction:' WHEN 1 THEN 'gaps:' WHEN 2 THEN 'extraction' ELSE ':' END, source) AS stage FROM documents"


@query(f"SELECT doc_id, CASE WHEN split_part(stage, ':', 1) = 'extraction' THEN 'evidence' ELSE split_part(stage, ':', 1) END AS stage FROM ({_STAGES})")
def txt_stage_key(spark, d):
    return relation(spark, d, _STAGES).select("doc_id", text.stage_key(F.col("stage")).alias("stage"))


@query(r"SELECT p_partkey, regexp_replace(lower(trim(' ' || p_name || '- ' || p_brand || ' ')), '[\s\-]+', '_', 'g') AS key FROM part")
def nrm_key_form(spark, d):
    return relation(spark, d, "part").select("p_partkey", text.key_form(F.concat(F.lit(" "), "p_name", F.lit("- "), "p_brand", F.lit(" "))).alias("key"))


_PATHS = r"""SELECT page_id, concat('read /home/', CAST(page_id AS STRING), '/x.txt, then C:', chr(92), 'tmp', chr(92), 'y and a/tmp/b http://h/tmp/z (/opt/w)') AS t FROM pages"""


@query(r"""SELECT page_id, regexp_replace(t, '(^|[^\w.:/\-])(?:/(?:tmp|home|Users|var|private|mnt|workspace|root|opt|srv|etc|usr)(?:/[^\s)\]''"`>|,;]*)?|[A-Za-z]:\\[^\s)\]''"`>|,;]*)', '\1[path]', 'g') AS text FROM (""" + _PATHS + ")")
def red_paths(spark, d):
    return relation(spark, d, _PATHS).select("page_id", text.masked_paths(F.col("t")).alias("text"))


_QUERY_IDS = "SELECT question_id, database, concat(CASE WHEN query = 3 THEN 'x' ELSE 'q' END, CAST(query * 3 AS STRING)) AS q, query FROM (SELECT DISTINCT question_id, database, query FROM v_hit) AS u"


@query(f"SELECT question_id, database, string_agg(q, ',' ORDER BY CASE WHEN query = 3 THEN 1000000 ELSE query END) AS queries FROM ({_QUERY_IDS}) GROUP BY question_id, database")
def ord_query_ids(spark, d):
    ids = relation(spark, d, _QUERY_IDS).groupBy("question_id", "database").agg(F.sort_array(F.collect_list("q"), asc=False).alias("q"))
    return ids.select("question_id", "database", F.array_join(retrieval.in_query_order(F.col("q")), ",").alias("queries"))


_OPTION_NODES = """SELECT concat('src:', record_id) AS id, 'source' AS type, concat(record_id, CASE WHEN doc_id % 5 = 0 THEN ' [PREPRINT]' ELSE '' END) AS title FROM v_text
  UNION ALL SELECT concat('ev:', evidence_id), 'evidence', concat(claim, finding) FROM v_evidence UNION ALL SELECT concat('gap:', gap_id), 'gap', gap_statement FROM v_gap
  UNION ALL SELECT concat('hyp:', hypothesis_id), 'hypothesis', hypothesis FROM v_hyp UNION ALL SELECT concat('pred:', hypothesis_id), 'prediction', NULL FROM v_hyp"""


@query(f"""SELECT CAST(CASE type WHEN 'source' THEN 0 WHEN 'evidence' THEN 1 WHEN 'gap' THEN 2 WHEN 'hypothesis' THEN 3 ELSE 4 END AS BIGINT) AS type_order, id,
  CASE type WHEN 'source' THEN 'Source' WHEN 'evidence' THEN 'Evidence' WHEN 'gap' THEN 'Research gap' WHEN 'hypothesis' THEN 'Hypothesis' ELSE 'Prediction' END || ' · ' || id || ' — ' ||
  CASE WHEN length(title) > 70 THEN substr(title, 1, 69) || '…' ELSE coalesce(title, '') END AS label FROM ({_OPTION_NODES})""")
def grf_node_options(spark, d):
    return graph.node_options(relation(spark, d, _OPTION_NODES))


# ---- views for models, summaries, sources ------------------------------------------------------

_SEEN = "SELECT evidence_id, record_id, claim, CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat(finding, ' PMID: 12') END AS finding, category, source_type AS confidence, concat(quote, ' doi:10.1234/x.1') AS quote FROM v_evidence"


@query(f"""SELECT evidence_id, record_id AS source_record_id, {_nested_replace('claim', '[redacted:identifier]')} AS claim, nullif({_nested_replace('finding', '[redacted:identifier]')}, '') AS finding,
  category AS evidence_category, confidence, {_nested_replace('quote', '[redacted:identifier]')} AS verified_quote FROM ({_SEEN})""")
def prj_evidence_view(spark, d):
    return evidence.model_view(relation(spark, d, _SEEN), quote=True)


@query("""SELECT gap_id, coalesce(string_agg(claim || chr(10) || finding, chr(10) ORDER BY i), '') AS reference FROM (SELECT gap_id, unnest(refs) AS evidence_id, generate_subscripts(refs, 1) AS i FROM (SELECT gap_id, supporting || conflicting AS refs FROM v_gap))
  LEFT JOIN v_evidence USING (evidence_id) GROUP BY gap_id""")
def jn_reference_text(spark, d):
    gaps = relation(spark, d, "v_gap").withColumn("refs", F.concat("supporting", "conflicting"))
    return synthesis.reference_text(gaps, relation(spark, d, "v_evidence"), "gap_id", "refs")


_KNOWN_RECORDS = "SELECT DISTINCT CAST(floor(ordinal / 50) AS BIGINT) AS report_id, concat('r', CAST((ordinal * 17) % 29 AS STRING)) AS record_id, (ordinal * 17) % 29 AS ordinal FROM v_record"


@query(f"""WITH uses AS ({_USES}), known AS ({_KNOWN_RECORDS}), first AS (SELECT report_id, record_id, min(position) AS spot FROM uses GROUP BY ALL),
marked AS (SELECT f.*, f.record_id IN (SELECT record_id FROM known) AS ok FROM first f)
SELECT report_id, CASE WHEN ok THEN 'S' || row_number() OVER (PARTITION BY report_id, ok ORDER BY spot, record_id) END AS ref, record_id, true AS cited, ok AS resolved FROM marked
UNION ALL SELECT report_id, 'R' || row_number() OVER (PARTITION BY report_id ORDER BY ordinal, record_id), record_id, false, true FROM known k
  WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.report_id = k.report_id AND f.record_id = k.record_id)""")
def rep_listed_sources(spark, d):
    known = relation(spark, d, _KNOWN_RECORDS)
    return report.listed_sources(report.numbered_citations(relation(spark, d, _USES), known), known)


@query(f"""SELECT question_id, coalesce(n, 0) AS total_retrieved, coalesce(u, 0) AS unique_records, coalesce(n, 0) - coalesce(u, 0) AS duplicates_merged, failed AS failed_databases, part AS partially_failed_databases FROM
  (SELECT question_id, coalesce(string_agg(database, ',' ORDER BY database) FILTER (WHERE s = 'failed'), '') AS failed, coalesce(string_agg(database, ',' ORDER BY database) FILTER (WHERE s = 'partial'), '') AS part FROM
    (SELECT question_id, database, CASE WHEN bool_and(status = 'ok') THEN 'ok' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS s FROM ({_STATUS}) GROUP BY ALL) GROUP BY question_id)
  LEFT JOIN (SELECT question_id, count(*) AS n, count(DISTINCT record_id) AS u FROM v_hit GROUP BY question_id) USING (question_id)""")
def agg_retrieval_summary(spark, d):
    hits = relation(spark, d, "v_hit")
    each = retrieval.query_status(relation(spark, d, _STATUS).withColumn("at", F.struct("question_id", "database")), "at").select("at.question_id", "at.database", "status")
    out = retrieval.summary(hits, each, hits.select("question_id", "record_id").distinct())
    listed = ("failed_databases", "partially_failed_databases")
    return out.select(*[F.array_join(c, ",").alias(c) if c in listed else F.col(c) for c in out.columns])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records retrieved, identified, deduplicated, scored and ranked: the head of every investigation."""
    return rank_greedy(spark, sf_dir)
