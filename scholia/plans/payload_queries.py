"""Queries over JSON of any shape: canonical text, walks over all levels, redaction, leak scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import variants
from scholia.operators import audit
from scholia.operators.evidence import BIBLIOGRAPHIC_KEYS
from scholia.plans.registry import query
from scholia.plans.views import relation

# five levels of objects and lists; every seventh payload is cut off
_DEEP = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN concat('{"items":[{"Title":"', p_name, '","n":[1,2],"year":1999,"claim":"see 10.1234/x.', CAST(p_partkey AS STRING), ' ok"')
  ELSE concat('{"z":', CAST(p_partkey AS STRING), ',"items":[{"claim":"', p_name, ' in 10.1234/x.', CAST(p_partkey AS STRING), ' ok","meta":{"deep":{"Paper-Title":{"a":["', p_name, '"]},"list":["', p_brand, '",true,null,-1.5,{"DOI":"10.5/x","note":"',
    p_type, '"}]}}},["', p_brand, '",[[{"k":"', p_brand, '"}]]]],"a b":{},"":[]}') END AS payload FROM part"""


@query(f"SELECT p_partkey, coalesce(string_agg(trim(value::VARCHAR, '\"'), '|' ORDER BY trim(value::VARCHAR, '\"')), '') AS strings FROM ({_DEEP}) LEFT JOIN LATERAL (SELECT value FROM json_tree(CASE WHEN json_valid(payload) THEN payload END) WHERE type = 'VARCHAR') ON true GROUP BY p_partkey")
def jsn_strings(spark, d):
    s = variants.strings(variants.parsed(F.col("payload")))
    return relation(spark, d, _DEEP).select("p_partkey", F.array_join(F.array_sort(F.coalesce(s, F.array().cast("array<string>"))), "|").alias("strings"))


@query(f"SELECT p_partkey, key FROM ({_DEEP}), LATERAL (SELECT key FROM json_tree(CASE WHEN json_valid(payload) THEN payload END) WHERE NOT regexp_matches(key, '^[0-9]+$')) WHERE regexp_replace(lower(trim(key)), '[\\s\\-]+', '_', 'g') IN ({', '.join(repr(k) for k in BIBLIOGRAPHIC_KEYS)})")
def jsn_bibliographic_keys(spark, d):
    found = variants.redacted_keys(F.col("payload"), BIBLIOGRAPHIC_KEYS)
    return relation(spark, d, _DEEP).select("p_partkey", F.explode(found).alias("k")).select("p_partkey", "k.key")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN concat('{"items":[{"Title":"[redacted:bibliographic]","n":[1,2],"year":"[redacted:bibliographic]","claim":"see [redacted:identifier] ok"')
  ELSE concat('{"":[],"a b":{},"items":[{"claim":"', p_name, ' in [redacted:identifier] ok","meta":{"deep":{"Paper-Title":"[redacted:bibliographic]","list":["', p_brand, '",true,null,-1.5,{"DOI":"[redacted:bibliographic]","note":"', p_type,
    '"}]}}},["', p_brand, '",[[{"k":"', p_brand, '"}]]]],"z":', CAST(p_partkey AS VARCHAR), '}') END AS answer FROM part""")
def red_model_output(spark, d):
    return relation(spark, d, _DEEP).select("p_partkey", variants.redacted_answer(F.col("payload"), BIBLIOGRAPHIC_KEYS).alias("answer"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE sha256(concat('{"":[],"a b":{},"items":[{"claim":"', p_name, ' in 10.1234/x.', CAST(p_partkey AS VARCHAR), ' ok","meta":{"deep":{"Paper-Title":{"a":["', p_name, '"]},"list":["',
    p_brand, '",true,null,-1.5,{"DOI":"10.5/x","note":"', p_type, '"}]}}},["', p_brand, '",[[{"k":"', p_brand, '"}]]]],"z":', CAST(p_partkey AS VARCHAR), '}')) END AS sha256 FROM part""")
def jsn_content_hash(spark, d):
    return relation(spark, d, _DEEP).select("p_partkey", variants.content_hash(F.col("payload")).alias("sha256"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 3 THEN 'invalid_json' WHEN p_partkey % 7 = 5 THEN 'not_an_object' ELSE 'object' END AS parse_status, CASE WHEN p_partkey % 7 = 5 THEN 'list' END AS json_type,
  CASE WHEN p_partkey % 7 NOT IN (3, 5) THEN '[redacted],a_b,items,z' END AS top_level_keys, CASE WHEN p_partkey % 7 NOT IN (3, 5) THEN CAST(2 AS BIGINT) END AS item_count FROM part""")
def red_answer_structure(spark, d):
    s = variants.structure(F.when(F.col("p_partkey") % 7 == 5, F.lit('["x"]')).otherwise(F.col("payload")))
    out = relation(spark, d, _DEEP).select("p_partkey", s.alias("s"))
    return out.select("p_partkey", "s.parse_status", "s.json_type", F.when(F.col("s.top_level_keys").isNotNull(), F.array_join("s.top_level_keys", ",")).alias("top_level_keys"), F.col("s.item_count").cast("long").alias("item_count"))


# ---- stored calls ------------------------------------------------------------------------------

# a run for each conversation, an entry for each turn: its whole text is the answer, two turns of three are redacted
_ENTRIES = """SELECT conv_id AS run_id, CAST(turn AS INT) AS entry, 'extraction' AS stage, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN concat('{"items":[1,2],"A b":0,"k', CAST(conv_id AS STRING), '":"x"}') ELSE text END AS response_text FROM conversations"""


def _entries(spark, d):
    e = relation(spark, d, _ENTRIES).withColumn("response_sha256", F.sha2("response_text", 256))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    e = e.withColumn("messages", F.array(message("user", F.lit("go on")), message("assistant", F.concat(F.lit("said "), F.col("run_id").cast("string")))))
    final = F.max(F.when(F.col("entry") == 0, F.col("response_sha256")))
    plans = e.groupBy("run_id").agg(F.array_sort(F.collect_list(F.when(F.col("entry") % 3 < 2, F.col("entry")))).alias("entries"), final.alias("final_sha256"))
    return e, plans.select("run_id", "entries", F.lit("rec_1").alias("record_id"), "final_sha256", F.array(F.struct(F.lit(0).alias("item_index"), F.lit("accepted").alias("status"))).alias("items"))


@query(f"""SELECT run_id, entry, redacted AS model_output_redacted, CASE WHEN NOT redacted OR response_text IS NULL THEN response_text
  WHEN entry = 0 THEN '{{"call_record_id":"rec_1","items":[{{"item_index":0,"status":"accepted"}}],"parse_status":"validated_envelope","redaction_mode":"safe_diagnostics","response_length":' || length(response_text) || ',"response_sha256":"' || sha256(response_text) || '"}}'
  WHEN entry % 4 = 2 THEN '{{"call_record_id":"rec_1","item_count":2,"note":"response failed validation; content not stored","parse_status":"object","redaction_mode":"safe_diagnostics","response_length":' || length(response_text) || ',"response_sha256":"' || sha256(response_text) || '","top_level_keys":["a_b","items","k' || run_id || '"]}}'
  ELSE '{{"call_record_id":"rec_1","note":"response failed validation; content not stored","parse_status":"invalid_json","redaction_mode":"safe_diagnostics","response_length":' || length(response_text) || ',"response_sha256":"' || sha256(response_text) || '"}}' END AS response_text,
  CASE WHEN redacted THEN '{{"echoed_model_output":"[redacted]","length":' || length('said ' || run_id) || ',"redaction_mode":"safe_diagnostics","sha256":"' || sha256('said ' || run_id) || '"}}' ELSE 'said ' || run_id END AS echo
  FROM (SELECT *, entry % 3 < 2 AS redacted FROM ({_ENTRIES}))""")
def red_audit_entries(spark, d):
    kept = audit.redacted(*_entries(spark, d))[0]
    return kept.select("run_id", "entry", "model_output_redacted", "response_text", F.get("messages", F.lit(1))["content"].alias("echo"))


@query(f"SELECT run_id, entry, response_text, 'said ' || run_id AS said FROM ({_ENTRIES}) WHERE entry % 3 < 2")
def red_audit_originals(spark, d):
    taken = audit.redacted(*_entries(spark, d))[1]
    return taken.select("run_id", "entry", "response_text", F.array_join("assistant_messages", "|").alias("said"))
