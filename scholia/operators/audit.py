"""What may stay of stored model calls: answers of redacted calls become summaries, echoed answers become hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.variants import canonical_struct, structure

MODE = "safe_diagnostics"
FAILED = "response failed validation; content not stored"


def summary(record_id: Column, sha256: Column, text: Column, final_sha256: Column, items: Column) -> Column:
    """JSON of what is told of a stored answer: its hash and length, and, where it is the answer that was validated, the
    summaries of its items; else the answer's structure."""
    length = F.length(F.coalesce(text, F.lit("")))
    head = lambda *more: canonical_struct(F.struct(F.lit(MODE).alias("redaction_mode"), record_id.alias("call_record_id"), sha256.alias("response_sha256"), length.alias("response_length"), *more))
    s = structure(F.coalesce(text, F.lit("")))
    valid = head(F.lit("validated_envelope").alias("parse_status"), items.alias("items"))
    note = F.lit(FAILED).alias("note")
    kinds = F.when(s["parse_status"] == "invalid_json", head(s["parse_status"].alias("parse_status"), note)).when(
        s["parse_status"] == "not_an_object", head(s["parse_status"].alias("parse_status"), s["json_type"].alias("json_type"), note)).otherwise(
        head(s["parse_status"].alias("parse_status"), s["top_level_keys"].alias("top_level_keys"), s["item_count"].alias("item_count"), note))
    return F.when(F.coalesce(final_sha256 == sha256, F.lit(False)), valid).otherwise(kinds)


def without_echoes(messages: Column) -> Column:
    """messages (role, content) of a request, what the model had said as hash and length."""
    said = lambda m: F.coalesce(m["content"], F.lit(""))
    echo = lambda m: canonical_struct(F.struct(F.lit(MODE).alias("redaction_mode"), F.lit("[redacted]").alias("echoed_model_output"), F.sha2(said(m), 256).alias("sha256"), F.length(said(m)).alias("length")))
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", echo(m)).otherwise(m["content"]).alias("content")))


def redacted(entries: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, originals). entries (run_id, entry, stage, response_text, response_sha256, messages) of which plans (run_id,
    entries: the numbers, record_id, final_sha256, items) name some: those lose their answer and echoes and are
    marked. originals (run_id, entry, stage, record_id, response_text, assistant_messages): what was taken out, for an
    opt-in debug folder alone. An entry that several plans name follows the least record_id."""
    named = plans.select("run_id", F.explode("entries").alias("entry"), F.struct("record_id", "final_sha256", "items").alias("plan"))
    named = named.groupBy("run_id", "entry").agg(F.min_by("plan", "plan.record_id").alias("plan"))
    e = entries.join(named, ["run_id", "entry"], "left")
    hit = F.col("plan").isNotNull()
    text = F.when(hit & F.col("response_text").isNotNull(), summary(F.col("plan.record_id"), F.col("response_sha256"), F.col("response_text"), F.col("plan.final_sha256"), F.col("plan.items")))
    kept = e.select("run_id", "entry", "stage", F.when(hit, text).otherwise(F.col("response_text")).alias("response_text"), "response_sha256",
                    F.when(hit, without_echoes(F.col("messages"))).otherwise(F.col("messages")).alias("messages"), hit.alias("model_output_redacted"), F.when(hit, F.lit(MODE)).alias("redaction_mode"))
    echoed = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    taken = e.filter(hit & (F.col("response_text").isNotNull() | (F.size(echoed) > 0)))
    return kept, taken.select("run_id", "entry", "stage", "plan.record_id", "response_text", echoed.alias("assistant_messages"))
