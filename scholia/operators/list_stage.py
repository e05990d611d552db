"""A stage whose model answers with a list of items: every item is judged once, accepted or rejected.

The judged items are written once, a folder for each verdict; accepted items, rejected ones and the plan for redacting
the answers are reads of it, and counts come from the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scholia.functions.payloads import envelope, unfenced
from scholia.functions.text import key_form, safe_id
from scholia.functions.variants import parsed, text_of
from scholia.sources.storage import stored_by

Judge = Callable[[Column], Column]
_REASONS = "array<struct<code:string,detail:string>>"


@dataclass
class StageResult:
    """accepted (run_id, item_index, item, raw_item_sha256); rejected (the same without the item, with reason_codes,
    reasons and diagnostics); plan (run_id, items, repaired) for runs whose stored answers must be redacted;
    failed (run_id, problem) for answers that are no list; counts: returned, accepted, rejected, rejected_<code>."""

    accepted: DataFrame
    rejected: DataFrame
    plan: DataFrame
    failed: DataFrame
    counts: dict[str, int]


def diagnostics(raw: Column, allowed: tuple[str, ...], bibliographic: tuple[str, ...]) -> Column:
    """What may be told of a rejected item: which fields it has, how long they are, which of its keys are
    bibliographic (at the first level) and how many others there are. No text of the model."""
    fields = F.try_variant_get(raw, "$", "map<string,variant>")
    keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    named = F.array(*[F.lit(a) for a in allowed])
    value = lambda k: F.element_at(fields, k)
    length = lambda k: F.coalesce(F.length(text_of(value(k))), F.size(F.try_variant_get(value(k), "$", "array<variant>")))
    is_object = fields.isNotNull()
    return F.struct(
        F.when(is_object, F.lit("dict")).when(F.try_variant_get(raw, "$", "array<variant>").isNotNull(), F.lit("list")).when(text_of(raw).isNotNull(), F.lit("str")).otherwise(F.lit("other")).alias("item_type"),
        F.when(is_object, F.array_intersect(named, keys)).alias("fields_present"), F.when(is_object, F.array_except(named, keys)).alias("fields_missing"),
        F.when(is_object, F.array_sort(F.array_distinct(F.filter(F.transform(keys, key_form), lambda k: k.isin(*bibliographic))))).alias("bibliographic_keys"),
        F.when(is_object, F.size(F.filter(keys, lambda k: ~k.isin(*allowed)))).alias("other_field_count"),
        F.when(is_object, F.transform(F.filter(named, lambda a: F.array_contains(keys, a)), lambda a: F.struct(a.alias("field"), length(a).alias("length")))).alias("field_lengths"),
    )


def run(answers: DataFrame, key: str, judge: Judge, allowed: tuple[str, ...], codes: tuple[str, ...], bibliographic: tuple[str, ...] = (), max_items: int = 5, id_field: str | None = None) -> StageResult:
    """answers (run_id, answer: a model's text {key: [...]}, repaired: whether it was asked again), one for each run.

    judge(raw, a VARIANT) -> an array of (code, detail), empty where the item passes; an item from max_items on is
    rejected unjudged. codes: those that are counted. A null answer is a failed one; an empty list has no items."""
    judged = answers.select("run_id", F.coalesce("repaired", F.lit(False)).alias("repaired"), F.when(F.col("answer").isNull(), F.lit("no_answer")).otherwise(envelope(F.col("answer"), key)["problem"]).alias("problem"),
                            F.try_variant_get(parsed(unfenced(F.col("answer"))), f"$.{key}", "array<variant>").alias("items"))
    items = judged.select("run_id", "repaired", "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("items"))).alias("item_index", "raw"))
    over = F.array(F.struct(F.lit("exceeds_item_limit").alias("code"), F.lit(f"more than {max_items} items").alias("detail"))).cast(_REASONS)
    none = F.array().cast(_REASONS)
    reasons = F.when(F.col("item_index").isNull(), none).when(F.col("item_index") >= max_items, over).otherwise(judge(F.col("raw")).cast(_REASONS))
    status = F.when(F.col("problem").isNotNull(), F.lit("failed")).when(F.col("item_index").isNull(), F.lit("empty")).when(F.size("reasons") == 0, F.lit("accepted")).otherwise(F.lit("rejected"))
    told = items.withColumn("reasons", reasons).withColumn("status", status).select(
        "run_id", "repaired", "problem", "item_index", "status", "reasons", F.transform("reasons", lambda r: r["code"]).alias("reason_codes"), F.when(F.col("item_index").isNotNull(), F.sha2(F.to_json("raw"), 256)).alias("raw_item_sha256"),
        F.when(F.col("status") == "accepted", F.to_json("raw")).alias("item"), F.when(F.col("status") == "rejected", diagnostics(F.col("raw"), allowed, bibliographic)).alias("diagnostics"),
        F.when(F.col("status") == "rejected", safe_id(F.try_variant_get("raw", f"$.{id_field}", "string"))).alias("model_item_id") if id_field else F.lit(None).cast("struct<value:string,sha256:string,length:int>").alias("model_item_id"),
    )
    seen = Observation("list-stage")
    is_ = lambda s: F.col("status") == s
    metrics = [F.count_if(is_("accepted") | is_("rejected")).alias("returned"), F.count_if(is_("accepted")).alias("accepted"), F.count_if(is_("rejected")).alias("rejected"), F.count_if(is_("failed")).alias("failed_runs")]
    times = lambda code: F.coalesce(F.size("reason_codes") - F.size(F.array_remove("reason_codes", code)), F.lit(0))
    metrics += [F.sum(times(k)).alias(f"rejected_{k}") for k in ("exceeds_item_limit", *codes)]
    written = stored_by(told.observe(seen, *metrics), "list-stage", "status")
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    summary = F.struct("item_index", "status", "raw_item_sha256", "reason_codes")
    bad = F.max((F.col("status").isin("rejected", "failed") | F.col("repaired")).cast("int"))
    told_items = F.array_sort(F.collect_list(F.when(F.col("item_index").isNotNull(), summary)))  # of one answer
    plan = written.groupBy("run_id").agg(told_items.alias("items"), F.max("repaired").alias("repaired"), bad.alias("bad")).filter("bad = 1").drop("bad")
    return StageResult(
        written.filter(is_("accepted")).select("run_id", "item_index", "item", "raw_item_sha256"),
        written.filter(is_("rejected")).select("run_id", "item_index", "reason_codes", "reasons", "diagnostics", "model_item_id", "raw_item_sha256"),
        plan, written.filter(is_("failed")).select("run_id", "problem"), counts,
    )
