"""A critic's reviews and a model's revisions of candidate hypotheses, per run: which of them count, and what is kept.

Every side of a join here grows with the runs. Files and shuffles of like rows are small on disk and large in memory, so
joins ask to be merged: none is broadcast by the size of its files, which the driver would have to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import bibliographic, collapsed
from scholia.functions.variants import parsed, text_of

# The checks of a review, its verdicts and bounds, and notes on how far a hypothesis was tested.
CHECKS = ("evidence_supports_mechanism", "causal_language_exceeds_evidence", "distinct_from_evidence", "prediction_measurable", "prediction_discriminates",
          "falsification_meaningful", "ignored_contradictions_or_missing_evidence", "confidence_consistent")
VERDICTS = ("pass", "fail", "uncertain")
REVIEW_KEYS = ("hypothesis_id", "checks", "unsupported_evidence_ids", "substantive_problems")
MOST_PROBLEMS, MOST_EXPLANATION = 5, 400
WITHHELD = "[explanation withheld: failed deterministic checks]"
NOT_TESTED = "NOT stress-tested: the critic did not review this hypothesis"
REVISED = "revised after critic/deterministic findings; the critic was not re-run on the revision"
COMPLETED = "critic review completed"


def _unknown(text: Column, prefix: str, known: Column) -> Column:
    """Whether a text names an id of the prefix that is not among the known ones."""
    named = F.regexp_extract_all(text, F.lit(rf"\b{prefix}_[A-Za-z0-9_]*"), F.lit(0))
    return F.size(F.array_except(named, F.coalesce(known, F.array().cast("array<string>")))) > 0


def sanitised(text: Column, evidence: Column, sources: Column, gaps: Column, most: int = MOST_EXPLANATION) -> Column:
    """struct(text, withheld): a critic's words on one line and within bounds; withheld where they are no text, cite or
    identify something, or name an id that is not known."""
    bad = text.isNull() | bibliographic(text) | _unknown(text, "ev", evidence) | _unknown(text, "rec", sources) | _unknown(text, "gap", gaps)
    line = collapsed(text)
    cut = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)
    return F.struct(F.when(bad, F.lit(WITHHELD)).otherwise(cut).alias("text"), F.coalesce(bad, F.lit(True)).alias("withheld"))


def validated(reviews: DataFrame, candidates: DataFrame, context: DataFrame) -> DataFrame:
    """Every review (run_id, item_index, review: JSON) with its code; of those that are ok, what is kept.

    candidates (run_id, hypothesis_id, evidence_ids), context (run_id, evidence, sources, gaps: known ids). Codes, in this
    order: malformed_review (other keys than a review's), unknown_hypothesis_id, duplicate_review (a valid one came
    before), malformed_review (other checks or verdicts than there are), ok. Adds hypothesis_id, checks (name ->
    verdict, explanation), unsupported_evidence_ids (of those the candidate cites), substantive_problems,
    has_substantive_problems and sanitized; all null unless ok."""
    fields = F.try_variant_get(parsed(F.col("review")), "$", "map<string,variant>")
    same = lambda keys, wanted: F.coalesce(F.array_sort(keys) == F.array_sort(F.array(*[F.lit(k) for k in wanted])), F.lit(False))
    field = lambda k: F.element_at("fields", k)
    r = reviews.select("run_id", "item_index", fields.alias("fields")).select(
        "*", same(F.map_keys("fields"), REVIEW_KEYS).alias("formed"), text_of(field("hypothesis_id")).alias("hid"), F.try_variant_get(field("checks"), "$", "map<string,variant>").alias("said"))
    words = lambda k, what: text_of(F.try_variant_get(F.element_at("said", k), f"$.{what}", "variant"))
    items = lambda k: F.transform(F.coalesce(F.try_variant_get(field(k), "$", "array<variant>"), F.array().cast("array<variant>")), text_of)
    # texts alone go on: every variant out of a review holds all of the review's names
    entry = lambda k: F.struct(F.lit(k).alias("name"), words(k, "verdict").alias("verdict"), words(k, "explanation").alias("explanation"))
    r = r.select("run_id", "item_index", "formed", "hid", same(F.map_keys("said"), CHECKS).alias("judged"), F.array(*[entry(k) for k in CHECKS]).alias("given"),
                 items("unsupported_evidence_ids").alias("unsupported"), F.slice(items("substantive_problems"), 1, MOST_PROBLEMS).alias("reported"))
    r = r.withColumn("judged", F.col("judged") & F.forall("given", lambda e: F.coalesce(e["verdict"].isin(*VERDICTS), F.lit(False))))
    # a run's candidates are few: all joins and the window are by run, so that reviews dealt out by run stay where they are
    cited = candidates.groupBy("run_id").agg(F.collect_list(F.struct("hypothesis_id", "evidence_ids")).alias("cited"))
    r = r.join(cited.hint("merge"), "run_id", "left").join(context.hint("merge"), "run_id", "left")
    mine = F.get(F.filter("cited", lambda c: c["hypothesis_id"] == F.col("hid")), F.lit(0))
    r = r.withColumn("evidence_ids", mine["evidence_ids"]).withColumn("known", F.when(mine.isNotNull(), F.lit(True))).drop("cited")
    valid = F.col("formed") & F.coalesce("known", F.lit(False)) & F.col("judged")
    before = F.coalesce(F.sum(valid.cast("int")).over(Window.partitionBy("run_id", "hid").orderBy("item_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    code = F.when(~F.col("formed"), F.lit("malformed_review")).when(F.col("known").isNull(), F.lit("unknown_hypothesis_id")).when(before > 0, F.lit("duplicate_review"))
    r = r.withColumn("code", code.when(~F.col("judged"), F.lit("malformed_review")).otherwise(F.lit("ok")))
    clean = lambda t: sanitised(t, F.col("evidence"), F.col("sources"), F.col("gaps"))
    r = r.withColumn("entries", F.transform("given", lambda e: F.struct(e["name"].alias("name"), e["verdict"].alias("verdict"), clean(e["explanation"]).alias("x")))).withColumn("problems", F.transform("reported", clean))
    kept = F.filter(F.transform("problems", lambda p: p["text"]), lambda t: F.trim(t) != "")
    unsupported = F.filter("unsupported", lambda e: F.coalesce(F.array_contains("evidence_ids", e), F.lit(False)))
    ok = lambda c: F.when(F.col("code") == "ok", c)
    return r.select(
        "run_id", "item_index", "code", ok(F.col("hid")).alias("hypothesis_id"),
        ok(F.map_from_entries(F.transform("entries", lambda e: F.struct(e["name"], F.struct(e["verdict"].alias("verdict"), e["x"]["text"].alias("explanation")))))).alias("checks"),
        ok(unsupported).alias("unsupported_evidence_ids"), ok(kept).alias("substantive_problems"),
        ok((F.size(kept) > 0) | F.exists("entries", lambda e: e["verdict"] == "fail")).alias("has_substantive_problems"),
        ok(F.exists("entries", lambda e: e["x"]["withheld"]) | F.exists("problems", lambda p: p["withheld"])).alias("sanitized"),
    )


def first_revisions(revisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The revision (run_id, item_index, hypothesis_id, ...) that counts for each candidate: the first that names it."""
    n = F.row_number().over(Window.partitionBy("run_id", "hypothesis_id").orderBy("item_index"))
    return revisions.join(candidates.select("run_id", "hypothesis_id").distinct().hint("merge"), ["run_id", "hypothesis_id"], "left_semi").withColumn("_n", n).filter("_n = 1").drop("_n")


def critic_status(candidates: DataFrame, reviews: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, critic_status): completed if every candidate has a valid review, incomplete if some lack one, not_run where
    there are no candidates; where calls (run_id, outcome: ok, failed or not_run) is not ok, that outcome."""
    have = candidates.select("run_id", "hypothesis_id").join(reviews.filter("code = 'ok'").select("run_id", "hypothesis_id", F.lit(1).alias("has")).hint("merge"), ["run_id", "hypothesis_id"], "left")
    per = have.groupBy("run_id").agg(F.count("*").alias("n"), F.count("has").alias("reviewed"))
    status = F.when(F.col("n").isNull(), F.lit("not_run")).when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("n") == F.col("reviewed"), F.lit("completed")).otherwise(F.lit("incomplete"))
    return calls.join(per.hint("merge"), "run_id", "left").select("run_id", status.alias("critic_status"))


def stress_summary(reviewed: Column, critic: Column, revision: Column) -> Column:
    """struct(critic_status, note) of an accepted hypothesis; a hypothesis that a completed critic left out is incomplete."""
    status = F.when(reviewed | critic.isin("not_run", "failed"), critic).otherwise(F.lit("incomplete"))
    note = F.when(status != "completed", F.lit(NOT_TESTED)).when(revision == "revised", F.lit(REVISED)).otherwise(F.lit(COMPLETED))
    return F.struct(status.alias("critic_status"), note.alias("note"))


def safe_stress_summary(reviewed: Column, critic: Column, checks: Column) -> Column:
    """struct(critic_status, critic_verdicts) of a rejected hypothesis: verdicts alone, none of the model's words."""
    status = F.when(reviewed | (critic != "completed"), critic).otherwise(F.lit("incomplete"))
    return F.struct(status.alias("critic_status"), F.transform_values(checks, lambda _, v: v["verdict"]).alias("critic_verdicts"))
