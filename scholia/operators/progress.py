"""How far runs have come: events of stages from the calls that they make, what may follow what, final states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stages in order, the stage that a model call belongs to, and what a stage's state may turn into.
STAGES = ("define", "search", "verify", "extract", "check", "gaps", "hypotheses", "report")
STAGE_OF_CALL = {"question": "define", "extraction": "extract", "gaps": "gaps", "hypotheses": "hypotheses", "hypothesis_critic": "hypotheses", "hypothesis_revision": "hypotheses", "report": "report"}
MOVES = {"pending": ("running", "done", "skipped", "failed"), "running": ("running", "done", "failed"), "done": ("running", "done"), "skipped": ("skipped",), "failed": ("failed",)}


def stage_of(call: Column) -> Column:
    return reduce(lambda c, kv: F.when(call == kv[0], F.lit(kv[1])).otherwise(c), STAGE_OF_CALL.items(), F.lit(None).cast("string"))


def call_events(calls: DataFrame) -> DataFrame:
    """(run_id, seq, n, stage, state) from model calls (run_id, seq, call): where a call belongs to another stage than the one
    before, that one is done (and with extract, check), and the new one is running. Calls of no stage are passed over."""
    known = calls.withColumn("stage", stage_of(F.col("call"))).filter("stage IS NOT NULL")
    known = known.withColumn("before", F.lag("stage").over(Window.partitionBy("run_id").orderBy("seq"))).filter("before IS NULL OR before <> stage")
    event = lambda stage, state: F.struct(stage.alias("stage"), F.lit(state).alias("state"))
    done = F.when(F.col("before").isNotNull(), event(F.col("before"), "done"))
    checked = F.when(F.col("before") == "extract", event(F.lit("check"), "done"))
    return known.select("run_id", "seq", F.posexplode(F.array_compact(F.array(done, checked, event(F.col("stage"), "running")))).alias("n", "e")).select("run_id", "seq", "n", "e.stage", "e.state")


def may_follow(before: Column, after: Column) -> Column:
    return reduce(lambda c, kv: F.when(before == kv[0], after.isin(*kv[1])).otherwise(c), MOVES.items(), F.lit(False))


def judged(events: DataFrame) -> DataFrame:
    """events (run_id, seq, n, stage, state) with before (the stage's last state, pending at first) and legal. An illegal
    event stays a row, and it does move the state: what follows is judged against what was said."""
    order = Window.partitionBy("run_id", "stage").orderBy("seq", "n")
    before = F.coalesce(F.lag("state").over(order), F.lit("pending"))
    return events.withColumn("before", before).withColumn("legal", F.coalesce(F.col("stage").isin(*STAGES) & may_follow(F.col("before"), F.col("state")), F.lit(False)))


def final_states(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, stage, state) of all stages of finished runs (run_id): what never began was skipped, what still ran is done."""
    last = events.groupBy("run_id", "stage").agg(F.max_by("state", F.struct("seq", "n")).alias("state"))
    every = runs.select("run_id", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage")).join(last, ["run_id", "stage"], "left")
    return every.select("run_id", "stage", F.when(F.col("state").isNull() | (F.col("state") == "pending"), F.lit("skipped")).when(F.col("state") == "running", F.lit("done")).otherwise(F.col("state")).alias("state"))
