"""Switches, access, request checks, progress, and the folds over budgets, quotas and rates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from scholia.functions.identity import stripped


def kill_switch(raw: Column) -> Column:
    """On unless unset, blank or false."""
    return ~F.coalesce(F.lower(stripped(raw)), F.lit("")).isin("", "false")


def gate(raw: Column) -> Column:
    return F.coalesce(F.lower(stripped(raw)) == "true", F.lit(False))


def requires_sign_in(raw: Column) -> Column:
    return ~F.coalesce(F.lower(stripped(raw)) == "false", F.lit(False))


def allow_list(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(stripped(x))), lambda x: x != ""))


def access_reason(required: Column, configured: Column, logged_in: Column, verified: Column, email: Column, allowed: Column) -> Column:
    """The first of seven reasons that applies; only auth_not_required and allowed let a user in."""
    return (
        F.when(~required, F.lit("auth_not_required")).when(~configured, F.lit("auth_not_configured")).when(~F.coalesce(logged_in, F.lit(False)), F.lit("anonymous"))
        .when(verified.eqNullSafe(F.lit(False)), F.lit("email_unverified")).when(F.coalesce(email, F.lit("")) == "", F.lit("no_email"))
        .when(F.array_contains(allowed, F.lower(stripped(email))), F.lit("allowed")).otherwise(F.lit("not_allowlisted"))
    )


def availability(killed: Column, open_: Column, credentials: Column, quota_problem: Column, reason: Column) -> Column:
    """What keeps live mode from running, the strongest reason first; available if nothing does."""
    return (
        F.when(killed, F.lit("kill_switch")).when(~open_, F.lit("gate_closed")).when(~credentials, F.lit("missing_credentials")).when(quota_problem.isNotNull(), quota_problem)
        .when(~reason.isin("allowed", "auth_not_required"), reason).otherwise(F.lit("available"))
    )


def request_errors(question: Column, first: Column, last: Column, sources: Column, mode: Column) -> Column:
    """All errors of a request, in order."""
    n = F.length(stripped(F.coalesce(question, F.lit(""))))
    year = lambda c: c.isNotNull() & ~c.between(1800, 2100)
    return F.array_compact(F.array(
        F.when(n == 0, F.lit("question_missing")).when(n < 10, F.lit("question_too_short")).when(n > 2000, F.lit("question_too_long")),
        F.when(year(first), F.lit("from_year")), F.when(year(last), F.lit("to_year")), F.when(first > last, F.lit("year_order")),
        F.when(~F.coalesce(sources.between(1, 20), F.lit(False)), F.lit("max_sources")), F.when(~F.coalesce(mode.isin("demo", "live"), F.lit(False)), F.lit("mode"))))


def last_states(progress: DataFrame, key: str, stage: str, state: str, order: str) -> DataFrame:
    return progress.groupBy(key, stage).agg(F.max_by(state, order).alias(state))


def run_status(budget: Column, auth: Column, degraded: Column) -> Column:
    return F.when(budget, F.lit("budget_exhausted")).when(auth, F.lit("model_auth_error")).when(degraded, F.lit("degraded")).otherwise(F.lit("ok"))


# Kinds of failures that are worth another attempt whatever their status; http_error is where the
# status says so, and auth_error, config_error, parse_error, incomplete, refused, schema_violation, budget_exhausted
# and model_error never are.
RETRYABLE = ("rate_limited", "timeout", "connection_error")


def retryable(kind: Column, http_status: Column) -> Column:
    status = F.coalesce((http_status == 429) | (http_status >= 500), F.lit(False))
    return F.coalesce(kind.isin(*RETRYABLE) | ((kind == "http_error") & status), F.lit(False))


# ---- folds -------------------------------------------------------------------------------------


def quota_decisions(runs: DataFrame, limit: int, window_s: int = 86_400, key: str = "identity", ts: str = "ts", order: tuple[str, ...] = ("ts", "event_id"),
                    keeps_expired: bool = False, future_s: int | None = None) -> DataFrame:
    """(key, the last of order, granted, used, retry_after_s) for every requested run: it is granted if fewer than
    `limit` granted runs lie after its time - window (a run exactly that old is out). Denied runs are not counted.

    Runs come as `order` says, which need not be the order of their times. future_s: stamps that lie further ahead than
    this are not counted. keeps_expired: a denied run leaves the stamps as they were, those that it did not count
    among them; else what has expired is gone for good. A run without a time is denied and changes nothing.

    Each identity's runs pass one task in order; what is held is the stamps in force, `limit` or few more.
    """
    window, ahead, last = window_s * 1_000_000, None if future_s is None else future_s * 1_000_000, order[-1]
    rows = runs.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)])
    dealt = rows.repartition(key).sortWithinPartitions(key, *[f"o{n}" for n in range(len(order))])

    def run(batches):
        at, stamps = object(), []
        for b in batches:
            granted, used, wait = [], [], []
            for who, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if who != at:
                    at, stamps = who, []
                live = [] if t is None else [x for x in stamps if x > t - window and (ahead is None or x <= t + ahead)]
                ok = t is not None and len(live) < limit
                wait.append(None if ok or not live else max(0.0, (sorted(live)[len(live) - limit if keeps_expired else 0] + window - t) / 1e6))
                if ok:
                    stamps = [*live, t]
                elif t is not None and not keeps_expired:
                    stamps = live
                granted.append(ok), used.append(len(live) + ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.num_columns - 1), pa.array(granted, pa.bool_()), pa.array(used, pa.int32()), pa.array(wait, pa.float64())],
                                             [key, last, "granted", "used", "retry_after_s"])

    kind = {f.name: f.dataType for f in runs.schema}
    return dealt.mapInArrow(run, StructType([StructField(key, kind[key]), StructField(last, kind[last]), StructField("granted", BooleanType()),
                                             StructField("used", IntegerType()), StructField("retry_after_s", DoubleType())]))


def rolling_quota(runs: DataFrame, limit: int, window_s: int = 86_400, key: str = "identity", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Decisions on runs in the order of their times, ties by `order`."""
    return quota_decisions(runs, limit, window_s, key, ts, (ts, order))


def quota_of_sql_store(runs: DataFrame, limit: int, window_s: int = 86_400, key: str = "identity", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Runs as they arrive: stamps ahead of the clock count, expired ones are deleted first."""
    return quota_decisions(runs, limit, window_s, key, ts, (order,))


def quota_of_file_store(runs: DataFrame, limit: int, window_s: int = 86_400, key: str = "identity", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Runs as they arrive: stamps over 300 s ahead do not count, and only a granted run rewrites an identity's stamps."""
    return quota_decisions(runs, limit, window_s, key, ts, (order,), keeps_expired=True, future_s=300)


def quota_message_hours(retry_after_s: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(retry_after_s, F.lit(0.0)) / 3600))


def recorded_spend(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """attempts (key, order, input_tokens, output_tokens, cost) with running totals."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return attempts.select(key, order, F.sum("input_tokens").over(w).alias("input_total"), F.sum("output_tokens").over(w).alias("output_total"), F.sum("cost").over(w).alias("spend_total"))


def reserved(attempts: DataFrame, max_attempts: int, max_input: int, max_spend: str | None, key: str, order: str) -> DataFrame:
    """(key, order, granted, stopped_by): each attempt's worst case (estimate, worst_cost) against what is left.

    Refusals are sticky, and reaching a limit by what was recorded stops as well - but for attempts that only
    would have used up `keep` attempts that later stages may need. Actual charges: input_tokens, cost."""
    rows = F.array_sort(F.collect_list(F.struct(order, "estimate", "worst_cost", "input_tokens", "cost", "keep")))
    cap = F.lit(max_spend).cast("decimal(38,10)") if max_spend is not None else F.lit(None).cast("decimal(38,10)")
    money = lambda c: c.cast("decimal(38,10)")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("decimal(38,10)").alias("spend"), F.lit(None).cast("string").alias("stop"),
                     F.array().cast("array<struct<o:bigint,granted:boolean,stopped_by:string>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        why = (
            F.when(s["stop"].isNotNull(), s["stop"]).when(s["n"] + 1 > max_attempts, F.lit("max_attempts")).when(s["n"] + 1 + r["keep"] > max_attempts, F.lit("kept_attempts"))
            .when(s["tokens"] + r["estimate"] > max_input, F.lit("max_input_tokens")).when(s["spend"] + money(r["worst_cost"]) > cap, F.lit("max_spend_usd"))
        )
        ok = why.isNull()
        n = s["n"] + ok.cast("int")
        tokens = s["tokens"] + F.when(ok, r["input_tokens"]).otherwise(F.lit(0))
        spend = money(s["spend"] + F.when(ok, money(r["cost"])).otherwise(F.lit(0).cast("decimal(38,10)")))
        reached = F.when(n >= max_attempts, F.lit("max_attempts")).when(tokens >= max_input, F.lit("max_input_tokens")).when(spend >= cap, F.lit("max_spend_usd"))
        stop = F.coalesce(s["stop"], F.when(ok, reached), F.when(why != "kept_attempts", why))
        row = F.struct(r[order].cast("bigint").alias("o"), ok.alias("granted"), F.when(why == "kept_attempts", F.lit("max_attempts")).otherwise(why).alias("stopped_by"))
        return F.struct(n.alias("n"), tokens.cast("bigint").alias("tokens"), spend.alias("spend"), stop.alias("stop"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = attempts.groupBy(key).agg(rows.alias("r")).select(key, F.explode(F.aggregate("r", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(key, F.col("x.o").alias(order), "x.granted", "x.stopped_by")


def spend_by_source(attempts: DataFrame, key: str) -> DataFrame:
    """(key, cost_source, spend, n)."""
    return attempts.groupBy(key, "cost_source").agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("n"))


def rate_limited(requests: DataFrame, interval_us: int, key: str, ts: str, order: str) -> DataFrame:
    """(key, order, sent_us): when each request goes out if any two of a key lie `interval` apart at least.

    sent_i = max(arrived_i, sent_(i-1) + interval) = i * interval + the greatest of arrived_j - j * interval so far:
    a running maximum instead of a recursion."""
    w = Window.partitionBy(key).orderBy(ts, order)
    n = F.row_number().over(w)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    base = requests.withColumn("_n", n).withColumn("_t", t)
    reach = F.max(F.col("_t") - F.col("_n") * interval_us).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return base.select(key, order, (reach + F.col("_n") * interval_us).alias("sent_us"), F.col("_t").alias("arrived_us"))
