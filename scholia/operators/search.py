"""Searches over stored hits and stored answers: bounds, skipped items, missing summaries, a run's summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.variants import parsed
from scholia.operators.retrieval import WORK, record_of_work

# The bounds of a search, and the years that stand for an open end.
MOST = 1000
FIRST_YEAR, LAST_YEAR = 1800, 3000
DATABASES = ("pubmed", "crossref")


def clamped(most: Column | int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most) if isinstance(most, int) else most, F.lit(MOST)))


def id_search_parameters(term: Column, most: Column, from_year: Column, to_year: Column) -> Column:
    """struct(term, retmax, datetype, mindate, maxdate) of an id search; the dates are null without any bound."""
    bounded = from_year.isNotNull() | to_year.isNotNull()
    date = lambda year, end: F.when(bounded, F.coalesce(year, F.lit(end)).cast("string"))
    return F.struct(term.alias("term"), clamped(most).alias("retmax"), F.when(bounded, F.lit("pdat")).alias("datetype"), date(from_year, FIRST_YEAR).alias("mindate"), date(to_year, LAST_YEAR).alias("maxdate"))


def works_search_parameters(query: Column, most: Column, from_year: Column, to_year: Column) -> Column:
    """struct(query, rows, filter) of a works search; the filter is null without any bound."""
    bound = lambda name, year: F.concat(F.lit(f"{name}:"), year.cast("string"))
    said = F.concat_ws(",", bound("from-pub-date", from_year), bound("until-pub-date", to_year))
    return F.struct(query.alias("query"), clamped(most).alias("rows"), F.nullif(said, F.lit("")).alias("filter"))


def within(hits: DataFrame, from_year: int | None = None, to_year: int | None = None, year: str = "year") -> DataFrame:
    """hits of the years; a bound on either side leaves hits without a year out. Plain comparisons, which a scan takes over."""
    if from_year is not None:
        hits = hits.filter(F.col(year) >= from_year)
    return hits if to_year is None else hits.filter(F.col(year) <= to_year)


def searched(hits: DataFrame, term: str, most: int, from_year: int | None = None, to_year: int | None = None, order: str = "ordinal") -> DataFrame:
    """One search over stored hits (term, year, order, ...): its first hits, at most `most` of them and MOST at all.
    Term and years go to the scan; a limit after an order is kept by each task for itself."""
    return within(hits.filter(F.col("term") == term), from_year, to_year).orderBy(order).limit(max(0, min(most, MOST)))


def searched_all(hits: DataFrame, searches: DataFrame, order: str = "ordinal") -> DataFrame:
    """Many searches (search_id, term, most, from_year, to_year) at once: (search_id, rank from 0, hits' columns).

    The first hits of a term in each year hold the first hits of any of its ranges of years. Each distinct range is ranked
    once over these, and its list goes to all searches that ask for it: rows follow hits and answers, not their pairs."""
    year, of_range = F.col("year"), ["term", "from_year", "to_year"]
    asked = searches.select("search_id", *of_range, clamped(F.col("most")).alias("_most"))
    ranges = asked.groupBy(*of_range).agg(F.max("_most").alias("_all"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    near = hits.join(ranges.groupBy("term").agg(F.max("_all").alias("_term")), "term").withColumn("_n", place("term", "year")).filter((F.col("_n") <= MOST) & (F.col("_n") <= F.col("_term")))
    fits = (F.col("from_year").isNull() & F.col("to_year").isNull()) | (year.between(F.coalesce("from_year", F.lit(FIRST_YEAR)), F.coalesce("to_year", F.lit(LAST_YEAR))))
    ranked = near.join(ranges, "term").filter(fits).withColumn("rank", place(*of_range) - 1).filter((F.col("rank") < MOST) & (F.col("rank") < F.col("_all")))
    a, r = asked.alias("a"), ranked.select("rank", "from_year", "to_year", *[F.col(c).alias(f"_hit_{c}") for c in hits.columns]).alias("r")
    same = (F.col("a.term") == F.col("r._hit_term")) & F.col("a.from_year").eqNullSafe(F.col("r.from_year")) & F.col("a.to_year").eqNullSafe(F.col("r.to_year")) & (F.col("rank") < F.col("_most"))
    return a.join(r, same).select("search_id", "rank", *[F.col(f"_hit_{c}").alias(c) for c in hits.columns])


def works_found(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of works searches (search_id, answer) as (records, errors, outcomes).

    records (search_id, item_index, record, abstract); errors (search_id, item_index, error_type, message): one for each
    skipped item, one for an answer of another shape; outcomes (search_id, status, records, total): ok, partial if
    items were skipped, failed without any record or for a malformed answer."""
    root = parsed(F.col("answer"))
    items = F.try_variant_get(root, "$.message.items", "array<variant>")
    message = F.try_variant_get(root, "$.message", "map<string,variant>")
    status = F.try_variant_get(root, "$.status", "string")
    problem = (
        F.when(F.try_variant_get(root, "$", "map<string,variant>").isNull(), F.lit("response is not a JSON object"))
        .when(F.coalesce(status, F.lit("ok")) != "ok", F.concat(F.lit("reported status "), F.substring(status, 1, 50)))
        .when(message.isNull(), F.lit("response has no 'message' object")).when(items.isNull(), F.lit("'message.items' is missing or not a list")))
    total = F.to_json(F.try_variant_get(root, "$.message.total-results", "variant"))
    whole = answers.select("search_id", problem.alias("problem"), F.when(problem.isNull(), items).alias("items"), F.when(total.rlike(r"^-?[0-9]+$"), total.cast("long")).alias("total"))
    each = whole.select("search_id", F.posexplode("items").alias("item_index", "item"))
    is_object = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    work = F.from_json(F.to_json("item"), WORK)
    records = each.filter(is_object).select("search_id", "item_index", record_of_work(work).alias("record"), F.nullif(F.trim(work["abstract"]), F.lit("")).alias("abstract"))
    error = lambda df, index, text: df.select("search_id", index.alias("item_index"), F.lit("unexpected_structure").alias("error_type"), text.alias("message"))
    skipped = error(each.filter(~is_object), F.col("item_index"), F.concat(F.lit("skipped malformed item at index "), F.col("item_index").cast("string"), F.lit(" (not an object)")))
    errors = skipped.unionByName(error(whole.filter("problem IS NOT NULL"), F.lit(None).cast("int"), F.col("problem")))
    n = F.size(F.filter("items", lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull()))
    outcome = F.when(F.col("problem").isNotNull(), F.lit("failed")).when(n == F.size("items"), F.lit("ok")).when(n > 0, F.lit("partial")).otherwise(F.lit("failed"))
    return records, errors, whole.select("search_id", outcome.alias("status"), F.when(F.col("problem").isNull(), n).otherwise(0).cast("long").alias("records"), "total")


def summaries_found(ids: DataFrame, docs: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids of searches (search_id, batch, pmid) with the documents (pmid, doc) and the batches that failed (search_id,
    batch, error_type), as (found, errors, outcomes): a document that an answered batch lacks is an error of its own."""
    asked = ids.join(failed.select("search_id", "batch", "error_type"), ["search_id", "batch"], "left").join(docs.select("pmid", "doc"), "pmid", "left")
    answered = F.col("error_type").isNull()
    found = asked.filter(answered & F.col("doc").isNotNull()).select("search_id", "pmid", "doc")
    lost = asked.filter(answered & F.col("doc").isNull()).select("search_id", F.lit("missing_summary").alias("error_type"), F.concat(F.lit("esummary returned no document for PMID "), "pmid").alias("message"))
    errors = lost.unionByName(failed.select("search_id", "error_type", F.concat(F.lit("batch "), F.col("batch").cast("string"), F.lit(" failed")).alias("message")))
    per = asked.groupBy("search_id").agg(F.count_if(answered & F.col("doc").isNotNull()).alias("records"), F.count_if(~answered | F.col("doc").isNull()).alias("bad"))
    status = F.when(F.col("bad") == 0, F.lit("ok")).when(F.col("records") > 0, F.lit("partial")).otherwise(F.lit("failed"))
    return found, errors, per.select("search_id", status.alias("status"), "records")


def run_summary(outcomes: DataFrame, records: DataFrame, unique: DataFrame, verification: DataFrame, errors: DataFrame, key: str = "question_id") -> DataFrame:
    """A row for each investigation of outcomes (key, database, status, total): status, hits and records of each database,
    totals, counts by verification status, errors, and the databases that failed, partly failed or had errors.

    records (key, database) as retrieved, unique (key) after merging, verification (key, status), errors (key, database)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    of = lambda d, c: F.max(F.when(F.col("database") == d, F.col(c)))
    named = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("database"))))
    base = outcomes.groupBy(key).agg(
        *[of(d, "status").alias(f"status_{d}") for d in DATABASES], *[of(d, "total").alias(f"hits_{d}") for d in DATABASES], named("failed").alias("failed_databases"), named("partial").alias("partially_failed_databases"))
    got = records.groupBy(key).agg(F.count("*").alias("total_retrieved"), *[F.count_if(F.col("database") == d).alias(f"retrieved_{d}") for d in DATABASES])
    left = unique.groupBy(key).agg(F.count("*").alias("unique_records"))
    checked = verification.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "partially_verified", "not_verified")])
    bad = errors.groupBy(key).agg(F.count("*").alias("errors_count"), F.array_sort(F.collect_set("database")).alias("databases_with_errors"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [base, got, left, checked, bad])
    counts = ["total_retrieved", *[f"retrieved_{d}" for d in DATABASES], "unique_records", "verified", "partially_verified", "not_verified", "errors_count"]
    none = F.array().cast("array<string>")
    return out.select(key, *[f"status_{d}" for d in DATABASES], *[f"hits_{d}" for d in DATABASES], *[zero(c) for c in counts],
                      (F.coalesce("total_retrieved", F.lit(0)) - F.coalesce("unique_records", F.lit(0))).cast("long").alias("duplicates_merged"), "failed_databases", "partially_failed_databases",
                      F.coalesce("databases_with_errors", none).alias("databases_with_errors"))


def first_seen(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, values): the distinct values of each key in the order in which they first come."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def checked_in_order(ordered: DataFrame, checked: DataFrame, key: str, id_col: str, order: str) -> DataFrame:
    """(key, place from 1, id) of the candidates that were checked, in the candidates' own order, places without gaps."""
    kept = ordered.join(checked.select(key, id_col).distinct(), [key, id_col], "left_semi")
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("place"), id_col)
