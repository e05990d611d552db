"""Search hits: parsing, interleaved merging over queries, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.identity import blank_to_null, doi, pmid


def interleaved(hits: DataFrame, most: int, per: list[str]) -> DataFrame:
    """hits with position and owner decided: one result list for each group of `per` (an investigation and a
    database), rank by rank over its queries.

    hits: per, query (number in plan order), rank (from 0), record_id and any further columns. A record belongs
    to the query that lists it first in that order; other queries' hits of it are left out, repeats within its
    own query stay. At most `most` rows of a group are kept.
    """
    owner = F.min(F.struct("rank", "query")).over(Window.partitionBy(*per, "record_id"))
    owned = hits.withColumn("_owner", owner).filter(F.col("_owner.query") == F.col("query")).drop("_owner")
    place = F.row_number().over(Window.partitionBy(*per).orderBy("rank", "query"))
    return owned.withColumn("position", place).filter(F.col("position") <= most)


def query_status(statuses: DataFrame, key: str = "database") -> DataFrame:
    """Roll-up of per-query statuses: ok if all are, failed if all are, else partial."""
    ok, failed = F.every(F.col("status") == "ok"), F.every(F.col("status") == "failed")
    return statuses.groupBy(key).agg(F.when(ok, F.lit("ok")).when(failed, F.lit("failed")).otherwise(F.lit("partial")).alias("status"))


def contributed(hits: DataFrame, merged: DataFrame, per: list[str]) -> DataFrame:
    """(per, query, retrieved, contributed) for each query."""
    got = merged.groupBy(*per, "query").agg(F.count(F.lit(1)).alias("contributed"))
    return hits.groupBy(*per, "query").agg(F.count(F.lit(1)).alias("retrieved")).join(got, [*per, "query"], "left").select(
        *per, "query", "retrieved", F.coalesce("contributed", F.lit(0).cast("long")).alias("contributed"))


def query_number(query_id: Column) -> Column:
    """The number in an id such as q10; ids of another form come after all numbers."""
    digits = F.regexp_extract(query_id, r"^q*([0-9]+)$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("long")), F.lit(1_000_000).cast("long"))


def in_query_order(ids: Column) -> Column:
    """An array of query ids by their numbers; equal numbers stay in the order given."""
    keyed = F.transform(ids, lambda x, i: F.struct(query_number(x).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def summary(hits: DataFrame, statuses: DataFrame, unique: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, total_retrieved, unique_records, duplicates_merged, failed_databases, partially_failed_databases) of each
    investigation; hits (key, database), statuses (key, database, status), unique (key): a row for each merged record."""
    got = hits.groupBy(key).agg(F.count(F.lit(1)).alias("total_retrieved"))
    left = unique.groupBy(key).agg(F.count(F.lit(1)).alias("unique_records"))
    named = lambda status: F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("database"))))
    bad = statuses.groupBy(key).agg(named("failed").alias("failed_databases"), named("partial").alias("partially_failed_databases"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return bad.join(got, key, "left").join(left, key, "left").select(
        key, zero(F.col("total_retrieved")).alias("total_retrieved"), zero(F.col("unique_records")).alias("unique_records"),
        (zero(F.col("total_retrieved")) - zero(F.col("unique_records"))).alias("duplicates_merged"), "failed_databases", "partially_failed_databases")


def search_status(n_ids: Column, n_docs: Column, n_errors: Column) -> Column:
    """ok without errors, failed with errors and nothing found, else partial."""
    return F.when(n_errors == 0, F.lit("ok")).when((n_docs == 0) & (n_ids == 0), F.lit("failed")).otherwise(F.lit("partial"))


def origins(provenance: DataFrame, hits: DataFrame) -> DataFrame:
    """(record_id, origins): distinct (query, database, rank) of every id that a merged record has.

    provenance: record_id, source_record_id."""
    found = provenance.join(hits.select(F.col("record_id").alias("source_record_id"), "query", "database", "rank"), "source_record_id", "left")
    origin = F.when(F.col("query").isNotNull(), F.struct("query", "database", "rank"))
    return found.groupBy("record_id").agg(F.array_sort(F.collect_set(origin)).alias("origins"))


def lookups(ids: DataFrame, answers: DataFrame, failed: DataFrame, key: str = "identifier") -> DataFrame:
    """(identifier, outcome): resolved, not_found, or lookup_failed where the request failed. Each id once."""
    asked = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    out = asked.join(answers.withColumn("_hit", F.lit(True)), key, "left").join(failed.select(key).distinct().withColumn("_bad", F.lit(True)), key, "left")
    outcome = F.when(F.col("_bad"), F.lit("lookup_failed")).when(F.col("_hit"), F.lit("resolved")).otherwise(F.lit("not_found"))
    return out.withColumn("outcome", outcome).drop("_hit", "_bad")


def batched(ids: DataFrame, order: str, size: int = 200) -> DataFrame:
    """ids with the number of the request batch that asks for each; order: an ordinal from 0 without gaps."""
    return ids.withColumn("batch", F.floor(F.col(order) / size).cast("int"))


# ---- payloads ----------------------------------------------------------------------------------

SUMMARY = (
    "struct<uid:string,title:string,pubdate:string,sortpubdate:string,source:string,fulljournalname:string,error:string,"
    "authors:array<struct<name:string,authtype:string>>,articleids:array<struct<idtype:string,value:string>>,pubtype:array<string>>"
)
WORK = (
    "struct<DOI:string,title:array<string>,`container-title`:array<string>,author:array<struct<family:string,given:string,name:string>>,"
    "URL:string,issued:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,"
    "`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,"
    "type:string,subtype:string,publisher:string,institution:array<struct<name:string>>,abstract:string>"
)


def parse_id_search(payload: Column) -> Column:
    """struct(ids, total, problem) of an id-search answer: distinct ids in order; problem names what is wrong
    with a malformed answer."""
    body = F.from_json(payload, "struct<esearchresult:struct<count:string,idlist:array<string>,ERROR:string>>")
    result = body["esearchresult"]
    ids = F.transform(result["idlist"], pmid)
    problem = (
        F.when(result.isNull(), F.lit("no result object"))
        .when(result["ERROR"].isNotNull(), F.lit("reported error"))
        .when(result["idlist"].isNull(), F.lit("no id list"))
        .when(F.exists(ids, lambda x: x.isNull()), F.lit("not an id"))
    )
    total = F.when(result["count"].rlike("^[0-9]+$"), result["count"].cast("bigint"))
    return F.struct(F.when(problem.isNull(), F.array_distinct(ids)).alias("ids"), F.when(problem.isNull(), total).alias("total"), problem.alias("problem"))


def record_of_summary(id_: Column, doc: Column) -> Column:
    """A record out of a document summary (type SUMMARY)."""
    from scholia.functions.dates import leading_year

    people = F.filter(doc["authors"], lambda a: F.coalesce(a["authtype"], F.lit("Author")).eqNullSafe("Author") & blank_to_null(a["name"]).isNotNull())
    dois = F.array_compact(F.transform(F.filter(doc["articleids"], lambda i: F.lower(i["idtype"]) == "doi"), lambda i: doi(i["value"])))
    return F.struct(
        blank_to_null(doc["title"]).alias("title"),
        F.coalesce(F.transform(people, lambda a: F.trim(a["name"])), F.array().cast("array<string>")).alias("authors"),
        leading_year(doc["pubdate"], doc["sortpubdate"]).alias("year"),
        F.try_element_at(dois, F.lit(1)).alias("doi"),
        id_.alias("pmid"),
        F.coalesce(blank_to_null(doc["fulljournalname"]), blank_to_null(doc["source"])).alias("journal"),
        F.lit("pubmed").alias("source_database"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), id_, F.lit("/")).alias("source_url"),
    )


def record_of_work(work: Column) -> Column:
    """A record out of a registered work (type WORK). Organisations are no authors."""
    from scholia.functions.dates import first_year

    first = lambda c: F.try_element_at(F.filter(F.transform(c, blank_to_null), lambda x: x.isNotNull()), F.lit(1))
    people = F.filter(work["author"], lambda a: blank_to_null(a["family"]).isNotNull())
    name = lambda a: F.concat_ws(", ", blank_to_null(a["family"]), blank_to_null(a["given"]))
    year = lambda k: work[k]["date-parts"][0][0]
    own = doi(work["DOI"])
    return F.struct(
        first(work["title"]).alias("title"),
        F.coalesce(F.transform(people, name), F.array().cast("array<string>")).alias("authors"),
        first_year(*[year(k) for k in ("issued", "published", "published-print", "published-online")]).alias("year"),
        own.alias("doi"),
        F.lit(None).cast("string").alias("pmid"),
        first(work["container-title"]).alias("journal"),
        F.lit("crossref").alias("source_database"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), own), work["URL"]).alias("source_url"),
    )
