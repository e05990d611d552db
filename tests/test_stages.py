"""Progress in batch and stream, schemas, searches whose bounds reach the scan, list stages in one pass, many questions in one plan."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import schemas
from scholia.operators import list_stage, progress, reviews, scoring, search, synthesis
from scholia.streaming import progress as streamed

EVENTS = "run_id long, seq long, n int, stage string, state string"


def test_batch_and_stream_judge_alike(spark, tmp_path):
    rows = [(1, 1, 0, "define", "running"), (1, 2, 0, "define", "done"), (1, 3, 0, "define", "skipped"), (1, 4, 0, "gaps", "done"), (2, 1, 0, "define", "pending"), (2, 2, 0, "nowhere", "running"), (1, 5, 1, "gaps", "running"), (1, 5, 2, "gaps", "failed")]
    source = tmp_path / "in"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(source))
    want = sorted(map(tuple, progress.judged(spark.createDataFrame(rows, EVENTS)).collect()))
    stream = streamed.judged_stream(spark.readStream.schema(EVENTS).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("judged").select(*progress.judged(spark.createDataFrame(rows, EVENTS)).columns).collect()))
    assert got == want and [r[-1] for r in want] == [True, True, False, True, True, True, False, False]


SCHEMA = T.StructType([T.StructField("kind", T.StringType(), False, {"choices": ["a", "b"]}), T.StructField("items", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType(), True)]), False), False, {"most": 2})])


def test_schema_as_json_and_as_problems(spark):
    assert schemas.json_schema(SCHEMA) == {
        "type": "object", "required": ["kind", "items"], "additionalProperties": False,
        "properties": {"kind": {"type": "string", "enum": ["a", "b"]}, "items": {"type": "array", "maxItems": 2, "items": {
            "type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"anyOf": [{"type": "number"}, {"type": "null"}]}}}}}}
    cases = {'{"kind":"a","items":[{"x":1},{"x":null}]}': None, '{"kind":"c","items":[{"x":"1"},{}]}': "kind: Input should be 'a' or 'b'; items.0.x: Input should be a valid number; items.1.x: Field required",
             '{"kind":"a","items":[],"z":1,"y":2}': "y: Extra inputs are not permitted; z: Extra inputs are not permitted", '"text"': "<root>: Input should be a valid dictionary"}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r[0]: r[1] for r in df.select("j", schemas.validated(F.col("j"), SCHEMA)["summary"]).collect()}
    assert got == cases
    assert spark.createDataFrame([(None,)], "j string").select(schemas.validated(F.col("j"), SCHEMA)["problem"]).first()[0] == "invalid_output_json"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_bounds_of_a_search_reach_the_scan(spark, tmp_path):
    hits = spark.range(5000).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("term"), (1900 + F.col("id") % 120).cast("int").alias("year"), F.lit("x").alias("unused"))
    hits.write.parquet(str(tmp_path / "hits"))
    stored = spark.read.parquet(str(tmp_path / "hits"))
    out = search.searched(stored, "a", 7, 1950, None).select("ordinal", "year")
    pushed = plan(out).split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(term,a)" in pushed and "GreaterThanOrEqual(year,1950)" in pushed and "unused" not in plan(out).split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan(out) and [r[0] for r in out.collect()] == [50, 52, 54, 56, 58, 60, 62]
    assert search.searched(stored, "a", 5000).count() == 1000 and search.searched(stored, "a", -1).count() == 0 and search.searched(stored, "none", 5).count() == 0


def test_list_stage_is_judged_once(spark):
    answers = [(1, '{"items":[{"id":"ev_0001","claim":"a"},{"claim":"no"},{"claim":"a","title":"T"}]}', False), (2, None, None), (3, '```json\n{"items":[]}\n```', True), (4, '{"items":[{"claim":"a"}]}', False), (5, '{"other":[]}', False)]
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: calls.add(1) or x, "string")
    judge = lambda raw: F.when(seen(F.try_variant_get(raw, "$.claim", "string")) == "no", F.array(F.struct(F.lit("bad").alias("code"), F.lit("").alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))
    df = spark.createDataFrame(answers, "run_id int, answer string, repaired boolean")
    out = list_stage.run(df, "items", judge, ("id", "claim"), ("bad",), ("title",), max_items=2, id_field="id")
    assert out.counts == {"returned": 4, "accepted": 2, "rejected": 2, "failed_runs": 2, "rejected_exceeds_item_limit": 1, "rejected_bad": 1}
    before = calls.value
    assert sorted((r["run_id"], r["item_index"], json.loads(r["item"])) for r in out.accepted.collect()) == [(1, 0, {"id": "ev_0001", "claim": "a"}), (4, 0, {"claim": "a"})]
    rejected = {r["item_index"]: r for r in out.rejected.collect()}
    assert rejected[1]["reason_codes"] == ["bad"] and rejected[2]["diagnostics"]["bibliographic_keys"] == ["title"] and "T" not in str(rejected[2]["diagnostics"])
    assert sorted(r["run_id"] for r in out.plan.collect()) == [1, 2, 3, 5] and {r["run_id"]: r["problem"] for r in out.failed.collect()} == {2: "no_answer", 5: "unexpected_field"}
    assert calls.value == before  # nothing is judged again
    assert "status=accepted" not in plan(out.accepted) and "PartitionFilters" in plan(out.accepted)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_enrichment_of_many_questions_equals_one_by_one(spark, limit):
    catalog = (scoring.Concept("widget", ("widget",), True, (), (r"\bwidgets?\b",), (r"\bwidget\w*",)), scoring.Concept("metal", ("metal",), False, (), (r"\bmetal\b",), (r"\bsteel\b",)))
    questions = {1: "Do widgets bend?", 2: "Which metal bends best?"}
    origin = F.array(F.struct(F.col("n").alias("query"), F.lit("pubmed").alias("database"), F.col("n").alias("rank")))
    titles = ["A widget", "Steel bends", "Nothing", "Best steel widget"]
    rows = spark.createDataFrame([(q, f"r{k}", t, k) for q in (1, 2, 3) for k, t in enumerate(titles)], "question_id int, record_id string, title string, n int").withColumn("origins", origin).drop("n")
    abstracts = rows.select("question_id", "record_id", F.lit("steel widget that bends").alias("abstract"))
    many = scoring.enriched(rows, spark.createDataFrame(list(questions.items()), "question_id int, question string"), abstracts, limit, catalog=catalog)
    got = {(r["question_id"], r["record_id"]): (r["base_score"], r["considered"]) for r in many.collect()}
    want = {}
    for q, text in questions.items():
        mine = rows.filter(f"question_id = {q}").withColumn("abstract", F.lit(None).cast("string"))
        best = [r["record_id"] for r in scoring.chosen_for_enrichment(scoring.scored(mine, text, catalog), limit).collect()]
        again = scoring.scored(mine.withColumn("abstract", F.when(F.col("record_id").isin(*best, "-"), F.lit("steel widget that bends"))), text, catalog)
        want |= {(q, r["record_id"]): (r["base_score"], r["record_id"] in best) for r in again.collect()}
    assert got == want
    with pytest.raises(ValueError):
        scoring.enriched(rows, rows, abstracts, -1)


def test_reviews_withhold_what_cites(spark):
    known = lambda *xs: F.array(*[F.lit(x) for x in xs])
    texts = ["fine  text", "see ev_0001", "see ev_9999", "Smith et al. say", None, "x" * 500, "gap_02 is open"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.select(reviews.sanitised(F.col("t"), known("ev_0001"), known(), known("gap_01"))).collect()]
    assert [r["withheld"] for r in got] == [False, False, True, True, True, False, True]
    assert got[0]["text"] == "fine text" and len(got[5]["text"]) == 400 and got[5]["text"].endswith("…") and got[2]["text"] == reviews.WITHHELD


def test_references_of_ids_that_many_rows_have(spark):
    """Evidence texts are compared where they lie: a hypothesis gets back the spans and numbers that were found, no text."""
    ev = spark.createDataFrame([("ev_0001", "rose by 12 mg", None, f"text {k} of many" + " with the words that are quoted" * (k == 39), None) for k in range(40)] + [("ev_0002", "7", "5 mL", None, "other words entirely")],
                               "evidence_id string, claim string, finding string, quote string, source_text string")
    said = ['as "the words that are quoted" 12 mg', 'as "the words that are quoted" and "never said by anyone" 12 mL', 'as "other words entirely" 5 mL and 7, see ev_0002', None]
    h = spark.createDataFrame([(k, ["ev_0001"] if k < 2 else [], None, t, ["x", None]) for k, t in enumerate(said)], "k int, evidence_ids array<string>, alternative_ids array<string>, t string, l array<string>")
    got = {r["k"]: r for r in synthesis.with_references(h, ev, ["t"], ["l"], key="k").collect()}
    assert {k: r["quote_refs"] for k, r in got.items()} == {0: ["the words that are quoted"], 1: ["the words that are quoted"], 2: ["other words entirely"], 3: []}
    assert {k: [(p["value"], p["problem"]) for p in r["number_problems"]] for k, r in got.items()} == {0: [], 1: [("12", "unit_mismatch")], 2: [], 3: []}
    assert got[1].asDict().keys() == {"k", "evidence_ids", "alternative_ids", "t", "l", "quote_refs", "number_problems"}


def test_searches_of_one_term_share_their_ranges(spark):
    """Many searches for one term: each has the first hits of its own years, and no row stands for a search and a hit that it leaves out."""
    hits = [("t" if k % 3 else "u", 1990 + k % 5 if k % 7 else None, k, f"r{k}") for k in range(600)]
    searches = [(k, "tux"[k % 3], k % 9 - 2, 1991 + k % 3 if k % 2 else None, 1992 + k % 2 if k % 5 else None) for k in range(200)]
    out = search.searched_all(spark.createDataFrame(hits, "term string, year int, ordinal long, record_id string"), spark.createDataFrame(searches, "search_id long, term string, most int, from_year int, to_year int"))
    want = set()
    for i, term, most, lo, hi in searches:
        fit = [h for h in hits if h[0] == term and ((lo is None and hi is None) or (h[1] is not None and (lo or 1800) <= h[1] <= (hi or 3000)))]
        want |= {(i, rank, *h) for rank, h in enumerate(sorted(fit, key=lambda h: h[2])[: max(0, most)])}
    assert out.columns == ["search_id", "rank", "term", "year", "ordinal", "record_id"]
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 2
