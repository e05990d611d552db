"""What a task holds must not grow with the tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import variants
from scholia.operators import dedup, matching, provenance, reviews, scoring
from scholia.plans import catalogue, views


def test_narrow_tables_are_dealt_out(spark, tmp_path):
    spark.range(1, 12_001).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    parts = views.relation(spark, str(tmp_path), "SELECT p_partkey, concat(p_name, '!') AS t FROM part")
    assert parts.rdd.getNumPartitions() == 3
    assert sorted(r.p_partkey for r in parts.collect()) == list(range(1, 12_001))
    assert max(parts.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 6_000
    assert views.relation(spark, str(tmp_path), "SELECT c_custkey FROM customer").rdd.getNumPartitions() == 1


def test_reviews_stay_with_their_run(spark):
    """The reviews, with their texts, are not shuffled by run and hypothesis; a run's candidate is found by its id."""
    review = '{"hypothesis_id":"%s","checks":{' + ",".join(f'"{k}":{{"verdict":"pass","explanation":"fine"}}' for k in reviews.CHECKS) + '},"unsupported_evidence_ids":["e1","e2",3],"substantive_problems":[]}'
    said = spark.createDataFrame([(1, 0, review % "h1"), (1, 1, review % "h9"), (2, 0, review % "h1"), (3, 0, review % "h1")], "run_id long, item_index int, review string")
    candidates = spark.createDataFrame([(1, "h1", ["e1"]), (1, "h2", ["e2"]), (2, "h1", None), (2, None, ["e2"])], "run_id long, hypothesis_id string, evidence_ids array<string>")
    context = spark.createDataFrame([(1, ["e1", "e2"], [], []), (2, [], [], [])], "run_id long, evidence array<string>, sources array<string>, gaps array<string>")
    out = reviews.validated(said.repartition(5, "run_id"), candidates, context)
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert shuffles and not [s for s in shuffles if "hid#" in s]
    assert {(r.run_id, r.item_index): (r.code, r.unsupported_evidence_ids) for r in out.collect()} == {
        (1, 0): ("ok", ["e1"]), (1, 1): ("unknown_hypothesis_id", None), (2, 0): ("ok", []), (3, 0): ("unknown_hypothesis_id", None)}


@pytest.mark.parametrize("name", ["rev_validated", "rev_safe_stress", "rev_stress", "rev_first_revisions"])
def test_reviews_are_not_broadcast(spark, name):
    """Runs, candidates and reviews grow with the table: however small their files are, the driver does not hold them."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_small_groups_are_streamed(spark):
    """Many small investigations and questions pass a task one after the other: no group is a call of its own."""
    n = 3_000
    r = spark.range(n * 2).select(
        (F.col("id") / 2).cast("long").alias("run"), F.col("id").alias("ordinal"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), F.lit("pubmed").alias("source_database"), F.lit("T").alias("title"),
        F.lit(None).cast("int").alias("year"), F.lit("10.1/a").alias("doi"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("journal"), F.array().cast("array<string>").alias("authors"))
    merged = dedup.deduplicated(r, F.col("title"), "run")
    assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {x.ordinal: [p.ordinal for p in x.provenance] for x in merged.collect()} == {2 * i: [2 * i, 2 * i + 1] for i in range(n)}
    with pytest.raises(Exception, match="over 1 records"):
        dedup.deduplicated(r.limit(2), F.col("title"), "run", 1).collect()
    c = r.select(F.when(F.col("run") > 0, F.col("run")).alias("q"), "record_id", F.array(F.lit("x")).alias("concepts"), F.col("ordinal").cast("int").alias("base_score"), F.lit(None).cast("int").alias("best_rank"))
    ranked = scoring.ranked(c, "q", F.array(F.col("record_id")))
    assert "FlatMapGroups" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert {(x.q, x.rank): x.record_id for x in ranked.collect()} == {(i or None, k): f"r{2 * i + 2 - k}" for i in range(n) for k in (1, 2)}
    with pytest.raises(Exception, match="over 1 candidates"):
        scoring.ranked(c, "q", F.array(F.col("record_id")), 1).collect()


def test_a_worker_gives_back_memory_at_the_end(spark, monkeypatch):
    from scholia.llm import common

    class Plan:
        sparkSession = spark

        def mapInArrow(self, fn, schema):
            return fn

    calls = []
    monkeypatch.setattr(common, "freed", lambda: calls.append(1), raising=False)
    assert list(common.in_arrow(Plan(), lambda batches: (b for b in batches), "a long")([1, 2])) == [1, 2] and calls == [1]


def test_runs_are_deleted_before_texts_are_shuffled(spark):
    """op8's table of runs is gone once the marks are written; the result, not yet computed then, is right."""
    import glob

    from scholia.llm import common
    from scholia.llm.substring_dedup import substring_dedup

    words = " ".join(f"w{i}" for i in range(60)) + ". "
    docs = spark.createDataFrame([(1, words * 1 + "one end."), (2, words * 1 + "two end.")], "doc_id long, text string")
    with common.scratch(spark) as path:
        out = substring_dedup(docs)
        assert glob.glob(path.removeprefix("file:") + "/marks-*") and not glob.glob(path.removeprefix("file:") + "/spans-*")
        rows = {r.doc_id: r.n_removed for r in out.collect()}
    assert rows[1] == 0 and rows[2] > 0


def test_an_expansion_tests_the_words_of_asked_facets_alone(spark):
    """A question's words are matched once, by one pattern for each facet that it asks for."""
    q = spark.createDataFrame([(1, "Does shear-induced membrane lipid signaling matter in clotting platelets?"), (2, "Does sleep restore memory"), (3, None)], "question_id long, question string")
    out = scoring.expanded_queries(q)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 60
    assert {(r.question_id, r.query_id): r.plain for r in out.collect() if r.question_id != 1} == {(2, "q1"): "Does sleep restore memory", (3, "q1"): None}
    assert [r.plain for r in out.filter("question_id = 1").orderBy("query_id").collect()][1] == "platelet activation shear stress shear-induced"
    bare = (scoring.Concept("x", ("memory",), False, (), (), ()),)  # a facet without patterns takes its own words alone
    assert {r.plain for r in scoring.expanded_queries(q.filter("question_id = 2"), bare).collect()} == {"Does sleep restore memory", "sleep restore memory"}


def test_a_text_is_hashed_once_for_all_sizes_of_needles(monkeypatch):
    """Grams of twelve sizes cost one pass over a text of twelve steps, and find what a scan for each needle finds."""
    text = "abcabcdefghijklm, \U0001f600 and again abcdefghijklm" * 9
    needles = ["a", "bc", "\U0001f600 an", "defghijk", "abcdefghijkl", "abcdefghijklm, ", "zz", "bcdefghijklmn"]
    grams = {}
    for n in needles:
        size, g = matching._of_needle(n)
        grams.setdefault(size, []).extend(g)
    passes, runs = [], matching._runs
    monkeypatch.setattr(matching, "_runs", lambda t, most: passes.append(most) or runs(t, most))
    sizes = tuple(sorted(grams))
    few = dict(matching._of_text(text, sizes, {n: matching.Known(np.array(g, np.uint64)) for n, g in grams.items()}))
    assert passes == [8]
    every = dict(matching._of_text(text, sizes, None))
    for n in needles:
        size, g = matching._of_needle(n)
        if size < matching.LEAST or n in text:
            assert (set(g) <= set(few[size])) == (set(g) <= set(every[size])) == (n in text), n
    assert dict(matching._of_text("", sizes, None)) == {} and set(dict(matching._of_text("ab", sizes, None))) == {1, 2}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_few_needles_are_looked_for_where_the_texts_lie(spark, monkeypatch):
    """No gram is hashed and no text moves; what is found is what grams find."""
    texts = spark.createDataFrame([(1, "an aé𝒳b text, an aé𝒳b"), (1, "other"), (2, "AN AÉ"), (3, None), (4, "")], "id long, text string")
    needles = spark.createDataFrame([("aé𝒳b",), ("aé𝒳b",), ("an aé𝒳b text, an",), ("o",), ("",), (None,), ("none of them here",)], "needle string")
    few = matching.holding(texts, needles, "id", "text", "needle")
    assert "MapInArrow" not in _plan(few) and "Join" not in _plan(few)
    got = sorted(map(tuple, few.collect()))
    assert got == [(1, "an aé𝒳b text, an"), (1, "aé𝒳b"), (1, "o")]
    assert matching.holding(texts, needles.filter("needle = ''"), "id", "text", "needle").collect() == []
    monkeypatch.setattr(matching, "SCANNED", 0)
    assert sorted(map(tuple, matching.holding(texts, needles, "id", "text", "needle").collect())) == got


def test_a_walk_parses_a_payload_once(spark):
    walk = variants.strings(variants.parsed(F.col("j")), 4)
    assert spark.createDataFrame([('{"a":["x",{"b":"y"}]}',)], "j string").select(walk.alias("s")).collect()[0].s == ["x", "y"]
    assert str(walk).count("parse_json(") == 1


def test_checks_of_graphs_move_digests_of_bodies_and_quotes(spark):
    """Bodies and quotes as long as texts stay where they lie: versions are compared, and quotes and rejected texts met, by digest."""
    body = lambda q, r: '{"claim":"fine","finding":"ok","source_record_id":%s,"verified_quote":%s}' % (r, q)
    rows = [(1, "ev:1", "evidence", "1", body('"q"', '"r"')), (1, "ev:2", "evidence", "2", body('"other"', '"r"')), (1, "ev:3", "evidence", "3", body("null", '"r"')),
            (1, "ev:4", "evidence", "4", body('"q"', "null")), (2, "ev:1", "evidence", "1", body('"q"', '"r"')), (2, "gap:1", "gap", "1", None)]
    schema = "graph_id long, node_id string, type string, item_id string, body string"
    nodes = spark.createDataFrame(rows, schema)
    evidence = spark.createDataFrame([(1, str(k), "r", "fine", "ok", None if k == 3 else "q", "c", "low") for k in (1, 2, 3, 4)] + [(2, "1", "r", "fine", "a text that was accepted", "q", "c", "low")],
                                     "graph_id long, evidence_id string, record_id string, claim string, finding string, quote string, category string, confidence string")
    edges = spark.createDataFrame([(1, "e", "supports", "a", "b", None), (2, "e", "supports", "a", "b", [])], "graph_id long, edge_id string, type string, source string, target string, recorded_by array<string>")
    excluded = spark.createDataFrame([(1, "x", "why")], "graph_id long, item string, reason string")
    records = spark.createDataFrame([], "graph_id long, record_id string, title string, authors array<string>, year int, journal string, doi string, pmid string, source_url string, source_type string")
    versions = spark.createDataFrame([(1, provenance.GRAPH_VERSION), (2, None)], "graph_id long, graph_version string")
    rejected = spark.createDataFrame([(2, "a text that was accepted"), (1, "verified_quote"), (2, "never written"), (2, "verified")], "graph_id long, text string")
    rebuilt = (spark.createDataFrame([(*r[:4], body('"new"', '"r"')) if r[:2] == (2, "ev:1") else r for r in rows], schema), edges.withColumn("recorded_by", F.array().cast("array<string>")), excluded.limit(0))
    out = provenance.violations(nodes, edges, excluded, versions, records, evidence, rejected, rebuilt)
    assert [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "said_quote" in line]
    assert {len(r.line) for r in provenance.digests(nodes, edges, excluded).collect()} == {64}
    assert sorted(map(tuple, out.collect())) == [
        (1, "evidence_mismatch", "ev:2"), (1, "evidence_mismatch", "ev:4"), (1, "not_reproducible", "edge|e"), (1, "not_reproducible", "excluded|x|why"),
        *[(1, "rejected_evidence_present", f"ev:{k}") for k in (1, 2, 3, 4)], (2, "graph_version", ""), (2, "not_reproducible", "node|ev:1")]
