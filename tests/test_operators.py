"""Operators on hand-made rows: the cases that the tables do not hold."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from scholia.functions import dates, identity, numbers, text
from scholia.operators import control, dedup, evidence, graph, report, scoring, synthesis, texts, verification
from scholia.sources import storage
from scholia.streaming.quota import quota_decisions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("https://doi.org/10.1000/ABC.", "10.1000/abc"), ("doi: https://dx.doi.org/10.1/x", "10.1/x"), ("10.1%2Fa+b", "10.1/a+b"), ("10.1/%zz", "10.1/%zz"), ("10.1/a b", None), ("11.1/a", None), ("", None), (None, None), ("DOI 10.5/é", "10.5/é")])
def test_doi(spark, raw, want):
    assert one(spark, identity.doi(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("PMID: 00123", "123"), (" 7 ", "7"), ("0", None), ("1234567890", None), ("-3", None), ("12a", None), ("pmid#9", "9"), (None, None)])
def test_pmid(spark, raw, want):
    assert one(spark, identity.pmid(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("Müller, Anna", "muller"), ("Smith AB", "smith"), ("Anna van Dam", "dam"), ("O'Neil J", "oneil"), ("Straße", "strasse"), ("  ", None), (None, None)])
def test_surname(name, want):
    assert identity.surname_of(name) == want


def test_identity_key_is_hmac(spark):
    want = "h1:" + hmac.new(b"salt", b"a@b.org", hashlib.sha256).hexdigest()
    assert one(spark, identity.identity_key(F.lit(" A@b.org "), "salt")) == want


@pytest.mark.parametrize("words,want", [
    ("10-20 µM and 3×10^6 cells/mL", [("10", "µM"), ("20", "µM"), ("3000000", "cells/mL")]), ("CD62 at 1,234.50 mg", [("1234.5", "mg")]), ("−5 °C to 37°C", [("-5", "°C"), ("37", "°C")]),
    ("10⁶ and 3D", [("1000000", None)]), ("5 per cent; doi:10.1234/5", [("5", "%")]), ("1e-3 s", [("0.001", "s")]), ("", []),
    ("5 Hours, 7 min/d, 2 percentage", [("5", "h"), ("7", "min/d"), ("2", None)]), ("10 -20 mg", [("10", "mg"), ("20", "mg")]), ("IL-6 and 5HT, 1234,567", [("1234", None)]), ("4 cm^2 or 4 cm2", [("4", "cm2"), ("4", "cm2")]),
    ("2 to 3 °C", [("2", "°C"), ("3", "°C")]), ("10^3, 2 x 10 3 cells/mL", [("1000", None), ("2000", "cells/mL")])])
def test_numbers(words, want):
    assert [(n["value"], n["unit"]) for n in numbers.scan_numbers(words)] == want


def test_missing_numbers(spark):
    df = spark.createDataFrame([("5 mg and 7 and 9 s", "5 mL, 7 kg")], "a string, b string").select(numbers.number_mentions("a").alias("a"), numbers.number_mentions("b").alias("b"))
    got = df.select(numbers.missing_numbers(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert [(m["value"], m["problem"]) for m in got] == [("5", "unit_mismatch"), ("9", "number_not_found")]


def test_markup(spark):
    jats = "<jats:title>Abstract</jats:title><jats:sec><jats:title>Methods:</jats:title><jats:p>H<jats:sub>2</jats:sub>O &amp; <b>x</b></jats:p></jats:sec>"
    assert one(spark, text.markup_text(F.lit(jats))) == "Methods: H2O & x"
    assert one(spark, text.unsafe_xml(F.lit("<!DOCTYPE a [ <!ENTITY x 'y'>]>")))


def test_redaction(spark):
    t = "api_key=abc123&x=1 Authorization: Bearer zz9 bearer abcdefgh1 hunter22"
    out = one(spark, text.redacted_secrets(F.lit(t), literals=("hunter22",)))
    assert "abc123" not in out and "zz9" not in out and "abcdefgh1" not in out and "hunter22" not in out and "x=1" in out


def test_dates(spark):
    now = F.lit(dt.datetime(2015, 10, 21, 7, 27, 50))
    assert one(spark, dates.retry_after(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"), now)) == 10
    assert one(spark, dates.retry_after(F.lit("999"), now)) == 30
    assert one(spark, dates.retry_after(F.lit("later"), now)) is None


def record(n, **k):
    return {"ordinal": n, "record_id": f"r{n}", "source_database": "pubmed", "title": None, "year": None, "doi": None, "pmid": None, "journal": None, "authors": []} | k


def test_dedup_is_an_ordered_fold(spark):
    rows = [
        record(0, doi="10.1/a", title="A study", year=2000, authors=["Smith, J"]), record(1, pmid="5", title="A  Study!", year=2000, authors=["Smith AB"]),
        record(2, pmid="5", doi="10.1/b"), record(3, doi="10.1/b", journal="J"), record(4, title="Other"), record(5, title="Other"), record(6, doi="10.1/a", year=2001),
    ]
    merged = dedup.fold(rows)
    assert [[p["ordinal"] for p in m["provenance"]] for m in merged] == [[0, 1, 6], [2, 3], [4], [5]]
    assert merged[0]["pmid"] == "5" and any(c.startswith("year: kept 2000") for c in merged[0]["conflicts"])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], dedup.RECORD)
    got = dedup.deduplicated(df, identity.ascii_title(F.col("title"))).orderBy("ordinal").collect()
    assert [[p["ordinal"] for p in r["provenance"]] for r in got] == [[0, 1, 6], [2, 3], [4], [5]]
    assert dedup.deduplicated(df.limit(0), identity.ascii_title(F.col("title"))).count() == 0


def test_greedy_order():
    rows = [{"record_id": i, "facets": set(f), "tokens": set(t.split()), "base_score": b, "best_rank": r} for i, f, t, b, r in [
        ("a", "xy", "one two three four", 40, 1), ("b", "xy", "one two three four", 40, 2), ("c", "z", "five six", 30, None), ("d", "", "seven", 30, 9), ("e", "", "", 30, 3)]]
    got = scoring.greedy_order(rows)
    assert [r["record_id"] for r in got] == ["a", "c", "e", "d", "b"]
    assert [r["selection_score"] for r in got] == [64, 42, 30, 15, 5] and got[-1]["dup"] == "a"


def test_backfill_rounds(spark):
    status = ["x", "verified", "x", "x", "verified", "verified", "x"]
    df = spark.createDataFrame([(0, i + 1, s) for i, s in enumerate(status)], "question_id long, position int, status string")
    assert [(r["round"], r["checked_in_round"], r["passed_in_round"]) for r in scoring.verification_rounds(df, 2).orderBy("round").collect()] == [(1, 2, 1), (2, 1, 0), (3, 1, 0), (4, 1, 1)]
    assert [r["position"] for r in scoring.backfilled(df, 2).filter("selected").orderBy("position").collect()] == [2, 5]


def test_unhedged_causal_and_quotes(spark):
    t = "Shear causes death. It may cause harm; drugs trigger it, which induces pain. If so, leads to loss."
    assert one(spark, synthesis.unhedged_causal(F.lit(t))) == 3  # a semicolon ends a hedge's reach
    assert one(spark, synthesis.untraceable_quotes(F.lit('He said "exactly these words" and "short"'), F.array(F.lit("with exactly these words")))) == 0
    assert one(spark, synthesis.untraceable_quotes(F.lit("“not in there at all”"), F.array(F.lit("x")))) == 1


def test_support_never_rises(spark):
    s = lambda ok, label: one(spark, evidence.support(F.lit(ok), F.lit(label).cast("string")))["final_status"]
    assert [s(False, "supported"), s(True, None), s(True, "supported"), s(True, "odd")] == ["rejected", "accepted", "accepted", "downgraded"]


def test_verification_combines(spark):
    rows = [(1, "doi", "resolved", "verified", []), (1, "pmid", "not_found", "not_verified", ["not_found"]), (2, "doi", "lookup_failed", "not_verified", ["lookup_failed"]), (3, None, None, None, None), (4, "doi", "resolved", "verified", []), (4, "pmid", "lookup_failed", "not_verified", ["lookup_failed"])]
    df = spark.createDataFrame(rows, "record_id long, kind string, outcome string, status string, reasons array<string>")
    got = {r["record_id"]: (r["status"], r["reasons"]) for r in verification.combined_checks(df).collect()}
    assert got == {1: ("partially_verified", ["pmid:not_found"]), 2: ("not_verified", ["lookup_failed", "doi:lookup_failed"]), 3: ("not_verified", ["no_identifier"]), 4: ("verified", ["pmid:lookup_failed"])}
    assert verification.similarity_ratio.func is not None


def test_admission_frees_failed_slots(spark):
    df = spark.createDataFrame([(0, i, "verified", "1" if i % 2 else None, s) for i, s in enumerate(["ok", "fetch_failed", "ok", "ok", "ok"])], "question_id long, ordinal long, eligibility string, pmid string, fetched_status string")
    got = {r["ordinal"]: r["status"] for r in texts.admitted(df, 2).collect()}
    assert got == {1: "fetch_failed", 3: "ok", 0: "ok", 2: "source_limit", 4: "source_limit"}


def test_graph_rules_find_each_fault(spark):
    ev = spark.createDataFrame([("ev_0001", "rec_" + "a" * 16, "c", "f"), ("ev_0002", "rec_" + "b" * 16, "c", "f")], "evidence_id string, record_id string, claim string, finding string")
    gaps = spark.createDataFrame([("gap_01", ["ev_0001"], ["ev_0002"], "g", "w")], "gap_id string, supporting array<string>, conflicting array<string>, gap_statement string, why_unresolved string")
    hyps = spark.createDataFrame([("hyp_01", ["ev_0001"], [], "gap_01", "h", "p", ["a", "b", "c", "d"])], "hypothesis_id string, evidence_ids array<string>, alternative_ids array<string>, gap_id string, hypothesis string, prediction string, tests array<string>")
    nodes, edges, excluded = (storage.stored(x, "t") for x in graph.build(ev, gaps, hyps, ev))
    assert nodes.count() == 8 and edges.count() == 9 and excluded.count() == 0
    check = lambda n, e: {r["code"] for r in graph.violations(n, e, ev, gaps, hyps, ev).collect()}
    assert check(nodes, edges) == set()
    wrong = edges.withColumn("target", F.when(F.col("type") == "contradicts", F.lit("gap:gap_01")).otherwise(F.col("target")))
    assert "invalid_edge_direction" in check(nodes, wrong)
    spoilt = edges.withColumn("recorded_by", F.array().cast("array<string>"))
    assert check(nodes, spoilt) == {"invented_contradiction"}
    assert graph.status(0, 1) == "passed_with_exclusions"


def test_graph_of_over_ten_thousand_items(spark):
    """Numbers of evidence have four digits up to 9,999 and more from there on; none is padded beyond four."""
    ids = ["ev_9999", "ev_10000", "ev_123456", "ev_00001", "ev_12", "ev_x"]
    rec = lambda k: "rec_" + f"{k:016x}"
    ev = spark.createDataFrame([(e, rec(k), "claim", "finding") for k, e in enumerate(ids)], "evidence_id string, record_id string, claim string, finding string")
    got = {r["evidence_id"]: r["excluded_reason"] for r in graph.judged_evidence(ev, ev).collect()}
    assert got == dict.fromkeys(ids[:3]) | dict.fromkeys(ids[3:], "invalid_evidence_id")
    nodes = ev.select(F.concat(F.lit("ev:"), "evidence_id").alias("node_id")).filter(F.col("node_id").rlike(graph.FORMS["evidence"]))
    assert sorted(r[0] for r in nodes.collect()) == ["ev:ev_10000", "ev:ev_123456", "ev:ev_9999"]


def test_quota_boundary_and_stream(spark, tmp_path):
    day = dt.timedelta(days=1)
    t0 = dt.datetime(2024, 1, 1, 12)
    runs = [(1, t0, 1), (1, t0 + day / 2, 2), (1, t0 + day - dt.timedelta(microseconds=1), 3), (1, t0 + day, 4), (2, t0, 5)]
    df = spark.createDataFrame(runs, "identity long, ts timestamp, event_id long")
    want = {1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r["event_id"]: r["granted"] for r in control.rolling_quota(df, 2).collect()} == want
    df.write.parquet(str(tmp_path / "runs"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "runs")).withWatermark("ts", "1 hour")
    q = quota_decisions(stream, 2).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["granted"] for r in spark.table("decided").collect()} == want


def test_reserve_is_sticky_but_for_kept_attempts(spark):
    rows = [(0, 1, 10, 0, 10, 0, 3), (0, 2, 10, 0, 10, 0, 0), (0, 3, 500, 0, 500, 0, 0), (0, 4, 1, 0, 1, 0, 0)]
    df = spark.createDataFrame(rows, "run long, n long, estimate long, worst_cost long, input_tokens long, cost long, keep long")
    got = [(r["granted"], r["stopped_by"]) for r in control.reserved(df, 3, 100, None, "run", "n").orderBy("n").collect()]
    assert got == [(False, "max_attempts"), (True, None), (False, "max_input_tokens"), (False, "max_input_tokens")]


def test_leaks_in_escaped_forms(spark):
    t = spark.createDataFrame([("a", r"x \*secret\* y"), ("b", 'say \\"hi there\\"'), ("c", "nothing")], "path string, text string")
    n = spark.createDataFrame([("*secret*",), ('"hi there"',), ("",)], "needle string")
    assert {tuple(r) for r in report.leaks(t, n).collect()} == {("a", "*secret*"), ("b", '"hi there"')}


def test_run_directories_and_stages(spark, tmp_path):
    a, b = (storage.run_directory(spark, str(tmp_path), "20240101T000000Z") for _ in range(2))
    assert a.endswith("Z") and b.endswith("Z-2")
    storage.write_stage(spark.createDataFrame([(1, None)], "b int, a string"), a, "sources")
    assert [r["value"] for r in spark.read.text(f"{a}/sources").collect()] == ['{"a":null,"b":1}']
    assert storage.output_files(spark, a).count() >= 1


@pytest.mark.parametrize("given,want", [
    ("password=a1 secret=b&xai_api_key=c tool=d", "password=[REDACTED] secret=[REDACTED]&xai_api_key=[REDACTED] tool=d"),
    ("Bearer abcdefg1, bearer bonds are safe", "Bearer [REDACTED], bearer bonds are safe"),
    ("Authorization: Basic dXNlcg, next", "Authorization: Basic [REDACTED], next"), ("x-api-key=\"k9\" rest", "x-api-key=\"[REDACTED]\" rest"),
    ("authorization=zz; Authorization: Bearer abc12345", "authorization=[REDACTED]; Authorization: Bearer [REDACTED]"), ("key xai-" + "A1" * 8 + " end xai-short", "key [REDACTED] end xai-short")])
def test_secrets_in_text(spark, given, want):
    assert one(spark, text.redacted_secrets(F.lit(given))) == want


def test_sensitive_parameters(spark):
    url = "https://h.org/a?db=x&api_key=K&TOKEN=t&tool=me&password=p&email=a%40b.org#f"
    assert one(spark, text.redacted_url(F.lit(url))) == "https://h.org/a?db=x&api_key=[REDACTED]&TOKEN=[REDACTED]&tool=me&password=[REDACTED]&email=[REDACTED]#f"
