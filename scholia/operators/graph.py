"""The provenance graph: nodes, edges, exclusions, counts, violations, neighbours, DOT text.

`per` names the columns that tell graphs apart, where a table holds many: every relation has them then, and nothing
refers to an item of another graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import bibliographic
from scholia.sources.storage import stored

# Node prefixes, edge directions, id forms. Numbers of evidence are padded to four digits; from 10,000 on they have more.
EVIDENCE_ID = r"ev_(?:[0-9]{4}|[1-9][0-9]{4,})"
PREFIX = {"source": "src", "evidence": "ev", "gap": "gap", "hypothesis": "hyp", "prediction": "pred", "falsification_test": "fals"}
RULES = {"supports": ("source>evidence", "evidence>hypothesis"), "contradicts": ("evidence>evidence",), "motivates": ("evidence>gap",), "addresses": ("hypothesis>gap",),
         "tests": ("prediction>hypothesis", "falsification_test>hypothesis")}
FORMS = {"source": r"^src:rec_[0-9a-f]{16}$", "evidence": rf"^ev:{EVIDENCE_ID}$", "gap": r"^gap:gap_[0-9]{2}$", "hypothesis": r"^hyp:hyp_[0-9]{2}$",
         "prediction": r"^pred:hyp_[0-9]{2}$", "falsification_test": r"^fals:hyp_[0-9]{2}$"}


def node_id(kind: str, item: Column) -> Column:
    return F.concat(F.lit(PREFIX[kind] + ":"), item)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("|", kind, source, target)


Per = tuple[str, ...]


def _all_known(items: DataFrame, key: str, refs: str, known: DataFrame, known_key: str, per: Per = ()) -> DataFrame:
    """(key, n, n_missing): relational division - how many references an item has, and how many dangle."""
    each = items.select(*per, key, F.explode_outer(F.array_distinct(refs)).alias("ref"))
    hit = each.join(known.select(*per, F.col(known_key).alias("ref")).distinct().withColumn("_hit", F.lit(True)), [*per, "ref"], "left")
    return hit.groupBy(*per, key).agg(F.count("ref").alias("n"), F.count_if(F.col("ref").isNotNull() & F.col("_hit").isNull()).alias("n_missing"))


def judged_evidence(evidence: DataFrame, eligible: DataFrame, per: Per = ()) -> DataFrame:
    """evidence (evidence_id, record_id, claim, finding, ...) with excluded_reason."""
    ok = eligible.select(*per, "record_id").distinct().withColumn("_ok", F.lit(True))
    dirty = bibliographic(F.col("claim")) | bibliographic(F.col("finding"))
    reason = (
        F.when(~F.coalesce(F.col("evidence_id").rlike(f"^{EVIDENCE_ID}$"), F.lit(False)), F.lit("invalid_evidence_id"))
        .when(F.col("_ok").isNull(), F.lit("source_not_verified_record")).when(dirty, F.lit("bibliographic_text_in_model_text"))
    )
    return evidence.join(ok, [*per, "record_id"], "left").withColumn("excluded_reason", reason).drop("_ok")


def judged_gaps(gaps: DataFrame, evidence: DataFrame, per: Per = ()) -> DataFrame:
    """gaps (gap_id, supporting, conflicting, gap_statement, why_unresolved) with excluded_reason. A gap needs a
    supporting item, and all its references among the kept evidence."""
    refs = _all_known(gaps.withColumn("_refs", F.concat("supporting", "conflicting")), "gap_id", "_refs", evidence, "evidence_id", per)
    dirty = bibliographic(F.col("gap_statement")) | bibliographic(F.col("why_unresolved"))
    reason = (
        F.when(~F.coalesce(F.col("gap_id").rlike(r"^gap_[0-9]{2}$"), F.lit(False)), F.lit("invalid_gap_id"))
        .when((F.col("n_missing") > 0) | (F.size("supporting") == 0), F.lit("gap_references_missing_evidence")).when(dirty, F.lit("bibliographic_text_in_model_text"))
    )
    return gaps.join(refs, [*per, "gap_id"], "left").withColumn("excluded_reason", reason).drop("n", "n_missing")


def judged_hypotheses(hyps: DataFrame, evidence: DataFrame, gaps: DataFrame, per: Per = ()) -> DataFrame:
    """hyps (hypothesis_id, evidence_ids, alternative_ids, gap_id, hypothesis, prediction, tests) with excluded_reason."""
    refs = _all_known(hyps.withColumn("_refs", F.concat("evidence_ids", "alternative_ids")), "hypothesis_id", "_refs", evidence, "evidence_id", per)
    known = gaps.select(*per, "gap_id").distinct().withColumn("_gap", F.lit(True))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    lacking = blank(F.col("prediction")) | (F.size("tests") < 4) | F.exists("tests", blank)
    dirty = bibliographic(F.col("hypothesis")) | bibliographic(F.col("prediction"))
    reason = (
        F.when(~F.coalesce(F.col("hypothesis_id").rlike(r"^hyp_[0-9]{2}$"), F.lit(False)), F.lit("invalid_hypothesis_id"))
        .when((F.size("evidence_ids") == 0) | (F.col("n_missing") > 0), F.lit("hypothesis_references_missing_evidence"))
        .when(F.col("_gap").isNull(), F.lit("hypothesis_references_missing_gap")).when(lacking, F.lit("hypothesis_missing_prediction_or_falsification"))
        .when(dirty, F.lit("bibliographic_text_in_model_text"))
    )
    return hyps.join(refs, [*per, "hypothesis_id"], "left").join(known, [*per, "gap_id"], "left").withColumn("excluded_reason", reason).drop("n", "n_missing", "_gap")


def build(evidence: DataFrame, gaps: DataFrame, hyps: DataFrame, eligible: DataFrame, per: Per = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, excluded): nodes (node_id, type, item_id); edges (edge_id, type, source, target, recorded_by);
    excluded (item, reason). Only what is kept may be referred to."""
    ev = judged_evidence(evidence, eligible, per)
    ev_ok = ev.filter("excluded_reason IS NULL")
    gp = stored(judged_gaps(gaps, ev_ok, per), "judged-gaps")
    gp_ok = gp.filter("excluded_reason IS NULL")
    hy = stored(judged_hypotheses(hyps, ev_ok, gp_ok, per), "judged-hypotheses")
    hy_ok = hy.filter("excluded_reason IS NULL")

    node = lambda df, kind, col: df.select(*per, node_id(kind, F.col(col)).alias("node_id"), F.lit(kind).alias("type"), F.col(col).alias("item_id"))
    nodes = reduce(DataFrame.unionByName, [
        node(ev_ok.select(*per, "record_id").distinct(), "source", "record_id"), node(ev_ok, "evidence", "evidence_id"), node(gp_ok, "gap", "gap_id"),
        node(hy_ok, "hypothesis", "hypothesis_id"), node(hy_ok, "prediction", "hypothesis_id"), node(hy_ok, "falsification_test", "hypothesis_id")]).distinct()

    edge = lambda df, kind, s, t, by=None: df.select(*per, F.lit(kind).alias("type"), s.alias("source"), t.alias("target"), (by if by is not None else F.lit(None).cast("string")).alias("by"))
    E = lambda c: node_id("evidence", F.col(c))  # noqa: E731, N806
    H = node_id("hypothesis", F.col("hypothesis_id"))  # noqa: N806
    G = node_id("gap", F.col("gap_id"))  # noqa: N806
    sup, con = (gp_ok.select(*per, "gap_id", F.explode(c).alias("e")) for c in ("supporting", "conflicting"))
    pairs = sup.join(con.withColumnRenamed("e", "f"), [*per, "gap_id"]).filter("e != f")  # within one gap: a few ids on either side
    edges = reduce(DataFrame.unionByName, [
        edge(ev_ok, "supports", node_id("source", F.col("record_id")), E("evidence_id")),
        edge(sup, "motivates", E("e"), G), edge(con, "motivates", E("e"), G),
        edge(pairs, "contradicts", F.least(E("e"), E("f")), F.greatest(E("e"), E("f")), F.col("gap_id")),
        edge(hy_ok.select(*per, "hypothesis_id", F.explode("evidence_ids").alias("e")), "supports", E("e"), H),
        edge(hy_ok, "addresses", H, G), edge(hy_ok, "tests", node_id("prediction", F.col("hypothesis_id")), H),
        edge(hy_ok, "tests", node_id("falsification_test", F.col("hypothesis_id")), H)])
    edges = edges.groupBy(*per, "type", "source", "target").agg(F.array_sort(F.collect_set("by")).alias("recorded_by"))
    edges = edges.select(*per, edge_id(F.col("type"), F.col("source"), F.col("target")).alias("edge_id"), "type", "source", "target", "recorded_by")

    out = lambda df, kind, col: df.filter("excluded_reason IS NOT NULL").select(
        *per, F.when(F.col("excluded_reason") == f"invalid_{kind}_id", F.lit(kind)).otherwise(node_id(kind, F.col(col))).alias("item"), F.col("excluded_reason").alias("reason"))
    excluded = out(ev, "evidence", "evidence_id").unionByName(out(gp, "gap", "gap_id")).unionByName(out(hy, "hypothesis", "hypothesis_id"))
    return nodes, edges, excluded


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes and edges by type, zeros included."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([(k,) for k in PREFIX] + [(f"edges_{k}",) for k in RULES], "what string")
    got = nodes.groupBy(F.col("type").alias("what")).count().union(edges.groupBy(F.concat(F.lit("edges_"), "type").alias("what")).count())
    return every.join(got, "what", "left").select("what", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def violations(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, gaps: DataFrame, hyps: DataFrame, eligible: DataFrame, cited: DataFrame | None = None, per: Per = ()) -> DataFrame:
    """(code, item): one query for each rule over a given graph and its inputs; empty: valid."""
    bad = []
    add = lambda df, code, col: bad.append(df.select(*per, F.lit(code).alias("code"), F.col(col).alias("item")))
    form = F.lit(False)
    for kind, pattern in FORMS.items():
        form = form | ((F.col("type") == kind) & F.col("node_id").rlike(pattern))
    add(nodes.filter(~form), "invalid_node_id", "node_id")
    for kind, df, col in (("source", eligible, "record_id"), ("evidence", evidence, "evidence_id"), ("gap", gaps, "gap_id"), ("hypothesis", hyps, "hypothesis_id")):
        add(nodes.filter(F.col("type") == kind).join(df.select(*per, F.col(col).alias("item_id")).distinct(), [*per, "item_id"], "left_anti"), f"unresolved_{kind}", "node_id")
    parents = nodes.filter("type = 'hypothesis'").select(*per, "item_id")
    add(nodes.filter(F.col("type").isin("prediction", "falsification_test")).join(parents, [*per, "item_id"], "left_anti"), "orphan_test_node", "node_id")
    add(edges.filter(~F.col("type").isin(*RULES)), "invalid_edge_type", "edge_id")
    ends = edges.filter(F.col("type").isin(*RULES))
    s, t = (nodes.select(*per, F.col("node_id").alias(end), F.col("type").alias(kind)) for end, kind in (("source", "s_type"), ("target", "t_type")))
    placed = ends.join(s, [*per, "source"], "left").join(t, [*per, "target"], "left")
    add(placed.filter("s_type IS NULL OR t_type IS NULL"), "dangling_edge", "edge_id")
    whole = placed.filter("s_type IS NOT NULL AND t_type IS NOT NULL")
    direction = F.lit(False)
    for kind, ways in RULES.items():
        direction = direction | ((F.col("type") == kind) & F.concat_ws(">", "s_type", "t_type").isin(*ways))
    add(whole.filter(~direction), "invalid_edge_direction", "edge_id")
    fine = whole.filter(direction)
    add(fine.filter(F.col("edge_id") != edge_id(F.col("type"), F.col("source"), F.col("target"))), "invalid_edge_id", "edge_id")
    own = evidence.select(*per, node_id("evidence", F.col("evidence_id")).alias("target"), node_id("source", F.col("record_id")).alias("due"))
    from_source = fine.filter("type = 'supports' AND s_type = 'source'").join(own, [*per, "target"], "left")
    add(from_source.filter(~F.col("source").eqNullSafe(F.col("due"))), "wrong_source_link", "edge_id")
    links = from_source.filter("source = due").groupBy(*per, "target").agg(F.count(F.lit(1)).alias("n"))
    add(nodes.filter("type = 'evidence'").join(links.select(*per, F.col("target").alias("node_id"), "n"), [*per, "node_id"], "left").filter("coalesce(n, 0) != 1"), "evidence_source_link", "node_id")
    set_of = lambda df, key, col: df.groupBy(*per, F.col(key).alias("node_id")).agg(F.array_sort(F.collect_list(col)).alias("have"))
    h = nodes.filter("type = 'hypothesis'").join(hyps.select(*per, F.col("hypothesis_id").alias("item_id"), "evidence_ids", "gap_id"), [*per, "item_id"], "left")
    cites = set_of(fine.filter("type = 'supports' AND s_type = 'evidence'"), "target", "source")
    due = F.array_sort(F.transform("evidence_ids", lambda e: F.concat(F.lit("ev:"), e)))
    add(h.join(cites, [*per, "node_id"], "left").filter(~due.eqNullSafe(F.col("have")) | (F.size("evidence_ids") == 0)), "hypothesis_evidence_links", "node_id")
    add(h.join(set_of(fine.filter("type = 'addresses'"), "source", "target"), [*per, "node_id"], "left").filter(
        ~F.array(F.concat(F.lit("gap:"), "gap_id")).eqNullSafe(F.col("have"))), "hypothesis_gap_link", "node_id")
    add(h.join(set_of(fine.filter("type = 'tests'"), "target", "source"), [*per, "node_id"], "left").filter(
        ~F.array(F.concat(F.lit("fals:"), "item_id"), F.concat(F.lit("pred:"), "item_id")).eqNullSafe(F.col("have"))), "hypothesis_test_links", "node_id")
    add(fine.filter((F.col("type") == "tests") & (F.substring_index("source", ":", -1) != F.substring_index("target", ":", -1))), "test_parent_mismatch", "edge_id")
    said = gaps.select(*per, F.concat(F.lit("gap:"), "gap_id").alias("target"), F.explode(F.array_distinct(F.concat("supporting", "conflicting"))).alias("e")).select(
        *per, "target", F.concat(F.lit("ev:"), "e").alias("source"))
    add(fine.filter("type = 'motivates'").join(said, [*per, "source", "target"], "left_anti"), "unrecorded_motivation", "edge_id")
    noted = gaps.select(*per, "gap_id", "supporting", "conflicting")
    claims = fine.filter("type = 'contradicts'").select(*per, "edge_id", "source", "target", F.explode_outer("recorded_by").alias("gap_id")).join(noted, [*per, "gap_id"], "left")
    a, b = F.substring_index("source", ":", -1), F.substring_index("target", ":", -1)
    clash = (F.array_contains("supporting", a) & F.array_contains("conflicting", b)) | (F.array_contains("supporting", b) & F.array_contains("conflicting", a))
    add(claims.groupBy(*per, "edge_id", "source", "target").agg(F.bool_or(F.coalesce(clash, F.lit(False))).alias("ok")).filter("NOT ok OR source >= target"), "invented_contradiction", "edge_id")
    if cited is not None:
        graph = nodes.filter("type = 'source'").select(*per, "item_id").distinct()
        report = cited.select(*per, F.col("record_id").alias("item_id")).distinct()
        add(graph.join(report, [*per, "item_id"], "left_anti").union(report.join(graph, [*per, "item_id"], "left_anti")), "report_graph_citation_mismatch", "item_id")
    return reduce(DataFrame.unionByName, bad)


def status(n_violations: int, n_excluded: int) -> str:
    return "failed" if n_violations else "passed_with_exclusions" if n_excluded else "passed"


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, direction, edge_type, related): the related nodes of every node, sorted."""
    out = edges.select(F.col("source").alias("node_id"), F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("node_id"), F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("source").alias("other"))
    return nodes.select("node_id").join(out.unionByName(into), "node_id").groupBy("node_id", "direction", "edge_type").agg(F.array_sort(F.collect_list("other")).alias("related"))


def dot_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, the graph in DOT; for display: the caller passes a graph that fits a page."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\"\\])", r"\\$1"), r"\n", " ")
    wrapped = lambda c: F.array_join(F.slice(F.regexp_extract_all(esc(c), F.lit(r".{1,28}(?:\s|$)|.{28}"), F.lit(0)), 1, 3), r"\n")
    n = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("k"), F.concat(F.lit('  "'), esc(F.col("node_id")), F.lit('" [label="'), wrapped(F.col("item_id")), F.lit('"];')).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("edge_id").alias("k"), F.concat(F.lit('  "'), esc(F.col("source")), F.lit('" -> "'), esc(F.col("target")), F.lit('" [label="'), "type", F.lit('"];')).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "line"))), lambda x: x["line"])
    return n.unionByName(e).agg(F.concat(F.lit("digraph evidence {\n"), F.array_join(lines, "\n"), F.lit("\n}")).alias("dot"))


# Names of node types, in the order in which nodes are offered.
TYPE_LABELS = {"source": "Source", "evidence": "Evidence", "gap": "Research gap", "hypothesis": "Hypothesis", "prediction": "Prediction", "falsification_test": "Falsification test"}


def node_options(nodes: DataFrame) -> DataFrame:
    """(type_order, id, label) over nodes (id, type, title): to be ordered by the first two; titles of over 70 code points
    are cut to 69 and an ellipsis."""
    kind, title = F.col("type"), F.coalesce("title", F.lit(""))
    order, name = F.lit(99), kind
    for n, (k, label) in enumerate(TYPE_LABELS.items()):
        order, name = F.when(kind == k, F.lit(n)).otherwise(order), F.when(kind == k, F.lit(label)).otherwise(name)
    short = F.when(F.length(title) > 70, F.concat(F.substring(title, 1, 69), F.lit("…"))).otherwise(title)
    return nodes.select(order.cast("long").alias("type_order"), "id", F.concat(name, F.lit(" · "), F.col("id"), F.lit(" — "), short).alias("label"))
