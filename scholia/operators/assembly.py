"""Whole reports, ten sections each, of many investigations at once.

A report is a relation of pieces (report_id, section, line, piece, text, record_id): its text in order, some pieces naming
the source that they cite. Citation numbers follow from the order of the pieces, across sections; the list of sources is
made of the numbers; and one aggregation of a report's pieces, in order, is its text. Everything is keyed by report_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import markdown_escaped as md
from scholia.operators.evidence import CITATION_CODES, NUMERIC_CODES, QUOTE_CODES
from scholia.operators.report import SECTIONS, citation_line, unresolved_marker
from scholia.operators.sources_of import badge
from scholia.sources.storage import stored

# What a report says where it has nothing to tell, and names of its parts.
NO_FINDINGS = "No validated evidence; no key findings can be stated."
NO_EVIDENCE, NO_CONFLICT, NO_GAPS = "No accepted evidence records.", "None identified in the validated evidence.", "No validated research gaps."
NO_HYPOTHESES, NO_SOURCES = "No candidate hypotheses passed the deterministic checks.", "No sources cited."
ABSTRACTS_ONLY = "- All evidence comes from abstracts only (no full text); methods and limitations may be incomplete."
DISCLAIMER = "_Unvalidated, AI-generated hypotheses for further investigation — not validated discoveries and not scientific findings._"
MATRIX = "| Evidence | Claim | Supporting quote (verbatim) | Category | Confidence | Source | Source type |\n|---|---|---|---|---|---|---|"
FULL_TEXT = "- Obtain and read the full text of the cited sources (this report used abstracts only)."
DESIGN = "- Design studies that test the candidate hypotheses in H against their predictions and falsification tests."
SEARCH_GAPS = "- Search specifically for evidence addressing the research gaps in G."
CHECK_NAMES = {"exact_quote": "Exact-quote check", "numeric_consistency": "Numeric-consistency check", "citation_validation": "Citation/id validation"}
NO_SEMANTIC = "- Semantic (model-based) claim check: not implemented — no semantic claim check ran."
A, B, C, D, E, G, H, I, J = 1, 2, 3, 4, 5, 7, 8, 9, 10
LIMITS = 6
NARRATIVE = {"key_findings": C, "conflicting_evidence": E, "limitations": LIMITS, "next_steps": I}

_PIECE = ["report_id", "section", "line", "piece", "text", "record_id"]


def _said(df: DataFrame, section: Column | int, line: Column | int, *texts: Column | str, piece: int = 0) -> DataFrame:
    """A piece of the texts, one after the other, for each row."""
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return df.select("report_id", lit(section, "int").alias("section"), lit(line, "long").alias("line"), F.lit(piece).alias("piece"),
                     F.concat(*[lit(t, "string") for t in texts]).alias("text"), F.lit(None).cast("string").alias("record_id"))


def _cited(df: DataFrame, ids: str, evidence: DataFrame, section: Column | int, line: Column | int, piece: int) -> DataFrame:
    """Pieces `ev_0001 [S1], ev_0002 [S2]` for the known ids of a column, in its order; `none` where none is known."""
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    asked = df.select("report_id", lit(section, "int").alias("section"), lit(line, "long").alias("line"), F.posexplode_outer(ids).alias("at", "evidence_id"))
    known = asked.join(evidence.select("report_id", "evidence_id", "record_id"), ["report_id", "evidence_id"], "left")
    place = Window.partitionBy("report_id", "section", "line").orderBy(F.col("record_id").isNull(), "at")
    n = known.withColumn("n", F.row_number().over(place)).filter("record_id IS NOT NULL OR n = 1")
    text = F.when(F.col("record_id").isNull(), F.lit("none")).otherwise(F.concat(F.when(F.col("n") > 1, F.lit(", ")).otherwise(F.lit("")), "evidence_id", F.lit(" ")))
    return n.select("report_id", "section", "line", (F.lit(piece) + F.col("n") - 1).cast("int").alias("piece"), text.alias("text"), "record_id")


def _if_none(reports: DataFrame, rows: DataFrame, section: int, text: str) -> DataFrame:
    return _said(reports.join(rows.select("report_id").distinct(), "report_id", "left_anti"), section, 0, text)


def _paragraphs(paragraphs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Lines of the narrative, each in its section: label, text, evidence, and the sources that it names itself."""
    at = reduce(lambda c, kv: F.when(F.col("in") == kv[0], F.lit(kv[1])).otherwise(c), NARRATIVE.items(), F.lit(None).cast("int"))
    p = paragraphs.withColumnRenamed("section", "in").withColumn("section", at).withColumn("line", F.lit(1_000_000).cast("long") + F.col("ordinal"))
    section, line = F.col("section"), F.col("line")
    own = p.select("report_id", "section", "line", F.posexplode("source_ids").alias("at", "record_id")).select(
        "report_id", "section", "line", (F.lit(500_000) + F.col("at")).cast("int").alias("piece"), F.when(F.col("at") == 0, F.lit("; sources: ")).otherwise(F.lit(", ")).alias("text"), "record_id")
    return reduce(DataFrame.unionByName, [_said(p, section, line, "- **[", F.col("label"), "]** ", md(F.trim("text")), " — evidence: "), _cited(p, "evidence_ids", evidence, section, line, 1), own])


def check_lines(rejected: DataFrame, accepted: DataFrame, reports: DataFrame) -> DataFrame:
    """(report_id, family, checked, passed, failed) of each deterministic check. rejected (report_id, kind: evidence or
    synthesis, reason_codes), accepted (report_id, kind, n). Malformed items are not checked; quotes are checked of evidence alone."""
    families = {"exact_quote": (QUOTE_CODES, ("evidence",)), "numeric_consistency": (NUMERIC_CODES, ("evidence", "synthesis")), "citation_validation": (CITATION_CODES, ("evidence", "synthesis"))}
    bad = rejected.filter(~F.array_contains("reason_codes", "malformed_item"))
    out = []
    for name, (codes, kinds) in families.items():
        fails = F.arrays_overlap("reason_codes", F.array(*[F.lit(c) for c in codes]))
        no = bad.filter(F.col("kind").isin(*kinds)).groupBy("report_id").agg(F.count("*").alias("turned"), F.count_if(fails).alias("failed"))
        yes = accepted.filter(F.col("kind").isin(*kinds)).groupBy("report_id").agg(F.sum("n").alias("taken"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        every = reports.select("report_id").join(no, "report_id", "left").join(yes, "report_id", "left").withColumn("checked", zero("turned") + zero("taken"))
        out.append(every.select("report_id", F.lit(name).alias("family"), "checked", (F.col("checked") - zero("failed")).alias("passed"), zero("failed").alias("failed")))
    return reduce(DataFrame.unionByName, out)


def citations(pieces: DataFrame, records: DataFrame) -> DataFrame:
    """(report_id, record_id, n, resolved, marker) of every source that the pieces cite: S1, S2, ... over those with a record
    (report_id, record_id) in order of first use, the others marked unresolved."""
    first = pieces.filter("record_id IS NOT NULL").groupBy("report_id", "record_id").agg(F.min(F.struct("section", "line", "piece")).alias("first"))
    known = first.join(records.select("report_id", "record_id", F.lit(True).alias("ok")).distinct(), ["report_id", "record_id"], "left")
    n = F.row_number().over(Window.partitionBy("report_id", "ok").orderBy("first"))
    c = known.withColumn("n", n).withColumn("resolved", F.coalesce("ok", F.lit(False)))
    # after all numbered sources the unresolved ones would break the order of first use: the list keeps it
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("first"))
    return c.select("report_id", "record_id", "n", "resolved", place.alias("place"), F.when(F.col("resolved"), F.concat(F.lit("S"), F.col("n").cast("string"))).otherwise(unresolved_marker(F.col("record_id"))).alias("marker"))


def type_counts(cited: DataFrame, records: DataFrame) -> DataFrame:
    """(report_id, badge, n): how many of the resolved citations are of each source type."""
    return cited.filter("resolved").join(records, ["report_id", "record_id"]).groupBy("report_id", badge(F.col("source_type")).alias("badge")).agg(F.count("*").alias("n"))


def assembled(
    reports: DataFrame, databases: DataFrame, evidence: DataFrame, gaps: DataFrame, hyps: DataFrame, paragraphs: DataFrame, records: DataFrame, rejected: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(texts, cited): texts (report_id, report), cited as citations() gives it.

    reports (report_id, question, restatement: null without a definition, scope, from_year, to_year, unique_records);
    databases (report_id, database, status, hits, retrieved); evidence (evidence_id, ordinal, record_id, claim, quote,
    category, confidence); gaps (gap_id, label, gap_statement, why_unresolved, confidence, supporting, conflicting);
    hyps (hypothesis_id, hypothesis, level, supported_level, rationale, prediction, gap_id, evidence_ids, limitations,
    confidence, critic_status, note); paragraphs (ordinal, section, label, text, evidence_ids, source_ids); records (the
    fields of a citation, source_type, verification_status); rejected (kind, reason_codes): all with report_id."""
    c, or_ = F.col, lambda x, text: F.coalesce(x.cast("string"), F.lit(text))
    seq = lambda order: F.row_number().over(Window.partitionBy("report_id").orderBy(order)).cast("long")
    ev, gp, hy, db = evidence.withColumn("line", seq("ordinal")), gaps.withColumn("line", seq("gap_id")), hyps.withColumn("line", seq("hypothesis_id") * 20), databases.withColumn("line", seq("database"))
    line = c("line")
    heads = [_said(reports, n + 1, -1, f"\n## {t}\n") for n, t in enumerate(SECTIONS)]
    defined, raw = reports.filter("restatement IS NOT NULL"), reports.filter("restatement IS NULL")
    pieces = [
        _said(reports, 0, 0, "# Research report"), *heads,
        _said(reports, A, 0, "- **Question (verbatim):** ", md(c("question"))),
        _said(defined, A, 1, "- **Restatement (model-proposed):** ", md(c("restatement"))), _said(defined, A, 2, "- **Scope (model-proposed):** ", md(or_(c("scope"), ""))),
        _said(raw, A, 1, "- Question definition unavailable; the raw question was used."),
        _said(reports, B, 0, "- **Year filter:** from ", or_(c("from_year"), "any"), " to ", or_(c("to_year"), "any")),
        _said(db, B, line, "- **", c("database"), ":** status ", or_(c("status"), "n/a"), ", hits reported ", or_(c("hits"), "n/a"), ", candidates retrieved ", or_(c("retrieved"), "n/a")),
        _said(reports, B, 1_000, "- **Unique records after deduplication:** ", or_(c("unique_records"), "n/a")),
        _paragraphs(paragraphs, evidence),
    ]
    findings, conflict, steps = (paragraphs.filter(c("section") == s) for s in ("key_findings", "conflicting_evidence", "next_steps"))
    claims = ev.join(findings.select("report_id").distinct(), "report_id", "left_anti").withColumn("ids", F.array("evidence_id"))
    against = ev.filter("category = 'conflicting'").join(conflict.select("report_id").distinct(), "report_id", "left_anti").withColumn("ids", F.array("evidence_id"))
    for section, rows in ((C, claims), (E, against)):
        pieces += [_said(rows, section, line, "- **[", c("category"), "]** ", md(c("claim")), " — evidence: "), _cited(rows, "ids", evidence, section, line, 1)]
    pieces += [_if_none(reports, findings.select("report_id").union(ev.select("report_id")), C, NO_FINDINGS), _if_none(reports, ev, D, NO_EVIDENCE),
               _if_none(reports, conflict.select("report_id").union(ev.filter("category = 'conflicting'").select("report_id")), E, NO_CONFLICT)]
    typed = ev.join(records.select("report_id", "record_id", "source_type"), ["report_id", "record_id"], "left")
    pieces += [
        _said(ev.select("report_id").distinct(), D, 0, MATRIX),
        _said(typed, D, line, "| ", c("evidence_id"), " | ", md(c("claim")), " | ", md(c("quote")), " | ", c("category"), " | ", c("confidence"), " | "),
        typed.select("report_id", F.lit(D).alias("section"), "line", F.lit(1).alias("piece"), F.lit("").alias("text"), "record_id"),
        _said(typed, D, line, " | **", badge(c("source_type")), "** |", piece=2),
    ]
    n = lambda df, kind: df.groupBy("report_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    accepted = reduce(DataFrame.unionByName, [n(evidence, "evidence"), n(gaps, "synthesis"), n(hyps, "synthesis"), n(paragraphs, "synthesis")])
    checks = check_lines(rejected, accepted, reports)
    pieces += [
        _said(reports, LIMITS, 0, ABSTRACTS_ONLY), _said(reports, LIMITS, 9, NO_SEMANTIC),
        _said(gp, G, line, "- **", c("gap_id"), "** **[", c("label"), "]** ", md(c("gap_statement")), " Why unresolved: ", md(c("why_unresolved")), " — supporting evidence: "),
        _cited(gp, "supporting", evidence, G, line, 1), _said(gp, G, line, "; conflicting evidence: ", piece=300_000), _cited(gp, "conflicting", evidence, G, line, 300_001),
        _said(gp, G, line, "; confidence: ", c("confidence"), ".", piece=600_000), _if_none(reports, gaps, G, NO_GAPS),
        _said(reports, H, -1, "\n" + DISCLAIMER, piece=1), _if_none(reports, hyps, H, NO_HYPOTHESES),
        _said(hy, H, line, "### ", c("hypothesis_id")), _said(hy, H, line + 1, "- **Candidate hypothesis:** ", md(c("hypothesis"))),
        _said(hy, H, line + 2, "- **Claim level:** ", F.replace(c("level"), F.lit("_"), F.lit(" ")), " (cited evidence supports at most ", F.replace(c("supported_level"), F.lit("_"), F.lit(" ")), ")."),
        _said(hy, H, line + 3, "- **Why it was proposed:** ", md(c("rationale")), " — research gap ", c("gap_id"), "; linked evidence: "), _cited(hy, "evidence_ids", evidence, H, line + 3, 1), _said(hy, H, line + 3, ".", piece=600_000),
        _said(hy, H, line + 4, "- **Prediction (measurable):** ", md(c("prediction"))),
        _said(hy, H, line + 5, "- **Limitations:** ", F.array_join(F.transform("limitations", lambda x: F.regexp_replace(md(x), r"\.+$", "")), "; "), "."),
        _said(hy, H, line + 6, "- **Confidence (qualitative):** ", c("confidence"), "."), _said(hy, H, line + 7, "- **Critic review:** ", F.replace(c("critic_status"), F.lit("_"), F.lit(" ")), " — ", md(c("note")), "."),
    ]
    idle = reports.join(steps.select("report_id").distinct(), "report_id", "left_anti")
    pieces += [_said(idle, I, 0, FULL_TEXT), _said(idle.join(hyps.select("report_id").distinct(), "report_id", "left_semi"), I, 1, DESIGN), _said(idle.join(gaps.select("report_id").distinct(), "report_id", "left_semi"), I, 2, SEARCH_GAPS)]

    used = stored(reduce(DataFrame.unionByName, [p.select(*_PIECE) for p in pieces]), "pieces")
    cited = stored(citations(used, records), "cited")
    fields = {"authors": c("authors"), "title": c("title"), "journal": c("journal"), "year": c("year"), "doi": c("doi"), "pmid": c("pmid"), "url": c("source_url"), "verification": c("verification_status"), "status": c("source_type"), "record_id": c("record_id")}
    full = cited.join(records, ["report_id", "record_id"], "left")
    lost = F.concat(F.lit("- "), c("marker"), F.lit(" — no record with this id; no citation rendered."))
    kinds = type_counts(cited, records).groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("badge", "n"))), lambda x: F.concat(F.lit("**"), x["badge"], F.lit("** "), x["n"].cast("string"))), ", ").alias("kinds"))
    held = cited.groupBy("report_id").agg(F.count_if("resolved").alias("resolved"), F.count_if(~c("resolved")).alias("unresolved"))
    counted = checks.join(held, "report_id", "left")
    name = reduce(lambda x, kv: F.when(c("family") == kv[0], F.lit(kv[1])).otherwise(x), CHECK_NAMES.items(), c("family"))
    ran = F.when(c("checked") > 0, F.concat(F.lit("ran on "), c("checked").cast("string"), F.lit(" item(s) — "), c("passed").cast("string"), F.lit(" passed, "), c("failed").cast("string"), F.lit(" failed"))).otherwise(F.lit("not run (no items to check)"))
    rendered = F.when(c("family") == "citation_validation", F.concat(F.lit("; citations rendered by code from verified records: "), or_(c("resolved"), "0"), F.lit(", unresolved: "), or_(c("unresolved"), "0"))).otherwise(F.lit(""))
    order = reduce(lambda x, kv: F.when(c("family") == kv[1], F.lit(kv[0] + 1)).otherwise(x), enumerate(CHECK_NAMES), F.lit(0))
    last = [
        _said(counted, LIMITS, order, "- ", name, " (deterministic): ", ran, rendered, "."),
        _said(reports.select("report_id").join(cited.select("report_id").distinct(), "report_id", "left_semi").join(kinds, "report_id", "left"), J, 0, "Source types of cited sources: ", or_(c("kinds"), ""), "."),
        _said(full, J, c("place"), F.when(c("resolved"), citation_line(c("marker"), fields)).otherwise(lost)), _if_none(reports, cited, J, NO_SOURCES),
    ]
    marked = used.join(cited.select("report_id", "record_id", "resolved", "marker"), ["report_id", "record_id"], "left")
    text = F.concat("text", F.coalesce(F.concat(F.lit("["), "marker", F.lit("]")), F.lit("")))
    every = reduce(DataFrame.unionByName, [marked.select("report_id", "section", "line", "piece", text.alias("text")), *[p.select("report_id", "section", "line", "piece", "text") for p in last]])
    at = lambda x: F.struct(x["section"], x["line"])
    parts = F.array_sort(F.collect_list(F.struct("section", "line", "piece", "text")))  # of one report
    ordered = every.groupBy("report_id").agg(parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x, k: F.concat(F.when((k > 0) & (at(x) != at(F.get("parts", k - 1))), F.lit("\n")).otherwise(F.lit("")), x["text"])), "")
    return ordered.select("report_id", F.concat(joined, F.lit("\n")).alias("report")), cited
