"""Question expansion, relevance scores, greedy diverse ranking, source policies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import keywords, stems, word_tokens

_PLATELET = r"\bplatelets?\b|\bthrombocytes?\b"
_ACTIVATION = r"\bactivat\w*"
_SHEAR = r"\bshear\w*"
_LIPID = r"\blipids?\b|\blipid-\w+|\bphospholipid\w*|\bphosphatidylserine\b"


@dataclass(frozen=True)
class Concept:
    """asked: patterns that the question must all match; any_asked: of which it must match one; text: patterns
    that a title or abstract must all match."""

    name: str
    terms: tuple[str, ...]
    anchor: bool
    asked: tuple[str, ...]
    any_asked: tuple[str, ...]
    text: tuple[str, ...]


# The curated concepts, anchors first, with the patterns for questions and for texts.
CONCEPTS = (
    Concept("platelet_activation", ("platelet activation",), True, (_PLATELET,), (_ACTIVATION, r"\baggregat\w*", _SHEAR, _LIPID),
            (r"\bplatelets?\b|\bthrombocyt\w*", r"\bactivat\w*|\baggregat\w*")),
    Concept("shear_stress", ("shear stress", "shear-induced"), False, (), (_SHEAR,), (r"\bshear\w*",)),
    Concept("mechanotransduction", ("mechanotransduction",), False, (),
            (r"\bmechanotransduc\w*", r"\bmechanosens\w*", rf"(?:{_SHEAR}).*(?:{_ACTIVATION})", rf"(?:{_ACTIVATION}).*(?:{_SHEAR})"),
            (r"\bmechanotransduc\w*|\bmechanosens\w*",)),
    Concept("platelet_membrane", ("platelet membrane",), False, (_PLATELET,), (r"\bmembranes?\b", _LIPID), (r"\bmembran\w*",)),
    Concept("membrane_lipids", ("membrane lipids", "phospholipids"), False, (), (r"\blipids?\b", r"\blipid-\w+", r"\bphospholipid\w*"), (r"\blipid\w*|\bphospholipid\w*",)),
    Concept("phosphatidylserine", ("phosphatidylserine",), False, (),
            (r"\bphosphatidylserine\b", r"\blipids?\b", r"\blipid-\w+", r"\bprocoagulant\w*"), (r"\bphosphatidylserine\b|\bprocoagulant\w*",)),
    Concept("lipid_signaling", ("lipid signaling",), False, (), (r"\blipids?\b", r"\blipid-\w+", r"\blipid signal\w*"),
            (r"\blipid[- ]signal\w*|\blipid[- ]mediat\w*|\bsignal\w* lipid\w*",)),
)
# Weights of a score and of the ranking, and its bounds.
ANCHOR, CONCEPT, KEYWORD, ORIGINAL = 15, 10, 3, 2
ABSTRACT_ANCHOR, ABSTRACT_CONCEPT, ABSTRACT_KEYWORD = 7, 5, 1
QUERY_BONUS, NOVELTY, REDUNDANCY, NEAR_DUPLICATE, NEAR = 3, 12, 15, 20, 0.75
NO_RANK, FOCUSED = 10**6, 6
#: Candidates of a question: a thousand hits of each of seven queries in two databases.
POOL = 14_000


def _every(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & c.rlike(p)
    return out


def _some(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(not patterns)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def asked_concepts(question: Column, catalog: tuple[Concept, ...] = CONCEPTS) -> Column:
    """Names of the concepts that a question is about, in catalogue order."""
    q = F.lower(question)
    return F.array_compact(F.array(*[F.when(_every(q, c.asked) & _some(q, c.any_asked), F.lit(c.name)) for c in catalog]))


def text_concepts(text: Column, asked: Column, catalog: tuple[Concept, ...] = CONCEPTS) -> Column:
    """Those of the asked concepts that a text matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.array_contains(asked, c.name) & _every(low, c.text), F.lit(c.name)) for c in catalog]))


def stem_hits(text: Column, stem_list: Column) -> Column:
    tokens = word_tokens(F.coalesce(text, F.lit("")))
    return F.filter(stem_list, lambda s: F.exists(tokens, lambda t: t.startswith(s)))


def expanded_queries(questions: DataFrame, catalog: tuple[Concept, ...] = CONCEPTS) -> DataFrame:
    """(question_id, query_id, kind, tagged, plain): the question itself and up to six focused queries, an
    anchor with one facet each. Without a curated anchor up to three topic words stand for it."""
    words = keywords(F.col("question"))
    matched = asked_concepts(F.col("question"), catalog)
    group = lambda terms: "(" + " OR ".join(f'"{t}"[tiab]' for t in terms) + ")" if len(terms) > 1 else f'"{terms[0]}"[tiab]'
    base = questions.select("question_id", F.trim("question").alias("question"), matched.alias("matched"), words.alias("words"))
    anchors = [c for c in catalog if c.anchor]
    tagged_anchor, plain_anchor = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(anchors):
        hit = F.array_contains("matched", c.name)
        tagged_anchor = F.when(hit, F.lit(group(c.terms))).otherwise(tagged_anchor)
        plain_anchor = F.when(hit, F.lit(" ".join(c.terms))).otherwise(plain_anchor)
    facets = [c for c in catalog if not c.anchor]
    none = F.array().cast("array<string>")
    # words that belong to an asked facet: its terms' words, and what one of its patterns finds; facets that are not asked cost nothing
    told = lambda c: lambda w: _any_of([w.isin(*[x for t in c.terms for x in t.split()]), *([w.rlike("|".join(f"(?:{p})" for p in patterns))] if (patterns := dict.fromkeys(c.any_asked + c.asked)) else [])])
    taken = F.flatten(F.array(*[F.when(F.array_contains("matched", c.name), F.filter("words", told(c))).otherwise(none) for c in facets]))
    base = base.withColumn("core", F.slice(F.array_except("words", taken), 1, 3))  # words are distinct
    core = F.col("core")
    tagged_core = F.when(F.size(core) > 1, F.concat(F.lit("("), F.array_join(F.transform(core, lambda w: F.concat(w, F.lit("[tiab]"))), " AND "), F.lit(")"))).when(
        F.size(core) == 1, F.concat(F.element_at(core, 1), F.lit("[tiab]")))
    anchored = base.withColumn("tagged_anchor", F.coalesce(tagged_anchor, tagged_core)).withColumn(
        "plain_anchor", F.coalesce(plain_anchor, F.when(F.size(core) > 0, F.array_join(core, " "))))
    focus = F.array_compact(F.array(*[F.when(F.array_contains("matched", c.name), F.struct(
        F.coalesce(F.concat("tagged_anchor", F.lit(" AND " + group(c.terms))), F.lit(group(c.terms))).alias("tagged"),
        F.concat_ws(" ", "plain_anchor", F.lit(" ".join(c.terms))).alias("plain"))) for c in facets]))
    own = F.array(F.struct(F.col("question").alias("tagged"), F.col("question").alias("plain")))
    rows = anchored.select("question_id", F.posexplode(F.array_distinct(F.concat(own, F.slice(focus, 1, FOCUSED)))).alias("n", "q"))
    return rows.select("question_id", F.concat(F.lit("q"), (F.col("n") + 1).cast("string")).alias("query_id"),
                       F.when(F.col("n") == 0, F.lit("original")).otherwise(F.lit("focused")).alias("kind"), F.col("q.tagged").alias("tagged"), F.col("q.plain").alias("plain"))


def _any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def scored(candidates: DataFrame, question: str, catalog: tuple[Concept, ...] = CONCEPTS) -> DataFrame:
    """candidates (record_id, title, abstract, origins of (query, database, rank)) with the score's parts.

    Adds concepts, keyword_hits, title_concepts, abstract_only_concepts, query_ids, databases, best_rank,
    title_score, abstract_score, origin_score and base_score."""
    q = candidates.sparkSession.range(1).select(asked_concepts(F.lit(question), catalog).alias("_asked"), stems(F.lit(question)).alias("_stems"))
    return _scores(candidates.crossJoin(F.broadcast(q)), candidates.columns, catalog)  # one row


def scored_for(candidates: DataFrame, questions: DataFrame, key: str = "question_id", catalog: tuple[Concept, ...] = CONCEPTS) -> DataFrame:
    """scored() for many questions (key, question) at once: candidates carry key; those of no question go."""
    q = questions.select(key, asked_concepts(F.col("question"), catalog).alias("_asked"), stems(F.col("question")).alias("_stems"))
    return _scores(candidates.join(q, key), candidates.columns, catalog)


def enriched(candidates: DataFrame, questions: DataFrame, abstracts: DataFrame, limit: int, key: str = "question_id", catalog: tuple[Concept, ...] = CONCEPTS) -> DataFrame:
    """Scores of all questions after enrichment: candidates are scored by title and provenance, the `limit` best of each
    question are given their abstract (key, record_id, abstract) where there is one, and all are scored again.

    Adds considered (whether the candidate was among the best). One plan, no action."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    plain = candidates.withColumn("abstract", F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*score_order()))
    chosen = scored_for(plain, questions, key, catalog).withColumn("_n", place).filter(F.col("_n") <= limit).select(key, "record_id", F.lit(True).alias("_chosen"))
    given = chosen.join(abstracts.select(key, "record_id", "abstract"), [key, "record_id"], "left")
    whole = plain.drop("abstract").join(given, [key, "record_id"], "left").withColumn("considered", F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    return scored_for(whole, questions, key, catalog)


def _scores(found: DataFrame, columns: list[str], catalog: tuple[Concept, ...]) -> DataFrame:
    """found has _asked and _stems, what each row's question asks for."""
    words = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    asked, stem_list = F.col("_asked"), F.col("_stems")
    anchors = words([c.name for c in catalog if c.anchor])
    found = found.withColumn("title_concepts", text_concepts(F.col("title"), asked, catalog)).withColumn("_th", stem_hits(F.col("title"), stem_list))
    found = found.withColumn("_ac", F.when(F.col("abstract").isNotNull(), text_concepts(F.col("abstract"), asked, catalog)).otherwise(words([]))).withColumn(
        "_ah", F.when(F.col("abstract").isNotNull(), stem_hits(F.col("abstract"), stem_list)).otherwise(words([])))
    queries = F.array_sort(F.array_distinct(F.transform("origins", lambda o: o["query"])))
    anchor_in_title = F.arrays_overlap("title_concepts", anchors)
    new = F.array_except("_ac", "title_concepts")
    title_score = F.when(anchor_in_title, ANCHOR).otherwise(0) + CONCEPT * F.size(F.array_except("title_concepts", anchors)) + KEYWORD * F.size("_th")
    origin = F.when(F.exists("origins", lambda o: o["query"] == 1), ORIGINAL).otherwise(0) + F.least(F.lit(QUERY_BONUS), F.size(queries))
    abstract_score = (
        F.when(~anchor_in_title & F.arrays_overlap("_ac", anchors), ABSTRACT_ANCHOR).otherwise(0)
        + ABSTRACT_CONCEPT * F.size(F.array_except(new, anchors)) + ABSTRACT_KEYWORD * F.size(F.array_except("_ah", "_th")))
    none = F.coalesce(abstract_score, F.lit(0))
    return found.select(
        *columns,
        F.filter(asked, lambda c: F.array_contains("title_concepts", c) | F.array_contains("_ac", c)).alias("concepts"),
        F.filter(stem_list, lambda s: F.array_contains("_th", s) | F.array_contains("_ah", s)).alias("keyword_hits"),
        "title_concepts", new.alias("abstract_only_concepts"), queries.alias("query_ids"),
        F.array_sort(F.array_distinct(F.transform("origins", lambda o: o["database"]))).alias("databases"),
        F.array_min(F.transform("origins", lambda o: o["rank"])).alias("best_rank"),
        F.coalesce(title_score, F.lit(0)).alias("title_score"), none.alias("abstract_score"), F.coalesce(origin, F.lit(0)).alias("origin_score"),
        (F.coalesce(title_score, F.lit(0)) + none + F.coalesce(origin, F.lit(0))).alias("base_score"),
    )


def text_relevant(concepts: Column, keyword_hits: Column) -> Column:
    """Whether a candidate's texts have anything of what is asked."""
    return (F.size(concepts) > 0) | (F.size(keyword_hits) > 0)


def score_order() -> list[Column]:
    return [F.desc("base_score"), F.coalesce("best_rank", F.lit(NO_RANK)), F.col("record_id")]


def chosen_for_enrichment(scores: DataFrame, limit: int) -> DataFrame:
    """The `limit` best by score, then rank, then id."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return scores.orderBy(*score_order()).limit(limit)


def greedy_order(rows: list[dict]) -> list[dict]:
    """All candidates of a question, best next: novelty of facets rewarded, known profiles and near-duplicate
    titles penalised. rows: record_id, facets (set), tokens (set), base_score, best_rank."""
    left = {r["record_id"]: {**r, "same": 0, "dup": None} for r in rows}
    covered: set[str] = set()
    ranked: list[dict] = []
    while left:
        def key(r):
            gain = r["base_score"] + NOVELTY * len(r["facets"] - covered) - REDUNDANCY * r["same"] - (NEAR_DUPLICATE if r["dup"] else 0)
            return -gain, -r["base_score"], NO_RANK if r["best_rank"] is None else r["best_rank"], r["record_id"]

        best = min(left.values(), key=key)
        del left[best["record_id"]]
        ranked.append({**best, "selection_score": -key(best)[0], "new_facets": sorted(best["facets"] - covered)})
        covered |= best["facets"]
        for r in left.values():  # what the next round needs is kept up to date: one comparison a pair
            r["same"] += r["facets"] == best["facets"]
            if r["dup"] is None and best["tokens"] and r["tokens"] and len(r["tokens"] & best["tokens"]) / len(r["tokens"] | best["tokens"]) >= NEAR:
                r["dup"] = best["record_id"]
    return ranked


def ranked(scores: DataFrame, key: str, title_tokens: Column, most: int = POOL) -> DataFrame:
    """(key, rank, record_id, selection_score, new_concepts, near_duplicate_of, same_profile): greedy per key.

    Questions come one after the other, one is held at a time. A question's pool is what its searches may return, `most` at most; a larger one is an
    error, for the order of its candidates is found one by one."""
    anchors = F.array(*[F.lit(c.name) for c in CONCEPTS if c.anchor])
    slim = scores.select(F.col(key).alias("k"), "record_id", F.array_except("concepts", anchors).alias("facets"), title_tokens.alias("tokens"), "base_score", "best_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, schema = None, [], None

        def done() -> list[dict]:
            return [{"k": k, "rank": n, "record_id": r["record_id"], "selection_score": r["selection_score"], "new_concepts": r["new_facets"], "near_duplicate_of": r["dup"], "same_profile": r["same"]}
                    for n, r in enumerate(greedy_order(held), 1)]

        for b in batches:
            out = []
            schema = schema or pa.schema([b.schema.field("k"), ("rank", pa.int32()), ("record_id", pa.string()), ("selection_score", pa.int32()), ("new_concepts", pa.list_(pa.string())),
                                          ("near_duplicate_of", pa.string()), ("same_profile", pa.int32())])
            for r in b.to_pylist():
                if r["k"] != k:
                    out += done()
                    k, held = r["k"], []
                held.append({"record_id": r["record_id"], "facets": set(r["facets"]), "tokens": set(r["tokens"] or ()), "base_score": r["base_score"], "best_rank": r["best_rank"]})
                if len(held) > most:
                    raise ValueError(f"a question has over {most} candidates, at most {most} are ranked")
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(done(), schema)

    schema = f"k {slim.schema['k'].dataType.simpleString()}, rank int, record_id string, selection_score int, new_concepts array<string>, near_duplicate_of string, same_profile int"
    return slim.repartition("k").sortWithinPartitions("k").mapInArrow(run, schema).withColumnRenamed("k", key)


JOURNAL, PREPRINT, CONFERENCE, BOOK, UNKNOWN = "peer-reviewed journal article", "preprint", "conference paper", "book/chapter", "unknown"
POLICIES = ("allow_all", "prefer_peer_reviewed", "peer_reviewed_only")


def policy_order(ranking: DataFrame, policy: str, key: str = "question_id") -> DataFrame:
    """ranking (key, record_id, rank, source_status, relevant) with tier, excluded and policy_position.

    allow_all keeps the order; peer_reviewed_only excludes what is no journal article; prefer_peer_reviewed puts
    relevant journal articles first, then other relevant ones, then journal articles, then the rest."""
    if policy not in POLICIES:
        raise ValueError(f"unknown source policy {policy!r}")
    journal = F.coalesce(F.col("source_status"), F.lit(UNKNOWN)) == JOURNAL
    relevant = F.coalesce("relevant", F.lit(False))
    tier = F.lit(0) if policy != "prefer_peer_reviewed" else F.when(relevant & journal, 0).when(relevant, 1).when(journal, 2).otherwise(3)
    out = ranking.withColumn("tier", tier.cast("int")).withColumn("excluded", F.lit(False) if policy != "peer_reviewed_only" else ~journal)
    place = F.row_number().over(Window.partitionBy(key, "excluded").orderBy("tier", "rank"))
    return out.withColumn("policy_position", F.when(~F.col("excluded"), place))


def backfilled(ordered: DataFrame, target: int, accepted: tuple[str, ...] = ("verified",), factor: int = 3, key: str = "question_id") -> DataFrame:
    """ordered (key, position from 1, status) with checked and selected.

    Candidates are verified in rounds as large as what is still missing, until `target` have passed or
    target * factor were checked. A round never goes beyond the last candidate that it needs, so a candidate is
    checked if fewer than `target` passed before it and it lies within the bound."""
    if target < 1:
        raise ValueError("target must be positive")
    passed = F.coalesce(F.col("status").isin(*accepted), F.lit(False)).cast("int")
    before = F.coalesce(F.sum(passed).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ordered.withColumn("_before", before)
    checked = (F.col("_before") < target) & (F.col("position") <= target * max(1, factor))
    return out.withColumn("checked", checked).withColumn("selected", checked & (passed == 1)).drop("_before")


def verification_rounds(ordered: DataFrame, target: int, accepted: tuple[str, ...] = ("verified",), factor: int = 3, key: str = "question_id") -> DataFrame:
    """(key, round, checked_in_round, passed_in_round): a fold over each ranking's statuses."""
    ok = F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce(F.col("status").isin(*accepted), F.lit(False)).alias("ok")))), lambda s: s["ok"])
    most = target * max(1, factor)
    start = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("passed"), F.lit(0).alias("left"), F.lit(0).alias("n"),
                     F.array().cast("array<struct<round:int,checked:int,passed:int>>").alias("rounds"))

    def step(s: Column, good: Column) -> Column:
        stop = (s["taken"] >= most) | ((s["left"] == 0) & (s["passed"] >= target))
        fresh = s["left"] == 0
        n = F.when(fresh, s["n"] + 1).otherwise(s["n"])
        left = F.when(fresh, F.lit(target) - s["passed"]).otherwise(s["left"]) - 1
        old = F.when(fresh, F.struct(n.alias("round"), F.lit(0).alias("checked"), F.lit(0).alias("passed"))).otherwise(F.try_element_at(s["rounds"], F.lit(-1)))
        row = F.struct(n.alias("round"), (old["checked"] + 1).alias("checked"), (old["passed"] + good.cast("int")).alias("passed"))
        kept = F.when(fresh, s["rounds"]).otherwise(F.slice(s["rounds"], F.lit(1), F.greatest(F.size(s["rounds"]) - 1, F.lit(0))))
        moved = F.struct((s["taken"] + 1).alias("taken"), (s["passed"] + good.cast("int")).alias("passed"), left.alias("left"), n.alias("n"), F.concat(kept, F.array(row)).alias("rounds"))
        return F.when(stop, s).otherwise(moved)

    folded = ordered.groupBy(key).agg(F.aggregate(ok, start, step).alias("s"))
    return folded.select(key, F.explode("s.rounds").alias("r")).select(key, F.col("r.round").alias("round"), F.col("r.checked").alias("checked_in_round"), F.col("r.passed").alias("passed_in_round"))
