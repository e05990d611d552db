"""Provider answers and fetched documents: usage, output text, fenced JSON, envelopes, abstracts in XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from scholia.functions.identity import stripped

# Names that providers give to the same count.
COUNTS = {"input": ("input_tokens", "prompt_tokens"), "output": ("output_tokens", "completion_tokens")}
MOST_BYTES = 10 * 1024 * 1024


def _count(payload: Column, *paths: str) -> Column:
    """The first path that holds a JSON integer of 0 or more."""
    found = [F.get_json_object(payload, p) for p in paths]
    return F.coalesce(*[F.when(c.rlike(r"^[0-9]{1,18}$"), c.cast("bigint")) for c in found])


def usage(payload: Column) -> Column:
    """struct(reported, input, output, reasoning, cached, total, ticks, nano) of an answer."""
    u = lambda *names: [f"$.usage.{n}" for n in names]
    return F.struct(
        F.coalesce(F.get_json_object(payload, "$.usage").startswith("{"), F.lit(False)).alias("reported"),
        _count(payload, *u(*COUNTS["input"])).alias("input"), _count(payload, *u(*COUNTS["output"])).alias("output"),
        _count(payload, *u("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens")).alias("reasoning"),
        _count(payload, *u("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens")).alias("cached"),
        _count(payload, *u("total_tokens")).alias("total"), _count(payload, *u("cost_in_usd_ticks")).alias("ticks"), _count(payload, *u("cost_in_nano_usd")).alias("nano"))


ANSWER = (
    "struct<status:string,error:string,output:array<struct<type:string,role:string,content:array<struct<type:string,text:string,refusal:string>>>>,incomplete_details:struct<reason:string>>"
)


def output_text(payload: Column) -> Column:
    """struct(text, problem): the text parts of the assistant's messages in order, or why there is none to use."""
    a = F.from_json(payload, ANSWER)
    said = F.filter(a["output"], lambda o: F.coalesce(o["type"], F.lit("message")).eqNullSafe("message") & F.coalesce(o["role"], F.lit("assistant")).eqNullSafe("assistant"))
    parts = F.coalesce(F.flatten(F.transform(F.filter(said, lambda o: o["content"].isNotNull()), lambda o: o["content"])), F.from_json(F.lit("[]"), "array<struct<type:string,text:string,refusal:string>>"))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull()), lambda p: p["text"])
    problem = (
        F.when(a.isNull() | ~F.coalesce(stripped(payload).startswith("{"), F.lit(False)), F.lit("malformed_payload"))
        .when(F.coalesce(a["error"], F.lit("")) != "", F.lit("provider_error")).when(a["status"] == "incomplete", F.lit("incomplete"))
        .when(F.exists(parts, lambda p: p["type"] == "refusal"), F.lit("refusal")).when(F.size(texts) == 0, F.lit("missing_output_text"))
        .when(a["status"] != "completed", F.lit("unexpected_status"))
    )
    return F.struct(F.when(problem.isNull(), F.array_join(texts, "")).alias("text"), problem.alias("problem"))


def unfenced(text: Column) -> Column:
    """JSON text without one code fence around it."""
    bare = stripped(text)
    inner = F.regexp_extract(bare, r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?\s*```$", 1)
    return F.when(bare.startswith("```") & (inner != ""), stripped(inner)).otherwise(bare)


def envelope(text: Column, key: str) -> Column:
    """struct(n, problem): how many items an answer {key: [...]} has, or what is wrong with it."""
    body = unfenced(text)
    keys = F.json_object_keys(body)
    items = F.get_json_object(body, f"$.{key}")
    valid = F.get_json_object(body, "$").isNotNull()
    problem = (
        F.when(~valid, F.lit("invalid_output_json")).when(~body.startswith("{"), F.lit("not_an_object"))
        .when(F.size(F.array_except(keys, F.array(F.lit(key)))) > 0, F.lit("unexpected_field")).when(~F.coalesce(items.startswith("["), F.lit(False)), F.lit("not_a_list"))
    )
    return F.struct(F.when(problem.isNull(), F.json_array_length(items)).alias("n"), problem.alias("problem"))


def abstracts_of(xml: str | None) -> list[dict] | None:
    """[{pmid, abstract}] of an article set, the first article of each id; None if it is unsafe or no such set."""
    if not xml or len(xml.encode("utf-8", "ignore")) > MOST_BYTES or "<!ENTITY" in xml.upper():
        return None
    head = xml.upper().partition("<!DOCTYPE")[2].partition(">")[0]
    if "[" in head:
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    if root.tag != "PubmedArticleSet":
        return None
    out: dict[str, str | None] = {}
    for article in root.iterfind("PubmedArticle"):
        raw = (article.findtext("MedlineCitation/PMID") or "").strip()
        if not raw.isdigit() or not 0 < len(raw) <= 9 or not int(raw) or str(int(raw)) in out:
            continue
        parts = []
        for node in article.iterfind("MedlineCitation/Article/Abstract/AbstractText"):
            body, label = " ".join("".join(node.itertext()).split()), " ".join((node.get("Label") or "").split())
            if body:
                parts.append(f"{label}: {body}" if label else body)
        out[str(int(raw))] = " ".join(parts) or None
    return [{"pmid": k, "abstract": v} for k, v in out.items()]


@F.pandas_udf(ArrayType(StructType([StructField("pmid", StringType()), StructField("abstract", StringType())])))
def xml_abstracts(s: pd.Series) -> pd.Series:
    return s.map(abstracts_of)


@F.pandas_udf(ArrayType(StringType()))
def rejected_texts(s: pd.Series) -> pd.Series:
    """Free text of raw rejected items (JSON): strings of twelve code points or more, the pipeline's ids left out."""
    import json

    def walk(node):
        if isinstance(node, dict):
            for v in node.values():
                yield from walk(v)
        elif isinstance(node, list):
            for v in node:
                yield from walk(v)
        elif isinstance(node, str) and len(node) >= 12 and not node.startswith("rec_"):
            yield node

    def one(raw):
        try:
            return list(walk(json.loads(raw)))
        except (TypeError, ValueError):
            return []

    return s.map(one)
