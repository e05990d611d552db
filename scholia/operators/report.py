"""Reports: first-use citation numbers, rendered sources, sections, leak scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import markdown_escaped, safe_id
from scholia.operators.matching import holding
from scholia.operators.sources_of import badge

# Section titles of a report, in order.
SECTIONS = ("A. Research Question", "B. Search Strategy", "C. Key Findings", "D. Evidence Matrix", "E. Conflicting Evidence", "F. Limitations", "G. Research Gaps",
            "H. Candidate Hypotheses", "I. Proposed Next Steps", "J. Sources")


def numbered_citations(uses: DataFrame, records: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, record_id, ref, status) over uses (key, position, record_id): S1, S2, ... in order of first use;
    only ids that resolve count, others are marked unresolved."""
    first = uses.groupBy(key, "record_id").agg(F.min("position").alias("first"))
    known = first.join(records.select("record_id").distinct().withColumn("_ok", F.lit(True)), "record_id", "left")
    n = F.row_number().over(Window.partitionBy(key, "_ok").orderBy("first", "record_id"))
    return known.select(key, "record_id", F.when(F.col("_ok"), F.concat(F.lit("S"), n.cast("string"))).alias("ref"), F.when(F.col("_ok"), F.lit("resolved")).otherwise(F.lit("unresolved")).alias("status"), "first")


def unresolved_marker(record_id: Column) -> Column:
    safe = safe_id(record_id)
    return F.concat(F.lit("[UNRESOLVED CITATION: "), F.coalesce(safe["value"], F.concat(F.lit("sha256 "), safe["sha256"])), F.lit("]"))


def citation_line(ref: Column, r: dict[str, Column]) -> Column:
    """One line of the source list, from record fields only: authors (array), title, journal, year, doi, pmid, url,
    verification, access, status, record_id."""
    or_ = lambda c, text: F.coalesce(c, F.lit(text))
    authors = F.array_join(F.transform(r["authors"], markdown_escaped), "; ")
    return F.concat_ws(
        " ",
        F.concat(F.lit("- **["), ref, F.lit("]** **["), badge(r["status"]), F.lit("]** "), or_(F.nullif(authors, F.lit("")), "authors not available"), F.lit(".")),
        F.concat(F.coalesce(F.concat(F.lit("*"), markdown_escaped(r["title"]), F.lit("*")), F.lit("title not available")), F.lit(".")),
        F.concat(or_(markdown_escaped(r["journal"]), "journal not available"), F.lit(".")), F.concat(or_(r["year"].cast("string"), "year not available"), F.lit(".")),
        F.coalesce(F.concat(F.lit("DOI: ["), markdown_escaped(r["doi"]), F.lit("](https://doi.org/"), r["doi"], F.lit(").")), F.lit("DOI: not available.")),
        F.coalesce(F.concat(F.lit("PMID: ["), r["pmid"], F.lit("](https://pubmed.ncbi.nlm.nih.gov/"), r["pmid"], F.lit("/).")), F.lit("PMID: not available.")),
        F.coalesce(F.concat(F.lit("URL: <"), r["url"], F.lit(">.")), F.lit("URL: not available.")),
        F.concat(F.lit("Verification: "), or_(r["verification"], "not available"), F.lit(".")), F.concat(F.lit("Record: `"), r["record_id"], F.lit("`.")),
    )


def sections(reports: DataFrame, key: str = "report_id", column: str = "report", titles: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(key, title, body): a Markdown report cut at its known second-level headings; what comes before the first
    is left out. Lines are numbered by posexplode; the running count of headings names the section."""
    heads = F.array(*[F.lit(f"## {t}") for t in titles])
    lines = reports.select(key, F.posexplode(F.split(column, "\r?\n")).alias("no", "line"))
    lines = lines.withColumn("head", F.array_contains(heads, F.rtrim("line")))
    lines = lines.withColumn("part", F.sum(F.col("head").cast("int")).over(Window.partitionBy(key).orderBy("no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    cut = lines.filter("part > 0").groupBy(key, "part").agg(F.max(F.when(F.col("head"), F.substring(F.rtrim("line"), 4, 1000))).alias("title"), body.alias("body"))
    return cut.select(key, "title", F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))


def leaks(texts: DataFrame, needles: DataFrame, path: str = "path", text: str = "text", needle: str = "needle") -> DataFrame:
    """(path, needle) for every needle that a text holds, as it is, Markdown-escaped or JSON-escaped (with other letters
    than ASCII as they are or as \\u escapes). Texts and needles may both be large: they meet on grams."""
    n = F.col(needle)
    json = F.expr(f"substring(to_json(array({needle})), 3, length(to_json(array({needle}))) - 4)")
    escaped = F.regexp_replace(n, r"([\\`*_\[\]|<>#])", r"\\$1")
    ascii_json = F.array_join(F.transform(F.split(json, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1")))), "")
    forms = needles.filter(n != "").select(n, F.explode(F.array_distinct(F.array(n, escaped, json, ascii_json))).alias("form")).distinct()
    return holding(texts.select(path, text), forms, path, text, "form").join(forms, "form").select(path, needle).distinct()


def listed_sources(citations: DataFrame, records: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, ref, record_id, cited, resolved) of every source: the cited ones under their numbers, those without a record
    under none, then R1, R2, ... for the records (key, record_id, ordinal) that nothing cites, by ordinal."""
    cited = citations.select(key, "ref", "record_id", F.lit(True).alias("cited"), (F.col("status") == "resolved").alias("resolved"))
    rest = records.join(citations.filter("status = 'resolved'").select(key, "record_id"), [key, "record_id"], "left_anti")
    n = F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "record_id"))
    return cited.union(rest.select(key, F.concat(F.lit("R"), n.cast("string")), "record_id", F.lit(False), F.lit(True)))


def report_status(issues: Column, rejections: Column) -> Column:
    return F.when(issues > 0, F.lit("issues")).when(rejections > 0, F.lit("passed_with_rejections")).otherwise(F.lit("passed"))


def source_quality(cited: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """(key, summary): how many items from how many sources, by badge."""
    each = cited.groupBy(key, "source_record_id").agg(F.count(F.lit(1)).alias("items"), F.max(badge(F.col("source_type"))).alias("badge"))
    kinds = each.groupBy(key, "badge").agg(F.count(F.lit(1)).alias("n"), F.sum("items").alias("items"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("badge", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["badge"])), ", ")
    g = kinds.groupBy(key).agg(parts.alias("parts"), F.sum("n").alias("sources"), F.sum("items").alias("items"))
    return g.select(key, F.concat(F.col("items").cast("string"), F.lit(" evidence item(s) from "), F.col("sources").cast("string"), F.lit(" distinct source(s): "), "parts").alias("summary"))
