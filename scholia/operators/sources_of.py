"""What kind of source a record is: labels per database's metadata, combined per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.identity import blank_to_null
from scholia.operators.scoring import BOOK, CONFERENCE, JOURNAL, PREPRINT, UNKNOWN

# Type words of the two databases.
WORK_TYPES = {
    JOURNAL: ("journal-article",),
    CONFERENCE: ("proceedings-article",),
    BOOK: ("book", "book-chapter", "book-part", "book-section", "book-track", "book-set", "book-series", "edited-book", "monograph", "reference-book"),
}
JOURNAL_PUBTYPES = (
    "journal article", "review", "systematic review", "meta-analysis", "randomized controlled trial", "clinical trial", "clinical trial, phase i",
    "clinical trial, phase ii", "clinical trial, phase iii", "clinical trial, phase iv", "controlled clinical trial", "comparative study", "case reports",
    "observational study", "multicenter study", "evaluation study", "validation study",
)
# Preprint servers by DOI and by the names of containers, publishers and institutions.
SERVERS = (
    ("bioRxiv/medRxiv", r"^10\.1101/(?:[0-9]{4}\.[0-9]{2}\.[0-9]{2}\.)?[0-9]{5,}(?:v[0-9]+)?$",
     ("biorxiv", "medrxiv", "biorxiv : the preprint server for biology", "medrxiv : the preprint server for health sciences")),
    ("arXiv", r"^10\.48550/arxiv\.", ("arxiv",)),
    ("Research Square", r"^10\.21203/rs\.", ("research square", "res sq")),
    ("SSRN", r"^10\.2139/ssrn\.", ("ssrn", "ssrn electronic journal")),
    ("Preprints.org", r"^10\.20944/preprints", ("preprints.org",)),
    ("ChemRxiv", r"^10\.26434/chemrxiv", ("chemrxiv",)),
)


def preprint_server(doi: Column, names: Column) -> Column:
    """The server and how it was recognised; doi in lower case, names an array in any case."""
    low = F.transform(names, F.lower)
    out = F.lit(None).cast("string")
    for label, pattern, known in reversed(SERVERS):
        listed = F.arrays_overlap(low, F.array(*[F.lit(k) for k in known]))
        out = F.when(doi.rlike(pattern), F.lit(f"{label} (DOI pattern)")).when(listed, F.lit(f"{label} (container/publisher/institution name)")).otherwise(out)
    return out


def label_of_work(type_: Column, subtype: Column, names: Column, doi: Column) -> Column:
    """struct(status, basis) of a registered work."""
    t, s = F.coalesce(F.lower(type_), F.lit("")), F.coalesce(F.lower(subtype), F.lit(""))
    server = preprint_server(F.lower(doi), names)
    posted = (t == "posted-content") & (s == "preprint")
    status = F.when(posted | server.isNotNull(), F.lit(PREPRINT))
    for label, types in WORK_TYPES.items():
        status = status.when(t.isin(*types), F.lit(label))
    basis = (
        F.when(posted, F.lit("crossref type posted-content, subtype preprint"))
        .when(server.isNotNull(), F.concat(F.lit("known preprint server: "), server))
        .when(t.isin(*[x for types in WORK_TYPES.values() for x in types]), F.concat(F.lit("crossref type "), t))
        .otherwise(F.concat(F.lit("crossref type "), F.when(t == "", F.lit("missing")).otherwise(t), F.when(s == "", F.lit("")).otherwise(F.concat(F.lit(", subtype "), s))))
    )
    return F.struct(status.otherwise(F.lit(UNKNOWN)).alias("status"), basis.alias("basis"))


def label_of_summary(pubtypes: Column, journals: Column, doi: Column) -> Column:
    """struct(status, basis) of a document summary."""
    low = F.transform(pubtypes, F.lower)
    server = preprint_server(F.lower(doi), journals)
    journal = F.array_sort(F.array_intersect(low, F.array(*[F.lit(p) for p in JOURNAL_PUBTYPES])))
    pre, congress = F.array_contains(low, "preprint"), F.array_contains(low, "congress") & (F.size(journal) == 0)
    article = (F.size(journals) > 0) & (F.size(journal) > 0)
    status = F.when(pre | server.isNotNull(), F.lit(PREPRINT)).when(congress, F.lit(CONFERENCE)).when(article, F.lit(JOURNAL)).otherwise(F.lit(UNKNOWN))
    basis = (
        F.when(pre, F.lit("pubmed publication type Preprint"))
        .when(server.isNotNull(), F.concat(F.lit("known preprint server: "), server))
        .when(congress, F.lit("pubmed publication type Congress"))
        .when(article, F.concat(F.lit("pubmed journal present and publication type(s) "), F.array_join(journal, ", ")))
        .when(F.size(low) == 0, F.lit("pubmed publication types missing"))
        .otherwise(F.lit("pubmed publication types do not identify a journal article"))
    )
    return F.struct(status.alias("status"), basis.alias("basis"))


def combined(labels: DataFrame, key: str = "record_id", order: str = "position") -> DataFrame:
    """(key, source_status, basis): labels (key, order, status, basis) of a record's metadata combined. Any
    preprint wins; known labels must agree; the basis is in order of first mention."""
    g = labels.groupBy(key).agg(
        F.coalesce(F.bool_or(F.col("status") == PREPRINT), F.lit(False)).alias("_pre"),
        F.array_sort(F.collect_set(F.when(F.col("status") != UNKNOWN, F.col("status")))).alias("_known"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("basis").isNotNull(), F.struct(order, "basis")))), lambda x: x["basis"])).alias("_basis"),
    )
    clash = ~F.col("_pre") & (F.size("_known") > 1)
    status = F.when(F.col("_pre"), F.lit(PREPRINT)).when(F.size("_known") == 1, F.element_at("_known", 1)).otherwise(F.lit(UNKNOWN))
    basis = F.when(F.size("_basis") == 0, F.array(F.lit("no type metadata retrieved"))).when(
        clash, F.concat("_basis", F.array(F.lit("conflicting type metadata between sources")))).otherwise(F.col("_basis"))
    return g.select(key, status.alias("source_status"), basis.alias("basis"))


def work_metadata(work: Column) -> Column:
    """The parts of a work that tell its type: (type, subtype, names, doi)."""
    names = F.concat(F.coalesce(work["container-title"], F.array().cast("array<string>")),
                     F.coalesce(F.transform(work["institution"], lambda i: i["name"]), F.array().cast("array<string>")), F.array(work["publisher"]))
    return F.struct(blank_to_null(work["type"]).alias("type"), blank_to_null(work["subtype"]).alias("subtype"),
                    F.array_compact(F.transform(names, blank_to_null)).alias("names"), blank_to_null(work["DOI"]).alias("doi"))


BADGES = {  # fixed values: what a reader sees first of each source
    PREPRINT: "Preprint — not peer-reviewed", JOURNAL: "Peer-reviewed journal article (metadata label)", CONFERENCE: "Conference paper",
    BOOK: "Book/chapter", UNKNOWN: "Source type unknown",
}


def badge(status: Column) -> Column:
    out = F.lit(BADGES[UNKNOWN])
    for k, v in BADGES.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out
