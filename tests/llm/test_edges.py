"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator."""

import pytest

from scholia.llm import decontaminate, fingerprint, line_dedup, near_dedup, packing, pii, secrets, substring_dedup, toxicity, url_filter
from scholia.llm.queries import tokenizer_path

SCHEMA = ("doc_id long, text string, source string, lang string, key string, id long, digest string, class string, rank int, hash long, place int, span string, line string, bucket long, "
          "root long, a long, b long, queue int, part int, blob string, first int, end int, range int, rep long, component long")
LONG = "long words of a text that goes on. " * 3000


def rows():
    texts = [(1, "One two three four five six seven.\nSecond line of it here."), (1, "One two three four five six seven.\nSecond line of it here."), (1, "another text of the same id"), (2, None), (3, ""), (None, "One two three four five six seven."),
             (None, None), (4, LONG), (5, LONG), (6, "%%% ###"), (7, "\n\n\n"), (8, "naïve 東京 text"), (9, "x")]
    return [(i, t, None if i == 3 else "s", "en", "k", 7, "d", "c", 1, 2, 3, "s", "l", 4, 5, 6, 7, 8, 9, "b", 1, 2, 3, 4, 5) for i, t in texts]


def operators(spark, docs):
    model = toxicity.fit(["bad words", "good words"], [1, 0])
    bench = spark.createDataFrame([(0, "One two three four five six seven"), (1, None), (2, "")], "item_id long, text string")
    return {
        "near": lambda: near_dedup.near_duplicates(docs),
        "pii": lambda: pii.pseudonymise(docs, b"k"),
        "decontaminate": lambda: decontaminate.contaminated(docs, bench),
        "secrets": lambda: secrets.scan(docs)[0],
        "fingerprint": lambda: fingerprint.edited_pairs(docs),
        "toxicity": lambda: toxicity.score(docs, model),
        "substring": lambda: substring_dedup.substring_dedup(docs),
        "lines": lambda: line_dedup.line_dedup(docs),
        "packing": lambda: packing.pack(docs, tokenizer_path()),
    }


@pytest.mark.parametrize("name", ["near", "pii", "secrets", "fingerprint", "toxicity", "substring", "lines"])
def test_one_row_for_each_row(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = operators(spark, docs)[name]().collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


def test_near_defined_results(spark):
    got = {(r["doc_id"]): r for r in near_dedup.near_duplicates(spark.createDataFrame(rows(), SCHEMA)).filter("doc_id IS NOT NULL").collect()}
    assert got[2]["class_id"] == got[3]["class_id"] == 2  # empty and null texts are one text
    assert got[5]["class_id"] == 4
    assert got[6]["class_id"] == 6 and got[7]["class_id"] == 7


def test_search_and_packing(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    ops = operators(spark, docs)
    found = {(r["doc_id"], r["item_id"]) for r in ops["decontaminate"]().collect()}
    assert (1, 0) in found and (None, 0) in found
    pieces = ops["packing"]().collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 3) == 1  # an empty text is its closing id


@pytest.mark.parametrize("name", ["near", "pii", "decontaminate", "secrets", "fingerprint", "toxicity", "substring", "lines", "packing"])
def test_empty_table(spark, name):
    assert operators(spark, spark.createDataFrame([], SCHEMA))[name]().collect() == []


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, None, 1), (2, "no scheme", "<link rel=canonical href='http://a.org/'>", 1), (3, "HTTP://X.COM/fr/1", "", 1), (3, "HTTP://X.COM/fr/1", "", 1), (None, "", None, 1)], "page_id long, url string, html string, key int")
    got = url_filter.judge(pages).collect()
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("", "", None, "allow")
    assert (by[3]["host"], by[3]["rule"], by[3]["verdict"]) == ("x.com", "com/fr/", "allow")
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_lines_keep_unique_text_of_null_and_shared_ids(spark):
    same, rest = "a line that both of them hold", ["wholly unique opening line", "a second one like no other", "third line of its own, alone"]
    docs = [(None, f"{same}\n{same}"), (None, f"{rest[0]}\nyes"), (2, rest[1]), (2, rest[2]), (2, rest[2]), (1, same)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, ""), (0, f"{rest[0]}\nyes"), (2, rest[1]), (2, rest[2]), (2, rest[2]), (1, same)])


def test_passages_keep_unique_text_of_null_and_shared_ids(spark):
    own = [" ".join(f"Sentence {w}{i} has its very own words number{i}{w} here and there{w}{i}." for i in range(5)) for w in "abcde"]
    docs = [(None, own[0]), (None, own[1]), (2, own[2]), (2, own[3]), ((1 << 63) - 1, own[4]), (7, own[3]), (None, own[1])]
    got = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert {(None, own[0]), (None, own[1]), (2, own[2]), (2, own[3]), ((1 << 63) - 1, own[4])} <= kept and (7, "") in kept
