"""Every stage of the pipeline on edge rows and on an empty table: which rows come out, with all columns."""

import pytest

import corpus_pipeline

#: Columns of documents, and some that clash with inner names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, carried string, version long, class_id long, digest string, queue int"
TEXT = "One two three four five six seven eight nine ten.\nA second line that says something else here."
LONG = "many words of one long text that goes on and on. " * 4000


def rows():
    texts = [(1, TEXT), (1, TEXT), (1, "another text that shares the id of the first one"), (2, None), (3, ""), (None, "a text without any id of its own"), (None, None), (4, LONG), (5, LONG + " end"), (6, "%%% ###"), (7, "\n\n"), (8, "naïve 東京 text")]
    return [(i, t, "en", None if i == 3 else "s", None if t is None else len(t), "c", 1, 2, "d", 3) for i, t in texts]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    labels = [(k, 1, k % 2) for k in range(9)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, "seven words that no document here has"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_edge_rows(spark, sf_dir, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    if name == "packing":
        total = {}
        for r in got.collect():
            total.setdefault(str(r["doc_id"]), 0)
            assert 0 <= r["offset"] and r["offset"] + r["length"] <= 1024
        assert set(total) == {str(r[0]) for r in rows()}
        return
    assert got.columns == docs.columns
    out = [tuple(r) for r in got.collect()]
    if name == "line_dedup":  # documents stay; rows that share id and text are one document and keep its lines
        assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in rows())
        assert sum((r[1] or "").count("A second line") for r in out) == 2
    elif name == "near_dedup":  # one of each class, rows of one id and text are one document
        assert sorted(str(r[0]) for r in out if r[1] == TEXT) == ["1", "1"]
        assert [r[0] for r in out if r[1] and r[1].startswith("many words")] == [4]
        assert {r[1] for r in out} >= {"%%% ###", "\n\n", "naïve 東京 text", "another text that shares the id of the first one", "a text without any id of its own"}
    else:
        assert set(out) <= set(rows()) and (name == "toxicity" or len(out) == len(rows()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, sf_dir, name):
    docs = spark.createDataFrame([], SCHEMA)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)
