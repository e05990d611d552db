"""JSON walks, the gram index and graph hashes against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import variants
from scholia.operators import matching, provenance, report
from scholia.operators.evidence import BIBLIOGRAPHIC_KEYS

VALUES = ["plain", "see 10.1234/abc now", "é \"quoted\" \\ \n", "", 7, -1, True, False, None]
KEYS = ["claim", "Title", "a b", "DOI", "x-y", "", "paper title"]


def payload(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice(VALUES)
    if rnd.random() < 0.5:
        return [payload(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))]
    return {k: payload(rnd, depth - 1) for k in rnd.sample(KEYS, rnd.randrange(0, 4))}


def redacted(x):
    if isinstance(x, dict):
        return {k: "[redacted:bibliographic]" if "_".join(k.strip().lower().replace("-", " ").split()) in BIBLIOGRAPHIC_KEYS else redacted(v) for k, v in x.items()}
    if isinstance(x, list):
        return [redacted(v) for v in x]
    return x.replace("10.1234/abc", "[redacted:identifier]") if isinstance(x, str) else x


def strings(x):
    if isinstance(x, dict):
        return [s for k in sorted(x) for s in strings(x[k])]
    if isinstance(x, list):
        return [s for v in x for s in strings(v)]
    return [x] if isinstance(x, str) else []


def test_walks_over_any_shape(spark):
    rnd = random.Random(3)
    data = [payload(rnd, d) for d in range(7) for _ in range(12)]
    df = spark.createDataFrame([(k, json.dumps(x, ensure_ascii=k % 2 == 0)) for k, x in enumerate(data)], "k int, j string")
    v = variants.parsed(F.col("j"))
    out = df.select("k", variants.canonical(F.col("j")).alias("c"), variants.redacted_answer(F.col("j"), BIBLIOGRAPHIC_KEYS).alias("r"), variants.strings(v).alias("s")).collect()
    for r in out:
        x = data[r["k"]]
        assert r["c"] == json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert json.loads(r["r"]) == redacted(x) and r["s"] == strings(x)


def test_walks_below_the_last_level_and_without_json(spark):
    deep = json.dumps([[[{"title": "x", "claim": "10.1234/abc"}]]])
    df = spark.createDataFrame([(deep,), ("{\"title\": \"cut 10.1234/abc",), (None,), ("",)], "j string")
    out = [r[0] for r in df.select(variants.redacted_answer(F.col("j"), BIBLIOGRAPHIC_KEYS, 2)).collect()]
    assert out == ['[[[{"claim":"[redacted:identifier]","title":"[redacted:bibliographic]"}]]]', '{"title": "cut [redacted:identifier]', None, ""]
    assert [r[0] for r in df.limit(1).select(variants.strings(variants.parsed(F.col("j")), 1)).collect()] == [['[[{"claim":"10.1234/abc","title":"x"}]]']]
    kinds = spark.createDataFrame([(x,) for x in ("[1]", '"s"', "1", "1.5", "true", "null", "nope", '{"items":[1,2],"doi:10.1234/x":1,"A b":2}')], "j string")
    got = [tuple(r[0]) for r in kinds.select(variants.structure(F.col("j"))).collect()]
    assert got == [("not_an_object", k, None, None) for k in ("list", "str", "int", "float", "bool", "NoneType")] + [("invalid_json", None, None, None), ("object", None, ["[redacted]", "a_b", "items"], 2)]


@pytest.mark.parametrize("few", [0, 200_000])
def test_held_strings_against_every_pair(spark, few, monkeypatch):
    monkeypatch.setattr(matching, "FEW", few)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aé𝒳b ") for _ in range(rnd.randrange(0, 60)))
    texts = [(k, word() * rnd.randrange(1, 4)) for k in range(80)] + [(80, None), (81, ""), (5, "another text of id 5"), (82, "a" * 5000)]
    whole = [t for _, t in texts if t]
    needles = []
    for _ in range(150):
        t = rnd.choice(whole)
        i = rnd.randrange(len(t))
        needles.append(t[i : i + rnd.choice([1, 2, 5, 11, 12, 13, 30])])
    needles += [word() for _ in range(30)] + ["", None, "a" * 12, "a" * 4999]
    got = matching.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "id", "text", "needle").collect()
    want = {(i, n) for i, t in texts for n in needles if n and t is not None and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_leaks_in_every_written_form(spark):
    needle = 'An "odd" [text] of é\nand 𝒳 letters'
    forms = [needle, json.dumps(needle)[1:-1], json.dumps(needle, ensure_ascii=False)[1:-1], needle.replace("[", "\\[").replace("]", "\\]")]
    df = spark.createDataFrame([(str(k), f"before {t} after") for k, t in enumerate(forms)] + [("no", "nothing here")], "path string, text string")
    got = report.leaks(df, spark.createDataFrame([(needle,), ("",), (None,)], "needle string")).collect()
    assert sorted(r["path"] for r in got) == ["0", "1", "2", "3"] and {r["needle"] for r in got} == {needle}


@pytest.mark.parametrize("part_lines", [2, 16, 1024])
def test_content_hash_depends_on_content_alone(spark, part_lines):
    rows = [(g, f"k{k}", f"line {k} of {g}") for g, n in ((1, 1), (2, 40), (3, 700)) for k in range(n)]
    of = lambda rs, parts: {r["graph_id"]: (r["n"], r["content_sha256"]) for r in provenance.content_hash(spark.createDataFrame(rs, "graph_id int, key string, line string").repartition(parts), part_lines).collect()}
    base = of(rows, 1)
    assert {g: n for g, (n, _) in base.items()} == {1: 1, 2: 40, 3: 700}
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert of(shuffled, 7) == base
    changed = of([(g, k, t + "!" if (g, k) == (3, "k699") else t) for g, k, t in rows], 3)
    assert changed[1] == base[1] and changed[2] == base[2] and changed[3] != base[3]
    assert of([], 1) == {}


def test_content_hash_has_two_levels_at_any_size(spark):
    """9,000 lines in parts of 16: three hex digits, whose parts make up the graph's hash at once."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(g, f"k{k}", f"line {k}") for g, n in ((1, 9000), (2, 5)) for k in range(n)]
    parts = {}
    for key, hashed in sorted((sha(k), sha(t)) for g, k, t in rows if g == 1):
        parts[key[:3]] = parts.get(key[:3], "") + key + hashed
    want = {1: sha("".join(p + sha(t) for p, t in sorted(parts.items()))), 2: sha("".join(sorted(sha(k) + sha(t) for g, k, t in rows if g == 2)))}
    got = provenance.content_hash(spark.createDataFrame(rows, "graph_id int, key string, line string"), 16)
    assert {r["graph_id"]: r["content_sha256"] for r in got.collect()} == want


def test_difference_of_graphs_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x", "l"), (1, "y", None), (2, "x", "l")], "graph_id int, key string, line string")
    b = spark.createDataFrame([(1, "x", "m"), (1, "y", None), (1, "z", "n")], "graph_id int, key string, line string")
    assert sorted(map(tuple, provenance.difference(a, b).collect())) == [(1, "x"), (1, "z"), (2, "x")]
