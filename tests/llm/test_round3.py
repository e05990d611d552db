"""Hard negatives, chat formatting and the filter audit against plain Python, edge rows included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import chat_format, filter_audit, hard_negatives, line_dedup, packing, substring_dedup

# ---- hard negatives ----------------------------------------------------------------------------


def mined(rows, anchor, positives=5, negatives=10):
    """All pairs, exact integers."""
    used = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, y, v in {(i, y, tuple(v)) for i, y, v in used if anchor(i)}:
        best = sorted((-dot(v, w), j) for j, z, w in used if z == y and j != i)[:positives]
        for p, j in best:
            fit = sorted((-dot(v, w), k) for k, z, w in used if z != y and 30 * -p <= 100 * dot(v, w) <= 90 * -p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dims, seed, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    return [(k, [float(np.float32(x)) for x in centres[k % 6] + r.normal(scale=0.4, size=dims)], int(r.integers(labels))) for k in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("lists", [None, 1, 17])
def test_negatives_equal_all_pairs(spark, lists):
    rows = vectors(600, 8, 3)
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, lists=lists)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 50 == 0)


def test_negatives_with_ties_copies_nulls_and_clashing_columns(spark):
    rows = [(k, [1.0, 0.5], 0) for k in range(0, 40)] + [(100 + k, [0.5, 0.25], 1) for k in range(30)]  # ties everywhere
    rows += [(100, [0.5, 0.25], 1), (0, [1.0, 0.5], 0), (0, [1.0, 0.25], 0)]  # repeated rows, repeated ids
    rows += [(None, [1.0, 0.5], 0), (200, None, 1), (201, [], 1), (202, [1.0, None], 1), (203, [float("nan"), 1.0], 1), (204, [float("inf"), 1.0], 1), (205, [1.0, 1.0], None), (206, [1.0], 1), (207, [70000.0, -70000.0], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4.0) for r in rows], SCHEMA + ", list int, part int, query long, score double")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, lists=3).collect()))
    held = [(i, v if v is None else [x if x is None or not math.isfinite(x) else max(min(x, 65536.0), -65536.0) for x in v], y) for i, v, y in rows]
    assert got == mined(held, lambda i: i % 10 == 0) and got


def test_negatives_of_nothing(spark):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(1, [1.0], 1), (3, [0.5], 2)]):
        out = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 2 == 0)
        assert out.columns == columns and out.count() == 0


def test_products_are_exact_beyond_doubles():
    q = np.array([[1 << 24, (1 << 24) - 1] * 4096], np.int32)
    assert hard_negatives._products(q, q)[0, 0] == sum(int(x) ** 2 for x in q[0])


def test_a_hot_list_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART", 50)
    rows = [(k, [1.0, 0.0], k % 3) for k in range(400)] + vectors(100, 2, 5)[:0]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, low=3, high=10)
    want = [(a, p, r, n, 65536, 65536) for a in range(0, 400, 100) for p in [k for k in range(400) if k % 3 == a % 3 and k != a][:5]
            for r, n in enumerate([k for k in range(400) if k % 3 != a % 3][:10], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---- chat formatting ---------------------------------------------------------------------------

TEXTS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "|>", "<<||", "\\", "", None, "naïve 東京 🎉", "a\nb\n", "<|im_sep|>", "<\\\\\\|", "x" * 50_000, "im_start|>\n"]
ROLES = ["user", "assistant", "assistant", "system", "tool\nline", "a\\nb", "<|im_start|>", None, ""]


def test_conversations_round_trip(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(120) for t in range(rnd.randrange(1, 9))]
    rows += [(500, None, "user", "first"), (500, 0, "user", "b"), (500, 0, "user", "a"), (500, 0, "user", "a"), (500, 0, "assistant", "t")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, t int")
    out = chat_format.formatted(df).select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learnt_text(F.col("segments")).alias("learnt"), "segments").collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert sorted(r["conv_id"] for r in out) == sorted(by)
    for r in out:
        turns = [x[2:] for x in sorted(by[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learnt"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        runs = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == runs
        assert r["formatted"].count("<|im_sep|>") == len(turns) - runs


def test_conversations_without_an_id_stay_apart(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")]
    out = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "formatted").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((c, f"<|im_start|>{r}\n{t}<|im_end|>\n")) for c, _, r, t in rows)
    assert chat_format.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_conversation(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    r = chat_format.formatted(rows).select(F.size(chat_format.read_back(F.col("formatted"))).alias("n"), chat_format.learnt_text(F.col("segments")).alias("learnt")).first()
    assert r["n"] == 20_000
    assert hashlib.sha256(r["learnt"].encode()).hexdigest() == hashlib.sha256("".join(f"text {k}" for k in range(20_000) if k % 4 >= 2).encode()).hexdigest()


# ---- filter audit ------------------------------------------------------------------------------


def audited(docs, labels):
    good, toxic = {d for d, q, t in labels if q == 1 and d is not None}, {d for d, q, t in labels if t == 1 and d is not None}
    failing = []
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)}
        failing.append((lang or "", d, {k for k, v in f.items() if v}))
    out, shapley = [], Counter()
    for part in {p for p, _, _ in failing}:
        for order in map("".join, permutations("ABCDE")):
            c = [Counter() for _ in range(5)]
            for p, d, f in failing:
                if p == part:
                    first = next((k for k, x in enumerate(order) if x in f), 5)
                    for k, x in enumerate(order):
                        c[k].update(kept=first > k, removed=first == k, redundant=x in f and first < k, unique=f == {x}, good=first == k and d in good, toxic=first == k and d in toxic)
            for k, x in enumerate(order):
                shapley[part, x] += c[k]["removed"]
                out.append((part, order, k + 1, *(c[k][m] for m in ("kept", "removed", "redundant", "unique", "good", "toxic"))))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_replay_in_python(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgABC") for _ in range(rnd.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 160))) + rnd.choice(["", " #", "\t\n|"]) for _ in range(40)] + [None, "", "UP UP\x0bUP", "w " * 30_000]
    docs = [(rnd.choice([None, *range(90)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += docs[:5]  # repeated rows
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in rnd.choices(range(90), k=70)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, True, "x", 2) for d in docs], "doc_id long, text string, lang string, mask int, first boolean, part string, n_chars long")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string"), none).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_too_many_filters_are_an_error(spark):
    with pytest.raises(ValueError):
        filter_audit.orders(spark, "ABCDEFGH")


# ---- packing -----------------------------------------------------------------------------------


def test_new_words_are_encoded_by_one_call():
    import public_tokenizers

    e, calls = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    tokenizer = e.tokenizer

    class Counted:
        def encode(self, *a, **k):
            return tokenizer.encode(*a, **k)

        def encode_batch_fast(self, texts, **k):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **k)

    e.tokenizer = Counted()
    rng = random.Random(3)
    odd = ["\x1c", "\x85", " ", "́", "'s", "'ll", "<|endof", "<", ">", "|", "é", "²", "٣", "😀", "\n", "\t", "\x00", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd) if rng.random() < 0.3 else chr(rng.randrange(128)) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(chr(rng.randrange(128)) for _ in range(2_000)), " ".join(f"w{rng.random()}" for _ in range(3_000))]
    for t in texts:
        assert e(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, e.type).tobytes(), t
        assert not t.isascii() or e.ascii_parts(t) == e.parts(t), t
    assert set(calls) == {1}
    mark = {"content": "<|endoftext|>", "id": 7}
    assert e._separator([mark]) == ("<|endoftext|>", 7)
    assert [e._separator(x) for x in ([], [mark, mark], [mark | {"lstrip": True}], [mark | {"content": "aba"}])] == [None] * 4
    e.separator, e.known = None, {}
    assert e("one two") == np.array(tokenizer.encode("one two", add_special_tokens=False).ids, e.type).tobytes()


# ---- passages ----------------------------------------------------------------------------------


def test_passages_are_parted_in_few_steps():
    """Parts are those of the plain rules, a text's marks are matched once for a sentence end, and a word is hashed once."""
    rng = random.Random(8)

    def plain_sentences(text):
        ends = [m.end() for m in re.finditer(r"(?<![^\w\s])[^\w\s]++(?=\s|\Z)|\n", text) if re.search(r"[.!?\n]", m[0])]
        cuts = [0, *ends] if ends and ends[-1] == len(text) else [0, *ends, len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]

    def plain_cuts(words, longest, near=substring_dedup.NEAR):
        h, ends, last = [zlib.crc32(w.encode()) for w in words], [], 0
        for i in range(near, len(words) - near - 1):
            if h[i] < min(h[i - near : i]) and h[i] <= min(h[i + 1 : i + near + 1]) or i + 1 - last >= longest:
                ends.append(i + 1)
                last = i + 1
        return ends

    for _ in range(2_000):
        text = "".join(rng.choice(["a", "Bc", "İ", "ΑΣ", "_", "9", ".", "!", "?", ",", "…", "\"", " ", " ", " ", "\n"]) for _ in range(rng.randrange(120)))
        assert substring_dedup.sentences(text) == plain_sentences(text), text
        parts, words, _ = substring_dedup.pieces(text)
        assert "".join(parts) == text and len(parts) == len(words)
        for part, n in zip(parts, words):
            assert "İ" in text or len(re.findall(r"\w+", part)) == n, text
        some = [rng.choice("abcdefghij") for _ in range(rng.randrange(60))]
        for longest in (1, 3, 4, 10, 50):
            assert substring_dedup.cut_words(some, longest) == plain_cuts(some, longest)
    assert len([m for m in substring_dedup._STOP.finditer("one, two; (three) - four?! five... six")]) == 2
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) == 1]
    assert all(bool(re.match(r"\w", c)) == bool(re.match(r"\w", c.lower())) for c in every)
    for n in (0, 1, 5, 70_000):
        power, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (substring_dedup._BASE, substring_dedup._INVERSE))
        got = substring_dedup._powers(n)
        assert (got[0] == power).all() and (got[1] == back).all()


def test_lines_are_hashed_by_tables(spark, monkeypatch):
    """The classes of characters come from a table that is made once, the powers of a task from one that grows; ids and keys
    are what they were by the formulas. Unwanted lines do not leave the task."""
    import xxhash

    texts = ["", "one line, of words\n\nanother line 😀 \ud800 of words", "a\r\n\x85b" * 9, "x" * 40 + "\n"]
    lines = line_dedup.Lines(texts)
    odd = lambda line: sum(1 << k for k in range(24) if sum(((ord(c) * 0x9E3779B97F4A7C15 % 2**64) >> 40) % 24 == k for c in line) % 2)
    both = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines.lines]
    ids, digests = lines.ids()
    assert ids.tolist() == [odd(x) << 40 | h & 0xFFFFFFFFFF for x, h in zip(lines.lines, both)] and digests.tolist() == [h >> 64 for h in both]
    assert line_dedup._marks() is line_dedup._marks()
    powers, which = line_dedup.Powers(), line_dedup._worth(lines, 10)
    first = powers.to(len(lines.codes))[0]
    for probing in (False, True):
        for a, b in zip(lines.keys(which, 2, probing), lines.keys(which, 2, probing, powers)):
            assert a.tolist() == b.tolist()
    assert np.shares_memory(powers.to(7)[0], first)
    base, text = 0xD6E8FEB86659FD93, lines.lines[1]
    start, size = 0, len(text) // 3  # the first of three segments
    h = sum((ord(c) + 1) * 0x9E3779B97F4A7C15 * pow(base, k, 2**64) for k, c in enumerate(text[:size])) % 2**64
    salt = line_dedup.mix(np.array([len(text) * 16 + 1], np.uint64))
    with np.errstate(over="ignore"):
        assert lines.keys(np.array([1]), 2, False)[0].tolist() == line_dedup.mix(np.array([h], np.uint64) + salt).tolist()
    docs = spark.createDataFrame([(t,) for t in ("one line of words\nanother line of words", "one line of words", "a third line of words")], "text string")
    wanted = {int(line_dedup.signed(line_dedup.Lines([x]).ids()[0])[0]): x for x in ("one line of words", "a third line of words")}
    ask = spark.createDataFrame([(k,) for k in wanted], "id long")
    few = line_dedup._texts_of(docs, ask, 10)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in few.collect()} == set(wanted.items()) and few.count() == 2
    assert line_dedup._texts_of(docs, ask.limit(0), 10).collect() == []
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 1)
    assert {tuple(r) for r in line_dedup._texts_of(docs, ask, 10).collect()} == set(wanted.items())
