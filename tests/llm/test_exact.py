"""Operators against brute force, exact round trips and held-out accuracy."""

import datetime as dt
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import decontaminate, fingerprint, line_dedup, near_dedup, packing, pii, secrets, substring_dedup, toxicity, url_filter
from scholia.llm.common import Vocabulary, components, shingles, signed, word_hashes
from scholia.llm.queries import tokenizer_path

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 8))) for _ in range(400)]


def prose(n, rnd=R):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text, n, rnd=R):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS)
    return " ".join(w)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def groups_of(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    pairs = [(R.randrange(60), R.randrange(60)) for _ in range(40)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    want = groups_of(pairs, range(60))
    named = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: want[i] for i in named}


def test_dart_signatures_estimate_weighted_jaccard():
    a, b = prose(300), None
    b = edited(a, 12)
    v = Vocabulary()
    sets = [np.unique(shingles(word_hashes(t, v)), return_counts=True) for t in (a, b)]
    s = near_dedup.dart_signatures([e for e, _ in sets], [c * 3 for _, c in sets], 2000)
    assert abs((s[0] == s[1]).mean() - near_dedup.weighted_jaccard(*sets)) < 0.05
    heavy = (sets[0][0], sets[0][1] * np.array([5] + [1] * (len(sets[0][0]) - 1)))
    s = near_dedup.dart_signatures([heavy[0], sets[0][0]], [heavy[1], sets[0][1]], 2000)
    assert abs((s[0] == s[1]).mean() - near_dedup.weighted_jaccard(heavy, sets[0])) < 0.05


def test_near_duplicates_against_all_pairs(spark):
    base = [prose(R.randrange(20, 200)) for _ in range(25)]
    texts = base + [edited(R.choice(base), R.randrange(0, 6)) for _ in range(120)]
    R.shuffle(texts)
    v = Vocabulary()
    sets = [np.unique(shingles(word_hashes(t, v)), return_counts=True) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == groups_of(pairs, range(len(texts)))


def test_pairs_on_one_template_find_each_other(spark):
    """Families that resemble each other (0.71), below the threshold: buckets full of them, pairs that no hub joins."""
    template, texts = [f"t{i}" for i in range(200)], []
    for f in range(150):
        own = [f"f{f}x{i}" for i in range(40)]
        texts += [" ".join(template + own), " ".join(template + own[:-24] + [f"f{f}y{i}" for i in range(24)])]
    v = Vocabulary()
    sets = [np.unique(shingles(word_hashes(t, v)), return_counts=True) for t in texts[:4]]
    assert near_dedup.weighted_jaccard(sets[0], sets[1]) >= 0.8 > near_dedup.weighted_jaccard(sets[0], sets[2]) > 0.7
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("kind,value", [("card", "4539 1488 0343 6467"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "12/31/1999"), ("ipv4", "10.0.255.1"), ("ssn", "123-45-6789"),
                                        ("phone", "+1 (659) 555-3949"), ("email", "Anna.b7@mail2.example.com")])
def test_pseudonyms_keep_their_format_and_come_back(kind, value):
    new = pii.pseudonym(kind, value, b"key")
    assert new and new != value and pii.pseudonym(kind, new, b"key") is not None
    assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", new))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", value))) or kind == "ipv4"
    assert pii.pseudonym(kind, new, b"key", back=True) == value
    assert pii.pseudonym(kind, value, b"other") != new


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 2000))
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"k", "t", n)
    seen = {f.walk(x, pii._yes) for x in range(n)}
    assert seen == set(range(n)) and all(f.walk(f.walk(x, pii._yes), pii._yes, True) == x for x in range(0, n, max(1, n // 20)))


@pytest.mark.parametrize("kind,value", [("card", "45 39 14 88 03 43 64 67"), ("card", "4-5-3-9-1-4-8-8-0-3-4-3-6-4-6-7"), ("phone", "+45 12 34 56 78"), ("phone", "+4 (1) 23 456"), ("phone", "(659) 555-3949"), ("iban", "GB82 WEST 1234 5698 7654 32"),
                                        ("date", "1/2/1999"), ("date", "2024-02-29"), ("ipv4", "1.2.3.4"), ("ssn", "123-45-6789"), ("email", "anna@example.com")])
def test_values_in_groups_of_two_are_found_alone(kind, value):
    alone, spans = pii.replace(f"ring {value} now", b"k")
    assert spans == [(kind, 5, 5 + len(value))] and value not in alone
    assert pii.replace(f"in 1999 ring {value} now", b"k")[0] == alone.replace("ring", "in 1999 ring")


def test_neighbouring_values_are_told_apart():
    spans = pii.replace("+1 (826) 555-4081 190.137.3.9 and +1 (017) 555-7713 4539148803436467 1219538112535716 7.8.9.10", b"k")[1]
    assert [k for k, _, _ in spans] == ["phone", "ipv4", "phone", "card", "ipv4"]


def test_pii_links_and_leaves_invalid_values(spark):
    text = "pay 4539148803436467 or 4539 1488 0343 6467, not 4539148803436468; born 2001-02-03, mail a.b@x.org 300.1.1.1"
    out = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "again 4539148803436467")], "doc_id long, text string"), b"key").collect()
    new = {r["doc_id"]: r for r in out}
    one = re.findall(r"\d{16}", new[1]["text"])
    assert one[0] == re.findall(r"\d{16}", new[2]["text"])[0] == re.search(r"or ([\d ]{19})", new[1]["text"])[1].replace(" ", "")
    assert "4539148803436468" in new[1]["text"] and "300.1.1.1" in new[1]["text"] and new[1]["n_card"] == 2
    back = pii.reveal(spark.createDataFrame(out).select("doc_id", "text"), b"key").collect()
    assert {r["doc_id"]: r["text"] for r in back}[1] == text


LIKE = {  # one value in several formats each
    "date": ["1999-12-31", "31.12.1999", "31/12/1999", "12/31/1999"], "early date": ["2001-05-07", "7/5/2001", "07.05.2001"], "phone": ["+1 659 555 3949", "+16595553949", "+1-659-555-3949", "+1 (659) 555-3949"],
    "other phone": ["+45 12 34 56 78", "+4512345678"], "card": ["4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6467"], "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
}


def canonical(value):
    """What a value is, whatever its format."""
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", value):
        return tuple(map(int, m.groups()))
    if m := re.fullmatch(r"(\d+)[./](\d+)[./](\d{4})", value):
        a, b, y = map(int, m.groups())
        return (y, a, b) if b > 12 else (y, b, a)
    return re.sub(r"[^A-Z0-9+]", "", value)


@pytest.mark.parametrize("key", [b"k", b"another", b"third"])
def test_one_value_has_one_pseudonym_in_every_format(spark, key):
    """The query's operator over whole texts: formats stay, values stay linked across documents, and come back."""
    docs = [(i, f"word {v} and on", name) for i, (name, v) in enumerate((n, v) for n, vs in LIKE.items() for v in vs)]
    df = spark.createDataFrame(docs, "doc_id long, text string, name string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, key).collect()}
    back = {r["doc_id"]: r["text"] for r in pii.reveal(spark.createDataFrame([(i, r["text"]) for i, r in out.items()], "doc_id long, text string"), key).collect()}
    new = {i: re.fullmatch(r"word (.*) and on", r["text"])[1] for i, r in out.items()}
    for i, text, name in docs:
        old = text[5:-7]
        assert out[i]["n_found"] == 1 and back[i] == text
        assert re.sub(r"\d", "0", re.sub("[A-Z]", "A", new[i])) == re.sub(r"\d", "0", re.sub("[A-Z]", "A", old)) or "date" in name
        assert len({canonical(new[j]) for j, _, n in docs if n == name}) == 1
    values = {canonical(v) for v in new.values()}
    assert len(values) == len(LIKE)  # different values stay apart


def test_dates_are_permuted_day_by_day():
    days = [dt.date(1900, 1, 1) + dt.timedelta(k) for k in range(0, 60_000, 7)]
    new = [pii.pseudonym("date", d.isoformat(), b"k") for d in days]
    assert len(set(new)) == len(days) and [pii.pseudonym("date", x, b"k", True) for x in new] == [d.isoformat() for d in days]
    assert all((int(x[8:]) > 12) == (d.day > 12) for x, d in zip(new, days))


def test_decontamination_against_all_windows(spark):
    items = [(i, prose(n)) for i, n in enumerate((2, 3, 5, 8, 14, 20, 30, 41))]
    docs = []
    for d in range(60):
        t = prose(R.randrange(1, 120))
        if d % 3 == 0:
            item = items[d % len(items)][1]
            t = " ".join([prose(20), edited(item, d % 4 and 1) if len(item.split()) > 10 else item, t])
        docs.append((d, t))
    v = Vocabulary()
    want = {}
    for d, t in docs:
        w = word_hashes(t, v)
        for i, it in items:
            iw = word_hashes(it, v)
            k = min(5, len(iw))
            s, x = shingles(w, k) if len(w) >= k else w[:0], Counter(shingles(iw, k).tolist())
            m = sum(x.values())
            span = min(m, len(s))
            if not span:
                continue
            best = max((sum((Counter(s[p : p + span].tolist()) & x).values()) / (span + m - sum((Counter(s[p : p + span].tolist()) & x).values())) for p in range(len(s) - span + 1)), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1000, 3):
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contaminated(spark_docs, bench, block=block).collect()}
        assert got == want and want


def secret_spans(t):
    out = []
    for k, (kind, p, g, n) in enumerate([("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t, re.A) if len(m[g]) >= n]
    return ",".join(f"{kind}:{s}:{e}" for s, k, e, kind in sorted(out))


def test_secrets_against_regex_and_ledger(spark):
    parts = ["Token = abc", "token: token: abcdefg", 'api_key="Zz9+/=_-"', "AKIA" + "A1" * 9, "AKIAAKIA", "0123456789abcdef" * 2, "passwd:x", "éé ", "SECRET=12345678 ", "\n", "deadbeef", "AKIA" + "Q" * 16 + "abcdef0123456789abcdef0123"]
    docs = [(i, "".join(R.choice(parts) + R.choice(["", " ", "é"]) for _ in range(R.randrange(0, 7)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found, ledger = secrets.scan(df)
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}
    assert got == {i: secret_spans(t) for i, t in docs}
    more = spark.createDataFrame([*docs, (900, docs[0][1]), (901, "token=abcdefgh new")], "doc_id long, text string")
    again, added = secrets.scan(more, ledger=ledger)
    assert added.count() == 1  # the one blob that the ledger lacks
    assert {r["doc_id"]: r["s"] for r in again.select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}[900] == got[0]
    assert secrets.scan(more, ledger=ledger, version="base-2")[1].count() == len({t for _, t in docs} | {"token=abcdefgh new"})


def test_redirects_propagate_with_allow_first(spark):
    pages = spark.createDataFrame([
        (1, "http://example.org/es/1", None), (2, "http://plain.net/a", "<link href='http://example.org/es/1' rel='canonical'>"), (3, "https://plain.net/a/?utm_source=x#f", None),
        (4, "http://alone.net/", None), (5, "http://both.net/", '<meta http-equiv="refresh" content="0; url=http://b.com/de/">'), (6, "http://z.net/?id=3&ref=1", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://both.net/", "http://c.com/fr/x"), ("http://z.net/?id=3", "http://d.com/de/q")], "source string, target string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, redirects=redirects).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block")}


def test_relative_links_are_aliases_and_hostless_ones_are_none(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    links = [canonical.format("/es/1"), canonical.format("//a.example.org/es/1"), refresh.format("/es/"), canonical.format("../es/./1"), canonical.format("../x/../../es/1?b#c"),
             canonical.format("http:///es/1"), canonical.format("file:///x"), canonical.format("mailto:a@b.c"), canonical.format("?a=1"), canonical.format("/en/?to=http://example.org/es/1"), ""]
    rules = (("example.org/es/", "block"),)
    pages = [(i, f"https://a.example.org/p{i}/q?z", h) for i, h in enumerate(links)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=rules).collect()}
    assert [got[i]["verdict"] for i in range(len(links))] == ["block"] * 5 + ["allow"] * 6
    assert len({got[i]["component"] for i in range(5, len(links))}) == 6 and got[0]["component"] == got[1]["component"] == got[3]["component"]


def xx(values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text, k=fingerprint.K, bins=fingerprint.BINS, picks=fingerprint.PICKS):
    words = [xx([w]) for w in re.split(r"[^\w]+", text.lower()) if w]
    if not words:
        return [None] * bins
    upper = ~((1 << 28) - 1)
    if len(words) < k:
        mers = [xx(words) & upper]
    else:
        mers = [xx(words[i : i + k]) & upper for i in range(len(words) - k + 1)]
    seen, ranked = Counter(), []
    for place, m in enumerate(mers):
        ranked.append((xx([m, np.int32(seen[m])]) & upper, place))
        seen[m] += 1
    out = []
    shift = 64 - (bins - 1).bit_length()
    for b in range(bins):  # each coordinate's own order of all k-mers
        own = sorted(ranked, key=lambda r: (0, r[0]) if (r[0] & (1 << 64) - 1) >> shift == b else (1, xx([r[0], np.int32(b)])))[:picks]
        out.append(xx([h for _, h in sorted((p, h) for h, p in own)]))
    return out


@pytest.mark.parametrize("n", [12, 40, 200, 1000])
def test_swapped_halves_are_as_unlike_at_every_length(spark, n):
    """Two picks keep their order if both are of one half: about half of the coordinates."""
    rnd, near = random.Random(n), []
    texts = ["".join(f"w{rnd.random()} " for _ in range(n)) for _ in range(12)]
    halves = [" ".join(w[n // 2 :] + w[: n // 2]) for w in (t.split() for t in texts)]
    df = spark.createDataFrame(list(zip(texts, halves)), "a string, b string")
    near = [r[0] for r in df.select(fingerprint.likeness(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).collect()]
    assert 0.35 < sum(near) / len(near) < 0.6


def test_order_minhash_against_plain_python_and_edits(spark):
    docs = [(i, t) for i, t in enumerate([prose(n) for n in (1, 2, 3, 10, 60, 200)] + ["a b a b a b a b " * 20, "", "...", prose(40)])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["sketch"] for r in fingerprint.fingerprints(df).collect()}
    assert got == {i: plain_sketch(t) for i, t in docs}
    pairs = {r["doc_id"]: r for r in fingerprint.edited_pairs(df).collect()}
    for i, t in docs:
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        assert pairs[i]["edited_text"] == t[: len(t) - half] + after[:half] and pairs[i]["next_sketch"] == got[(i + 1) % len(docs)]
    t = prose(300)
    w = t.split()
    swapped = " ".join(w[150:] + w[:150])
    near = [fingerprint.likeness(fingerprint.sketch(F.lit(t)), fingerprint.sketch(F.lit(x))) for x in (t, edited(t, 3), swapped, prose(300))]
    same, close, moved, other = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(near)]).first()
    assert same == 1 and close > 0.8 and moved < close and other < 0.1


def test_toxicity_on_held_out_rows(spark):
    bad, rnd = ["scumbag", "idiotic", "vileness"], random.Random(21)
    docs, labels = [], []
    for i in range(600):
        w = prose(30, rnd).split()
        toxic = i % 4 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y)
    out = toxicity.score(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) / len(held) > 0.95
    flipped = y.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(d, flipped).weights, model.weights)  # held-out labels are never seen


def test_toxicity_finds_a_lone_word_in_any_draw(spark):
    """Held-out texts with one telling word among thirty of chance: all are found, none else, whatever the draw."""
    for seed in range(3):
        rnd = random.Random(seed)
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
        texts = [[rnd.choice(words) for _ in range(30)] for _ in range(600)]
        for w in texts[::4]:
            w[rnd.randrange(30)] = rnd.choice(["scumbag", "idiotic", "vileness"])
        texts, y = [" ".join(w) for w in texts], [int(i % 4 == 0) for i in range(600)]
        model = toxicity.fit(texts[:400], y[:400])
        assert [int(model.score(t) >= 0.7) for t in texts[400:]] == y[400:]


def test_substrings_against_brute_force(spark):
    sentences = [prose(R.randrange(3, 30)).capitalize() + R.choice([".", "!", "?"]) for _ in range(80)]
    passages = [" ".join(R.sample(sentences, 5)) for _ in range(6)]
    docs = [(i, " ".join(R.choice(passages) if R.random() < 0.3 else R.choice(sentences) + ("\n" if R.random() < 0.2 else "") for _ in range(R.randrange(0, 9)))) for i in range(60)]
    cut = {i: substring_dedup.pieces(t) for i, t in docs}
    assert all("".join(cut[i][0]) == t for i, t in docs)
    first, gone = {}, {i: set() for i, _ in docs}
    for i, _ in docs:
        parts, words, h = cut[i]
        for p in range(len(parts)):
            end = next((e for e in range(p + 3, len(parts) + 1) if sum(words[p:e]) >= substring_dedup.MIN_WORDS), None)
            if end and first.setdefault(h[p:end].tobytes(), (i, p)) != (i, p):
                gone[i] |= set(range(p, end))
    got = {r["doc_id"]: (r["text"], set(r["removed"])) for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: ("".join(p for k, p in enumerate(cut[i][0]) if k not in gone[i]), gone[i]) for i, _ in docs}
    assert any(gone.values())


def test_passages_that_begin_and_end_inside_sentences_are_found(spark):
    rnd = random.Random(51)

    def sentence():
        return prose(rnd.randrange(4, 40), rnd).capitalize() + "."

    docs, lengths = [], []
    for i in range(150):
        n = rnd.randrange(51, 61)
        words = " ".join(sentence() for _ in range(12)).split()
        start = rnd.randrange(len(words) - n)
        passage = " ".join(words[start : start + n])
        for half in range(2):
            own = " ".join(sentence() for _ in range(12)).split()
            at = rnd.randrange(10, len(own) - 10)
            docs.append((2 * i + half, " ".join([*own[:at], passage, *own[at:]])))
        lengths.append(n)
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lost = [len(docs[2 * i + 1][1].split()) - len(out[2 * i + 1]["text"].split()) for i in range(150)]
    assert not any(out[2 * i]["n_removed"] for i in range(150))
    assert sum(n > 0 for n in lost) >= 149 and all(n <= m for n, m in zip(lost, lengths))
    assert sum(lost) / sum(lengths) > 0.75


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_edit_distance_within(tau):
    pairs = []
    for _ in range(400):
        a = [R.randrange(3) for _ in range(R.randrange(0, 25))]
        b = list(a)
        for _ in range(R.randrange(0, 5)):
            i = R.randrange(len(b) + 1)
            b[i : i + R.randrange(0, 2)] = [R.randrange(3)] * R.randrange(0, 2)
        pairs.append((a, b))
    got = line_dedup.edit_distance_within([np.array(a, np.uint32) for a, _ in pairs], [np.array(b, np.uint32) for _, b in pairs], tau)
    assert got.tolist() == [min(distance(a, b), tau + 1) for a, b in pairs]


def family(base, n, most, rnd=R):
    out = []
    for _ in range(n):
        x = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, most)):
            i = rnd.randrange(len(x))
            x[i : i + rnd.randrange(0, 2)] = rnd.choice("abcdé")
        out.append("".join(x))
    return out


@pytest.mark.parametrize("crowd,hubbed", [(32, 2048), (0, 4)])
def test_lines_against_all_pairs(spark, crowd, hubbed, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rnd = random.Random(crowd)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(8, 45))) for _ in range(40)]
    lines = family(base, 200, 4, rnd) + family(base[:1], 100, 6, rnd)
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 6)))) for i in range(150)]
    worth = lambda x: len(x.strip()) >= 10
    every = sorted({x for _, t in docs for x in t.split("\n") if worth(x)})
    ids = {x: int(signed(line_dedup.Lines([x]).ids()[0])[0]) for x in every}
    near = {tuple(sorted((ids[a], ids[b]))) for i, a in enumerate(every) for b in every[:i] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    links = {tuple(r) for r in line_dedup.similar_lines(df, crowd=crowd, hubbed=hubbed, rounds=1).collect()}
    root = groups_of(near, set(ids.values()))
    assert links <= near and groups_of(links, set(ids.values())) == root
    first, want, occurs = {}, {}, Counter(root[ids[x]] for _, t in docs for x in t.split("\n") if worth(x))
    for i, t in docs:
        kept = [x for n, x in enumerate(t.split("\n")) if not worth(x) or first.setdefault(root[ids[x]], (i, n)) == (i, n)]
        want[i] = ("\n".join(kept), sum(occurs[root[ids[x]]] - 1 for x in t.split("\n") if worth(x)))
    got = line_dedup.line_dedup(df, crowd=crowd, hubbed=hubbed, rounds=1).collect()
    assert {r["doc_id"]: (r["text"], r["n_links"]) for r in got} == want
    named = {}
    for r in got:
        for x, c in zip(dict(docs)[r["doc_id"]].split("\n"), r["line_classes"], strict=True):
            if c is not None:
                named.setdefault(root[ids[x]], set()).add(c)
            else:
                assert not worth(x) or occurs[root[ids[x]]] == 1
    assert all(len(c) == 1 for c in named.values()) and len({min(c) for c in named.values()}) == len(named)


def test_lines_of_one_family_emit_no_squares(spark):
    """300 variants of a line: the links grow with the variants, not with their square."""
    rnd = random.Random(3)
    lines = sorted(set(family(["the quick brown fox jumps over a lazy dog"], 400, 3, rnd)))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert line_dedup.similar_lines(df).count() < 20 * len(lines)
    assert len({r["line_classes"][0] for r in line_dedup.line_dedup(df).collect()}) == 1


@pytest.mark.parametrize("weights", [None, {None: 3.0, "a": 1.0, "b": 1.0}])
def test_packing_is_whole_gapless_and_mixed(spark, weights):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = [(i, (prose(R.randrange(0, 60)) + " <|endoftext|> x" * (i % 13 == 0)) if i % 9 else "", ["a", "b", "b", "b"][i % 4] if i % 11 else None) for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), tokenizer_path(), proportions=weights, length=64, window=256).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, t, _ in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r["start"]), 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        total += at
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["queue"]))
    sizes = []
    for s in sorted(sequences):
        at = 0
        for off, n, _ in sorted(sequences[s]):
            assert off == at
            at += n
        sizes.append(at)
    full = total // 64
    assert sizes[:full] == [64] * full and all(n & (n - 1) == 0 for n in sizes[full:]) and sum(sizes) == total
    served = Counter()
    totals = Counter()
    for r in pieces:
        totals[r["queue"]] += r["length"]
    w = {q: (totals[q] if weights is None else weights[[None, "a", "b"][q]]) for q in totals}
    for block in range(full // 4):  # windows of four sequences: the share of every queue that is not yet empty
        for s in range(4 * block, 4 * block + 4):
            for _, n, q in sequences[s]:
                served[q] += n
        left = [q for q in totals if served[q] < totals[q]]
        if len(left) == len(totals):
            for q in totals:
                assert abs(served[q] - 256 * (block + 1) * w[q] / sum(w.values())) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 50)), min_size=1, max_size=6))
def test_schedule_serves_in_order_of_due_times(queues):
    s = packing.Schedule(tuple(t for t, _ in queues), tuple(w for _, w in queues))
    from fractions import Fraction

    due = sorted((Fraction(2 * k + 1, 2 * w), i) for i, (t, w) in enumerate(queues) for k in range(t))
    for n in range(0, len(due) + 1, max(1, len(due) // 7)):
        got = [0] * len(queues)
        for _, i in due[:n]:
            got[i] += 1
        assert s.served(n) == got


def test_digest_is_plain_sha(spark):
    assert spark.range(1).select(F.sha2(F.lit("a:0:1"), 256)).first()[0] == hashlib.sha256(b"a:0:1").hexdigest()


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    rnd = random.Random(22)
    docs = [(i, prose(30, rnd) + (" scumbag vileness" if i % 3 == 0 else "")) for i in range(90)] + [(1000 + i, "x " * 6000) for i in range(6)]
    labels = [(i, int(i % 3 == 0)) for i, _ in docs]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, y, sample_chars=11_000)
    assert model.score("scumbag vileness") > 0.5 > model.score(prose(30, rnd))
    with pytest.raises(ValueError):
        toxicity.train(d.filter("doc_id >= 1000"), y, sample_chars=11_000)


def test_proportions_name_every_source(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), proportions={"s": 1.0})


def test_whole_texts_where_words_cannot_be_parted():
    from tokenizers import Tokenizer

    encode, plain = packing.Encoder.of(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert encode.by_words
    for t in ("a <|endoftext|> b", "naïve  東京\n\n x's", "", "<|endoftext|>"):
        assert np.frombuffer(encode(t), encode.type).tolist() == plain.encode(t, add_special_tokens=False).ids
