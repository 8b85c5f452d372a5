"""The text operators: exact placements, planted leaks against brute force, subjects of texts with known ones."""

import os
import random

import pytest

from engine.llm import leaks, normal, packing, subjects

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.01")


def test_p8_every_token_is_placed_once(spark):
    sizes = packing.measured(spark.read.parquet(f"{DATA}/documents.parquet")).cache()
    for shard_tokens in (packing.SHARD_TOKENS, 30_000):
        rows = packing.pack(sizes, shard_tokens=shard_tokens).collect()
        of, fill = {}, {}
        for r in rows:
            of.setdefault(r.doc_id, []).append(r)
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        want = {r.doc_id: r.n for r in sizes.collect()}
        assert {d: sum(r.n_tokens for r in p) for d, p in of.items()} == want
        assert max(fill.values()) <= packing.CAPACITY
        assert all(len(p) == 1 for d, p in of.items() if want[d] <= packing.CAPACITY)
        assert all(len(p) == -(-want[d] // packing.CAPACITY) for d, p in of.items() if want[d])
    sizes.unpersist()


def test_p8_dirty(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (4, "word " * 30_000), (5, "a b"), (6, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS shard")
    n = {r.doc_id: r.n for r in packing.measured(df).collect()}
    assert set(n) == {1, 3, 4, 5, 6} and n[3] == 0 and n[4] >= 30_000 and n[6] > 1
    packed = packing.pack(packing.measured(df)).collect()
    assert {r.doc_id for r in packed} == set(n)
    assert packing.pack(packing.measured(df.where("false"))).count() == 0


def test_p8_bounds_lose_least():
    h = {5: 10, 6: 3, 9: 4, 16: 2}
    cost = lambda b: sum(c * (16 / (16 // next(x for x in b if x >= n)) - n) for n, c in h.items())
    best = min((cost((i, j, 16)), (i, j, 16)) for i in range(1, 16) for j in range(i + 1, 16))
    assert cost(packing.bounds(h, 16, 3)) == pytest.approx(best[0])


@pytest.mark.parametrize("text", ["Frost-tender  WORDS, don't\nbreak", "frost-\ntender words dont br​eak", "<p>frost-tender</p> **words** don’t break", "frоst-tender wоrds don't bre­ak", "> frost-ten-\n> der words don't break"])
def test_p9_one_spelling(text):
    assert normal.words(text) == ["frosttender", "words", "dont", "break"]


def test_p9_against_brute_force(spark):
    """Documents with id divisible by 50, against all items, judged without the candidate search: recall is 1."""
    parts, vocabulary = leaks.items_of(spark.read.parquet(f"{DATA}/eval_items.parquet"))
    codes = leaks.encoded(spark.read.parquet(f"{DATA}/documents.parquet"), vocabulary)
    by = {}
    for item, _, own in parts:
        by.setdefault(item, []).append(own)
    want = {(i, r.doc_id) for r in codes.where("doc_id % 50 = 0").collect() for i, p in by.items() if leaks.leaked(p, r.codes, [range(0, len(r.codes), leaks.STEP)] * len(p))}
    got = {(r.item_id, r.doc_id) for r in leaks.found(spark, DATA).collect()}
    assert got and want <= got


def test_p9_rules(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    a, b = [" ".join(rng.sample(words, 22)) + "." for _ in range(2)], [" ".join(rng.sample(words, 24)) + "." for _ in range(2)]
    shared = "please answer the question below with care and in full sentences using only your own words every time."
    items = [(k, f"{shared} {a[k % 2]} {b[k % 2]}", None) for k in range(2)] + [(k, f"{shared} q{k} r{k}", "x") for k in range(2, 8)] + [(9, None, None)]
    parts, vocabulary = leaks.items_of(spark.createDataFrame(items, "item_id bigint, question string, answer string"))
    one = [p for i, _, p in parts if i == 0]
    judge = lambda t: leaks.leaked(one, [vocabulary.get(w, -1) for w in normal.words(t)], [range(0, len(t.split()), leaks.STEP)])
    first = a[0].rstrip(".").split()
    assert judge("pad " * 40 + " ".join(first[:14]) + " pad" * 9) and not judge("pad " * 40 + " ".join(first[:13]) + " pad" * 9)
    altered = (a[0] + " " + b[0]).replace(".", "").split()
    five, nine = list(altered), list(altered)
    for i in range(4, 46, 9):
        five[i] = "pad"
    for i in range(2, 46, 5):
        nine[i] = "pad"
    assert judge(" ".join(five[22:]) + " pad" * 30 + " " + " ".join(five[:22])) and not judge(" ".join(nine))
    assert not judge(shared) and not judge("")


def test_p10_known_subjects(spark):
    """All subjects occur, long posts of each language have one, chatter has none. On sf0.1: the 33 German and 65 Spanish
    posts of sf0.01 are too few to learn a language's words from (there 8 of 13 long German posts get a subject)."""
    data = os.environ.get("TEST_DATA_SUBJECTS", "/root/testdata/sf0.1")
    guide = spark.read.parquet(f"{data}/subject_guide.parquet").collect()
    got = {}
    for r in subjects.found(spark, data).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert {s for x in got.values() for s in x} == {r.subject for r in guide}
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang IN ('en', 'de', 'es')").collect()
    for lang in ("en", "de", "es"):  # every language's longer posts have subjects, short thanks have none
        long = [d.doc_id for d in docs if d.lang == lang and sum(len(w) for _, w in subjects.tagged(d.text)) > 40]
        assert sum(x in got for x in long) > 0.8 * len(long) > 0
    assert not any(d.doc_id in got for d in docs if d.text.strip() in ("+1", "Works, cheers.", "Bump.", "Thanks, that did it."))


def test_p10_prose():
    t = "First one. Second\nline of it!\n\n```\ncode = 1\n```\n<pre><code>x y</code></pre> See [this page](http://a.b/c). ¿Y esto?"
    assert [len(s) for s in subjects.prose(t)] == [2, 4, 3, 1]
    assert subjects.prose("") == [] and subjects.tagged("    x = 1") == []
