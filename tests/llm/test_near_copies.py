"""The pipeline's near-duplicates against brute force over five-word similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest
from loomspark.llm import near_copies, op8_simhash


def brute(texts):
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                lo, hi = sorted((find(a), find(b)))
                up[hi], links = lo, links + 1
    return {i: find(i) for i in sets}, links


def test_stage_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON_HITS", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = [word() for _ in range(12)]
    texts = ["", " \n ", "One", "one", "One two", "a b c d e", "A b c d e f"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice((6, 30, 120, 300)))] + line * (rng.random() < 0.5)
        texts.append(" ".join(base))
        for _ in range(4):  # edits of up to a tenth of the words: similarities on both sides of 0.8
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  ".join(copy))
    base = [word() for _ in range(60)]  # one dense group
    texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want, links = brute([(r[0], r[1]) for r in rows])
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "One", "en", "s", 3), (None, "One", "en", "s", 3), (None, "alone", "en", "s", 5)], schema)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(want.values())) and [r.text for r in got if r.doc_id is None] == ["alone"]
    assert links > len(set(want.values())) > 40
    found = {r.doc_id: r.head_id for r in near_copies.near_copies(docs).collect()}
    assert {i: c for i, c in found.items() if i is not None} == want


@pytest.mark.parametrize("rows", (5_000, 7))
def test_crowded_buckets_lose_no_link(spark, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", rows)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(90)]
    texts = []
    for _ in range(60):  # a passage shared by all, with too much or little enough around it, and edits
        own = [word() for _ in range(rng.choice((1, 6, 14, 30)))]
        base = own + passage
        for k in rng.sample(range(len(base)), rng.randint(0, 4)):
            base[k] = word()
        texts.append(" ".join(base))
    data = list(enumerate(texts))
    want, links = brute(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.head_id for r in near_copies.near_copies(docs).collect()} == want
    assert links > 20 and 5 < len(set(want.values())) < 60


def test_an_id_with_several_texts_loses_only_copies(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "g h i"), (2, "a b c"), (3, "d e f"), (3, "d e f"), (4, "g h i")], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c"), (1, "d e f"), (2, "g h i")]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
    same = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (7, None), (7, "")], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, same, "").count() == 2


def test_bitmap_bound_holds():
    rng = np.random.default_rng(5)
    for size in (3, 100, 400, 5_000):
        a = rng.integers(-(2**62), 2**62, size)
        b = np.concatenate([a[: size // 2], rng.integers(-(2**62), 2**62, size // 3)])
        x, y = (np.frombuffer(near_copies.bitmap(np.unique(t)), np.uint64) for t in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a) ^ set(b))


def test_what_simhash_joins_is_not_proposed_again(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(300)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    proposed, verified, near_links = [], near_copies.verified, near_copies.near_links

    def spy(pairs, *rest):
        asked = [tuple(r) for r in pairs.select("u", "v").collect()]
        links = verified(pairs, *rest)
        proposed.append((asked, [tuple(r) for r in links.collect()]))
        return links

    monkeypatch.setattr(near_copies, "verified", spy)
    want, _ = brute(data)
    found = {}
    for index in (True, False):
        proposed.clear()
        monkeypatch.setattr(near_copies, "near_links", near_links if index else lambda nodes, *rest: near_links(nodes.limit(0), *rest))
        assert {r.doc_id: r.head_id for r in near_copies.near_copies(docs).collect()} == want
        found[index] = list(proposed)
    (first, links), *later = found[True]
    assert links and not found[False][0][0]
    assert sum(len(asked) for asked, _ in later) < sum(len(asked) for asked, _ in found[False])
    up = {}

    def find(x):
        while x in up:
            x = up[x]
        return x

    for asked, links in found[True]:
        assert not any(find(u) == find(v) for u, v in asked)
        for u, v in links:
            if find(u) != find(v):
                up[find(u)] = find(v)


@pytest.mark.parametrize("crowded", [False, True])
def test_simhash_links_span_the_radius(spark, monkeypatch, crowded):
    if crowded:  # every block value with two prints is dealt again by finer keys
        monkeypatch.setattr(op8_simhash, "GROUP_ROWS", 1)
    rng, radius = random.Random(9), near_copies.RADIUS
    prints = {rng.getrandbits(64) for _ in range(200)}
    for fp in rng.sample(sorted(prints), 25):
        for _ in range(12):  # chains, whose ends are further apart than the radius
            for bit in rng.sample(range(64), rng.randint(1, radius + 2)):
                fp ^= 1 << bit
            prints.add(fp)
    prints = sorted(prints)
    signed = [(i, fp - (fp >> 63 << 64)) for i, fp in enumerate(prints)]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius]
    edges = [(r.u, r.v) for r in op8_simhash.near_links(spark.createDataFrame(signed, "node long, fp long"), radius, True).collect()]
    assert near and all((prints[u] ^ prints[v]).bit_count() <= radius for u, v in edges)

    def roots(links):
        parent = op8_simhash.fold(np.arange(len(prints)), *(np.array(x) for x in zip(*links)))
        return parent.tolist()

    assert roots(edges) == roots(near)


def test_texts_of_one_fingerprint_meet_in_a_star(spark):
    lead = spark.createDataFrame([(n, n % 2 * 7) for n in range(40)], "node long, fp long")
    pairs = sorted((r.u, r.v) for r in near_copies.simhash_links(lead).collect())
    assert sorted(pairs) == sorted([(n, n % 2) for n in range(2, 40)] + [(1, 0)])
