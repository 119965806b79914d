"""Extraction, neighbours and media copies."""

import math

import numpy as np
import pytest

from loomspark.llm import op1_html, op6_ann, op10_media
from loomspark.llm.html_pages import labelled_page
from pyspark.sql import functions as F


def test_held_out_layouts():
    model, wrong, total = op1_html.default_model(), 0, 0
    for seed in range(50_000, 50_150):
        page, gold = labelled_page(seed)
        cut = op1_html.blocks(page)
        wrong += sum(a != b for a, b in zip(op1_html.label_blocks(cut, gold), model.decode(cut)))
        total += len(cut)
    assert wrong / total < 0.01


def test_viterbi_is_the_best_path():
    model = op1_html.default_model()
    cut = op1_html.blocks(labelled_page(77)[0])[:9]
    score = [sum(model.weights.get(f, 0.0) for f in b.features) for b in cut]

    def value(path):
        total = model.ends[path[0]] + model.ends[2 + path[-1]] + sum(s for s, y in zip(score, path) if y)
        return total + sum(model.edges[a, b] for a, b in zip(path, path[1:]))

    paths = [[k >> i & 1 for i in range(len(cut))] for k in range(1 << len(cut))]
    assert math.isclose(value(model.decode(cut)), max(map(value, paths)))


PAGE = """<!DOCTYPE html><title>T</title><body><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A title &amp; more</h1><p>First paragraph,
 with <b>bold <a href="/y>z">link</a> and&nbsp;entities &lt;3.<br>Same block.<p>Second paragraph is here.<script>if (a < b) {"</p>"}</script></p>
<div class="ad">Buy now!</div><p>Third paragraph ends it.</p></article><section class="comments"><h3>Comments</h3><p>Nice article. I like it.</p></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; 2024 All rights reserved.</footer>"""


def test_extract(spark):
    want = "A title & more\n\nFirst paragraph, with bold link and entities <3. Same block.\n\nSecond paragraph is here.\n\nThird paragraph ends it."
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<script>var a", "x"), (5, "<!-- open", "x"), (6, "< a <b <" * 2000, "x")]
    out = op1_html.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [r.text for r in out if r.page_id == 1] == [want, want]
    assert all(r.text == "" for r in out if r.page_id in (2, 3, 4, 5)) and len(out) == 7
    assert op1_html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("small", (False, True))
def test_neighbours_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_ROWS", 64), ("TILE_ROWS", 3), ("CHUNK_ROWS", 7), ("HELD_ROWS", 500)):
            monkeypatch.setattr(op6_ann, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:90] = x[0]  # ties
    ids = np.arange(400)
    ids[390:] = ids[:10]  # ids on two rows with different vectors, queries among them
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]
    bad = [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [float("nan")] + [1.0] * 23, 1), (1060, [None] + [1.0] * 23, 1), (1080, [], 1), (1100, [float("inf")] * 24, 1), (None, [1.0] * 24, 1)]
    odd = [(2000, [1.0, 2.0], 1), (2001, [3.0, 1.0], 1)]
    all_rows = rows + rows[:3] + bad + odd  # and rows repeated whole
    df = spark.createDataFrame(all_rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in op6_ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault((r.query_id, r.query_row), []).append((r.rank, r.vec_id, r.score))
    d, names = np.concatenate([x, x[:3]]).astype(float), np.concatenate([ids, ids[:3]])
    want = {}
    for at in np.flatnonzero(names % 20 == 0):
        score = np.einsum("ij,j->i", d, d[at])
        order = [i for i in np.lexsort((names, -np.round(score, 12))) if i != at][:20]
        want.setdefault(int(names[at]), []).append([(rank + 1, int(names[i]), round(float(score[i]), 9)) for rank, i in enumerate(order)])
    found = {}
    for (q, _), hits in got.items():
        found.setdefault(q, []).append([(a, b, round(c, 9)) for a, b, c in sorted(hits)])
    assert found.pop(2000) == [[(1, 2001, 5.0)]]
    assert {q: sorted(v) for q, v in found.items()} == {q: sorted(v) for q, v in want.items()} and len(want[0]) == 3
    assert op6_ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 33)), rng.normal(size=(70, 33)) * rng.uniform(0.01, 9, (70, 1))
    b[3] *= 1e200
    sides = []
    for first, x in ((0, a), (100, b)):
        codes, *rest = op6_ann.quantise(x)
        sides.append(op6_ann.Side(np.arange(first, first + len(x)), codes.tobytes(), *rest))
    lower, upper = op6_ann.tile(sides[0], slice(0, 50), sides[1])
    assert ((lower <= a @ b.T) & (a @ b.T <= upper)).all()


def scene(seed, n=140):
    x = np.random.default_rng(seed).normal(size=(1, n, n)).astype(np.float32)
    for _ in range(8):
        x = op10_media._blur(x)
    return np.clip(128 + 45 * x[0] / x.std(), 0, 255)


def pgm(x):
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + np.clip(x, 0, 255).astype(np.uint8).tobytes()


def png(x, kind):
    import struct
    import zlib

    x = np.clip(x, 0, 255).astype(np.uint8)
    lines = b""
    for y, row in enumerate(x):
        left = np.concatenate(([0], row[:-1])).astype(np.uint8)
        up = x[y - 1] if y else np.zeros_like(row)
        line = {0: row, 1: row - left, 2: row - up}[kind]
        lines += bytes([kind]) + line.astype(np.uint8).tobytes()
    chunk = lambda k, v: struct.pack(">I", len(v)) + k + v + struct.pack(">I", zlib.crc32(k + v))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_decoders():
    x = np.floor(scene(1, 30))
    for media in (pgm(x), png(x, 0), png(x, 1), png(x, 2)):
        assert np.array_equal(op10_media.decode(media), x)
    assert op10_media.decode(b"junk") is None and op10_media.decode(None) is None and op10_media.decode(pgm(x)[:40]) is None


def test_copies(spark):
    rows, truth = [], {}
    rng = np.random.default_rng(0)
    for i in range(25):
        s, base = scene(i), 1000 + 10 * i
        painted = s.copy()
        painted[50:80, 50:90] = 128
        kinds = [s, s[20:110, 15:120], s * 0.8 + 20, s + rng.normal(0, 3, s.shape), np.rot90(s), painted, op10_media._resize(s[None], 1.5)[0], s]
        for k, x in enumerate(kinds):
            rows.append((base + k, pgm(x), 1))
            truth[base + k] = base
    rows += [(1, None, 1), (2, None, 1), (3, b"junk", 1), (4, b"junk", 1), (5, pgm(np.full((64, 64), 9.0)), 1), rows[0]]
    out = op10_media.find_copies(spark.createDataFrame(rows, "media_id long, media binary, component_id int")).collect()
    got = {r.media_id: r.component_id for r in out}
    assert len(out) == len(rows) and {k: got[k] for k in range(1, 6)} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    hits = sum(got[k] == v for k, v in truth.items())
    assert hits >= 0.95 * len(truth) and all(got[k] // 10 == v // 10 for k, v in truth.items())
    assert op10_media.find_copies(spark.createDataFrame([], "media_id long, media binary")).count() == 0
