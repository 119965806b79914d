"""Copies in the query's own kind of image against all pairs, crowded buckets, and repeated ids."""

import numpy as np
import pytest
from loomspark.llm import op10_media


def rendered(spark, vectors):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return op10_media.render(df)


def images(media):
    """Spots and bits of each image."""
    out = {}
    for r in media.collect():
        n, x, y, scale, angle, bits = op10_media.describe(op10_media.decode(bytes(r.media))[None])
        out[r.media_id] = (np.stack([x, y, scale, angle], axis=1).astype(np.float32), np.packbits(bits.astype(bool), axis=1).view(np.uint64))
    return out


@pytest.mark.parametrize("rows", (4_000, 3))
def test_recall_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(op10_media, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = list(base)
    for v in base[:30]:  # from hardly changed to beyond what the rule accepts
        for cosine in (0.998, 0.99, 0.97, 0.93):
            w = rng.normal(size=64)
            w -= (w @ v) * v
            vectors.append(cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w))
    vectors += [base[0] + rng.normal(size=64) * 0.004 for _ in range(40)]  # one dense group
    media = rendered(spark, vectors)
    told = images(media)
    want = {(i, j) for i in told for j in told if i < j and op10_media.agree(told[i], told[j])}
    assert len(want) > 700 and any(i < 30 and 120 <= j < 240 for i, j in want)
    got = {r.media_id: r for r in op10_media.find_copies(media).collect()}
    joined = sum(got[i].component_id == got[j].component_id for i, j in want)
    sparse = {(i, j) for i, j in want if not ((i == 0 or i >= 240) and (j == 0 or j >= 240))}
    assert joined >= 0.95 * len(want) and sum(got[i].component_id == got[j].component_id for i, j in sparse) >= 0.9 * len(sparse)
    up = dict.fromkeys(told)  # and nothing is joined that no chain of agreeing pairs joins
    up = {i: i for i in told}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in want:
        lo, hi = sorted((find(i), find(j)))
        up[hi] = lo
    assert all(find(i) == find(r.component_id) for i, r in got.items()) and all(r.decoded for r in got.values())


def test_rows_of_one_id_are_images_of_their_own(spark):
    rng = np.random.default_rng(4)
    a, b = (r.media for r in rendered(spark, rng.normal(size=(2, 64))).collect())
    rows = [(1, bytes(a)), (1, bytes(b)), (2, bytes(b)), (3, bytes(a)), (3, bytes(a)), (3, None), (4, None), (5, b"P5 junk"), (None, bytes(a))]
    out = op10_media.find_copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert sorted((r.media_id, r.component_id, r.decoded) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, True), (3, 1, True), (3, 1, True), (3, 3, False), (4, 4, False), (5, 5, False)]


def test_tables_meet_over_the_radius():
    rng = np.random.default_rng(2)
    for flipped, least in ((8, 0.95), (14, 0.75), (20, 0.5), (24, 0.35)):
        bits = np.array([rng.permutation(op10_media.BITS)[:flipped] for _ in range(3_000)])
        met = np.zeros(len(bits), dtype=bool)
        for sample in op10_media._samples():
            met |= ~np.isin(bits, sample).any(axis=1)
        assert met.mean() >= least
