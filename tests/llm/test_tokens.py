"""Packing and BPE against the libraries and brute force."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspark.llm import op2_packing as pk
from loomspark.llm import op4_bpe as bp

TEXTS = [None, "", "a", "Hello, world! it's 2024 <|endoftext|> x", "été größe　日本 ́é", "same text", "same text", "x" * 9000, "word " * 5000, "\x00\x1f   İ ς Σ"]
RNG = random.Random(4)
TEXTS += ["".join(RNG.choice(" \n\tabcS's12.theingÉß日ا́🙂") for _ in range(RNG.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(5, "same text", "clash", 7), (None, "no id", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")


def test_bpe_equals_library(docs):
    lib = Tokenizer.from_file(bp.default_path())
    rows = bp.encode_decode(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "no id") or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_and_verification():
    bpe = bp.SpeculativeBpe(bp.default_path())
    lib = Tokenizer.from_file(bp.default_path())
    words = ["".join(RNG.choice("theinganrst") for _ in range(RNG.choice((3, 7, 12, 90, 400)))) for _ in range(400)]
    assert [list(x) for x in bpe.encode_words(words)] == [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert 0 < bpe.failed < len(words)


def test_pack_round_trip(spark, docs):
    lib = Tokenizer.from_file(pk.default_paths()[0])
    pieces = pk.tokenize_pieces(docs)
    packed = pk.packed_documents(docs).collect()
    texts = Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            texts[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert texts == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    rest = []
    for length in sorted((r.length for r in packed), reverse=True):
        i = bisect.bisect_left(rest, length)
        bisect.insort(rest, (rest.pop(i) if i < len(rest) else 2048) - length)
    assert len(bins) == len(rest)
    whole = pk.assemble(pieces.filter("doc_id IS NOT NULL AND doc_id <> 5"), _kept(pieces))
    assert all(len(r.ids) == 4 * r.n_tokens <= 8192 for r in whole.collect())


def _kept(pieces):
    from loomspark.llm.common import durable

    return durable(pk.pack(durable(pieces.filter("doc_id IS NOT NULL AND doc_id <> 5").drop("ids"), "t")), "t")


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for top in (5, 60, 2048):
        lengths = rng.integers(1, top + 1, 2000).tolist()
        runs = pk.plan_runs(Counter(lengths), 2048)
        used = {b for r in runs.tolist() for b in range(r[4], r[4] - (-r[2] // r[3]))}
        rest = []
        for length in sorted(lengths, reverse=True):
            i = bisect.bisect_left(rest, length)
            bisect.insort(rest, (rest.pop(i) if i < len(rest) else 2048) - length)
        assert len(used) == len(rest) and runs[:, 2].sum() == len(lengths)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pk.packed_documents(none).count() == 0 and bp.encode_decode(none).count() == 0
