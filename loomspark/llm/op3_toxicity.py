"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled pages: one on windows of ordinary text, one on
toxic spans. Toxic pages are mostly ordinary text, so the toxic spans are the words whose
contexts (distinct neighbour pairs, so that copies of a page count once) lean to toxic pages by a
likelihood-ratio test; and the toxic model holds the ordinary dictionary too, so that its only
gain is on toxic spans. Each window of a page is compressed under both. A page's evidence is how
many windows save at least so many bytes, for a ladder of savings, and the largest savings; a
logistic fit on pages that the dictionaries have not seen turns it into a probability, which sets
the thresholds.

Learning reads at most ``SAMPLE_ROWS`` labelled pages of each class, of ``SAMPLE_BYTES`` together at
most, in the order of a hash of the id, and never the held-out fold; all windows of these pages are
learned from. Every page is scored over its whole text.

Edge cases: null and empty texts have no windows and score as a page without evidence; an id labelled
both ways counts as toxic, and an id on several rows is learned once; a word of any length is one
window, of which the last 256 KB find matches; where a class has no labelled page every score is the labelled share of class 1 (0 without labels);
repeated rows get equal scores; very long texts are read window by window; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, labelled_sample, lean, sent_text, slices

#: Labelled pages of each class that learning reads, at most.
SAMPLE_ROWS = 3000
#: Bytes of the labelled pages of each class, at most; pages of over a hundredth of that are not learned from.
SAMPLE_BYTES = 24 << 20
#: Words of a window, and words from one window to the next.
WINDOW, STRIDE = 6, 3
ORDINARY_BYTES = 1 << 16
#: A toxic span: likelihood ratio and rate ratio of its contexts, toxic against ordinary.
LEAST_G, LEAST_RATE = 20.0, 5.0
SAVINGS = (2, 3, 4, 5, 6, 8, 11)
CUTOFF = 0.3
_EDGES = ".,;:!?\"'()[]*#$%&|"


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def words_of(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGES))]


def toxic_spans(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, float]:
    """Words whose distinct contexts lean to toxic pages, with their likelihood ratio."""
    number = {"": 0}
    for p in (*toxic, *ordinary):
        for w in p:
            number.setdefault(w, len(number))
    names, size = list(number), len(number)

    def contexts(pages):
        """Of each word the distinct (word before, word, word after), and how many there are of all."""
        pairs, after = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for p in pages:
            at = np.array([0, *(number[w] for w in p), 0], dtype=np.int64)
            pairs.append(at[:-2] * size + at[1:-1])
            after.append(at[2:])
        pairs, after = np.concatenate(pairs), np.concatenate(after)
        order = np.lexsort((after, pairs))
        pairs, after = pairs[order], after[order]
        seen = pairs[np.append(True, (pairs[1:] != pairs[:-1]) | (after[1:] != after[:-1]))[: len(pairs)]]
        counts = np.bincount(seen % size, minlength=size)
        return Counter({names[i]: int(counts[i]) for i in np.flatnonzero(counts)}), max(1, len(seen))

    (ft, nt), (fo, no) = contexts(toxic), contexts(ordinary)
    out = {}
    for word, a in ft.items():
        b = fo[word]
        if a < 3 or a / nt <= LEAST_RATE * b / no:
            continue
        mean = (a + b) / (nt + no)
        g = 2 * sum(o * np.log(o / e) for o, e in ((a, nt * mean), (nt - a, nt * (1 - mean)), (b, no * mean), (no - b, no * (1 - mean))) if o)
        if g > LEAST_G:
            out[word] = g
    return out


def _train(size: int, samples: list[bytes], step: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=step).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _windows(words: list[str], stride: int = STRIDE) -> list[bytes]:
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, max(1, len(words) - WINDOW + stride), stride)] if words else []


def train_dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[bytes, bytes]:
    rng = np.random.default_rng(0)
    samples = [w for p in ordinary for w in _windows(p, WINDOW)]
    samples = [samples[i] for i in rng.permutation(len(samples))]
    common = _train(ORDINARY_BYTES, samples, 48)
    spans = toxic_spans(toxic, ordinary)
    ranked = sorted(spans, key=lambda w: (spans[w], w))
    own = [f" {w} ".encode() for p in toxic for w in p if w in spans]
    learned = _train(1 << 12, own, 16) if own else b""
    # Whole spans stand nearest, the strongest last: the trainer keeps only a cover of them.
    return common, common + learned + b"".join(f" {w}".encode() for w in ranked) + b" "


@lru_cache(maxsize=4)
def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=16, search_log=6, min_match=6, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def evidence(words: list[str], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Windows (log of one plus the count) that save at least so much under the toxic dictionary, and the two largest savings."""
    plain, own = _compressor(ordinary), _compressor(toxic)
    saved = np.fromiter((len(plain(w)) - len(own(w)) for w in _windows(words)), dtype=np.int64)
    counts = [np.log1p((saved >= s).sum()) for s in SAVINGS]
    top = np.sort(np.append(np.maximum(saved, 0), [0, 0]))[-2:]
    return np.array([*counts, top[1] / 8, top[0] / 8, np.log1p(len(saved)) / 4, 1.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column, the intercept, is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[int, str, int]], counts: dict[int, int]) -> ToxicityModel:
    """A model from (id, text, label) rows; ``counts`` are the labelled pages of each class there are."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    seen: set[str] = set()
    one: dict[str, str] = {}  # a string for each word, however often it stands
    pages: dict[int, list[list[str]]] = {0: [], 1: []}
    for _, text, label in sorted(sample):
        if text not in seen:
            seen.add(text)
            pages[label].append([one.setdefault(w, w) for w in words_of(text)])
    if min(len(pages[0]), len(pages[1])) < 6:
        return ToxicityModel(b"", b"", (), prior)
    held = {y: p[2::3] for y, p in pages.items()}
    rest = {y: [d for i, d in enumerate(p) if i % 3 != 2] for y, p in pages.items()}
    ordinary, toxic = train_dictionaries(rest[1], rest[0])
    x = np.array([evidence(p, ordinary, toxic) for y in (0, 1) for p in held[y]])
    y = np.repeat([0, 1], [len(held[0]), len(held[1])])
    w = fit_logistic(x, y)
    # The sample's classes are not in the corpus's proportion: move the odds to it.
    w[-1] += np.log(prior / (1 - prior)) - np.log(len(held[1]) / len(held[0]))
    return ToxicityModel(ordinary, toxic, tuple(w), prior)


def score_text(text: str | None, model: ToxicityModel) -> float:
    if not model.weights:
        return float(model.prior)
    z = float(evidence(words_of(text), model.ordinary, model.toxic) @ np.array(model.weights))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    keep = id_crc() % 4 != 2
    sample = labelled_sample(docs, labels, "toxic", keep, sample_rows, SAMPLE_BYTES).collect()
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & keep).groupBy("toxic").count().collect()
    return fit([(r["doc_id"], r["text"], r["y"]) for r in sample], {r["toxic"]: r["count"] for r in known})


def score(docs: DataFrame, model: ToxicityModel, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the score of its ``text`` as ``name``, which replaces a column of that name."""
    columns = [c for c in columns if c != name]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    read, text = sent_text(docs, columns)

    @lean
    def run(batches):
        for batch in slices(batches):
            scores = [score_text(t.as_py(), sent.value) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, name])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` double"])
    return docs.select(*read).mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
