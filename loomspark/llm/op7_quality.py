"""Quality by a regularised quadratic discriminant.

A page becomes a vector of transformed statistics (lengths in logs, shares through an arcsine
root). Each class has a mean and a covariance shrunk towards the pooled one and its diagonal; its
Cholesky factor is computed once and cached with the model. The score is the difference of the
two log densities, from Mahalanobis distances, turned into a probability by a logistic fit on
labelled pages kept back from the means and covariances.

Learning reads at most ``SAMPLE_ROWS`` labelled pages of each class, in the order of a hash of the
id, and never the held-out fold; of those it collects the vectors alone.

Edge cases: null and empty texts have the vector of an empty page; where a class has too few
labelled pages every score is the labelled share of class 1 (0 without labels); repeated rows get
equal scores; very long texts are read whole; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, labelled_sample, lean, sent_text, slices
from .op3_toxicity import fit_logistic

SAMPLE_ROWS = 8000
#: Bytes of the labelled pages of each class, at most; pages of over a hundredth of that are not learned from.
SAMPLE_BYTES = 256 << 20
#: Weight of the pooled covariance in a class's, and of its diagonal; and the least variance.
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
CUTOFF = 0.3

_KIND = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"|\t", b"#$%&*+/<=>@\\^_`{}~[]", b"\n", b" "), 1):
    _KIND[list(_bytes)] = _kind
_LINES = re.compile(r"[.!?]?\s*\n\s*|[.!?]\s+")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    data = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=9)
    n, nw = max(1, len(data)), max(1, len(words))
    spans = [s for s in _LINES.split(text or "") if s]
    share = lambda x: float(np.arcsin(np.sqrt(min(1.0, max(0.0, x)))))
    heads = sum(1 for w in words if w[0].isupper())
    caps = sum(1 for w in words if w.isupper())
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(data)),
        np.log1p(n / nw),
        np.log1p(len(words) / max(1, len(spans))),
        share(kinds[1] / n),
        share(kinds[2] / n),
        share(kinds[3] / nw),
        share(kinds[4] / nw),
        share(kinds[5] / nw),
        share(kinds[6] / n),
        np.log1p(kinds[7]),
        share(len(set(words)) / nw),
        share(len(set(spans)) / max(1, len(spans))),
        share(heads / nw),
        share(caps / nw),
        share(repeats / nw),
        float(np.log(n / len(zlib.compress(data, 1)))),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Centre and scale of the vectors; for each class its mean, inverse Cholesky factor and log determinant; slope and shift."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    slope: float
    shift: float
    prior: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for rows of statistics."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (np.square((z - mean) @ inverse.T).sum(axis=1) + log_det) for mean, inverse, log_det in self.classes]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * _squash(self.difference(x)) + self.shift, -30, 30)))


def _squash(difference: np.ndarray) -> np.ndarray:
    """Log densities far out say little more than nearer ones."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> QualityModel:
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    none = QualityModel(np.zeros(0), np.ones(0), (), 0.0, 0.0, prior)
    back = np.arange(len(x)) % 4 == 3
    if len(x) == 0 or min((y[~back] == k).sum() for k in (0, 1)) < 6 or len(set(y[back])) < 2:
        return none
    xf, yf = x[~back], y[~back]
    centre, scale = xf.mean(axis=0), np.maximum(xf.std(axis=0), 1e-6)
    z = (xf - centre) / scale
    means = [z[yf == k].mean(axis=0) for k in (0, 1)]
    own = [np.cov(z[yf == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (yf == k).mean() for k, c in enumerate(own))
    classes = []
    for mean, cov in zip(means, own):
        cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        classes.append((mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    raw = QualityModel(centre, scale, tuple(classes), 1.0, 0.0, prior)
    d = _squash(raw.difference(x[back]))
    slope, shift = fit_logistic(np.column_stack([d, np.ones(len(d))]), y[back])
    odds = (y[back] == 1).mean()
    shift += np.log(prior / (1 - prior)) - np.log(odds / (1 - odds))
    return QualityModel(centre, scale, tuple(classes), float(slope), float(shift), prior)


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    keep = id_crc() % 5 != 0

    @lean
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", keep, sample_rows, SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in sample.mapInArrow(run, "doc_id long, y int, x array<double>").collect())
    # A fixed shuffle, so that what is kept back does not follow the order of ids.
    rows = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep).groupBy("quality").count().collect()
    return fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), {r["quality"]: r["count"] for r in known})


def score(docs: DataFrame, model: QualityModel, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and the score of its ``text`` as ``name``, which replaces a column of that name."""
    columns = [c for c in columns if c != name]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    read, text = sent_text(docs, columns)

    @lean
    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column(text)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sent.value.score(x), pa.float64())], [*columns, name])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` double"])
    return docs.select(*read).mapInArrow(run, schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
