"""Quality classifier: Bradley-Terry ranking of preference pairs over text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, id_crc

KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "pipe", "other")
_KIND = np.full(256, KINDS.index("other"), np.uint8)
for _name, _bytes in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "newline": b"\n", "stop": b".,;:", "mark": b"!?", "symbol": b"#$%&*+-/<=>@\\^_`~\"'()[]{}", "pipe": b"|"}.items():
    _KIND[list(_bytes)] = KINDS.index(_name)
FEATURES = (*(f"share_{k}" for k in KINDS), "log_words", "word_bytes", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "line_words", "long_words", "marked_words", "numeric_words", "packed", "short_stops")


def features(text: bytes) -> list[float]:
    """Numbers of one whole text; all but the counts of words are ratios. An empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=len(KINDS)) / len(text)
    words = text.lower().split()
    n = len(words) or 1
    count: dict[bytes, int] = {}
    for word in words:
        count[word] = count.get(word, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    size = sum(map(len, words))
    return [
        *kinds.tolist(), np.log1p(len(words)), size / n, len(count) / n, max(count.values(), default=0) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(c for w, c in count.items() if len(w) > 20) / n, sum(c for w, c in count.items() if not w[-1:].isalnum() and w[-1] < 128) / n,
        sum(c for w, c in count.items() if w[:1].isdigit()) / n, len(zlib.compress(text, 1)) / len(text), sum(c for w, c in count.items() if len(w) <= 4) / n,
    ]


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>), one row per row; null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text or b"") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(compute, rows.select("doc_id", F.array(F.lit(0.0)).alias("features")).schema)


@dataclass
class Ranking:
    """Weights of standardised features, and the mapping of a rank score to 0..1 at which `cut` lies on `at`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(self.at / (1 - self.at)), -50, 50)))


def rank_pairs(x: np.ndarray, good: np.ndarray, pairs: int, at: float, seed: int, ridge: float = 1e-3) -> Ranking:
    """Bradley-Terry: P(a before b) = sigmoid(w . (x_a - x_b)) fitted by Newton steps of the logistic loss over `pairs`
    pairs of a good and a bad row. The cut is the quantile of the rows' scores that leaves the share of bad rows below."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    w, slope = np.zeros(x.shape[1]), 1.0
    if len(yes) and len(no):
        rng = np.random.default_rng(seed)
        d = z[rng.choice(yes, pairs)] - z[rng.choice(no, pairs)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
            grad = d.T @ (p - 1) / pairs + ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        raw = z @ w
        share = len(no) / len(z)
        cut = float(np.quantile(raw, share, method="midpoint"))
        return Ranking(mean, scale, w, cut, slope, at)
    return Ranking(mean, scale, w, -1.0 if len(yes) or not len(no) else 1.0, slope, at)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pairs: int = 200_000, at: float = 0.3, folds: int = 5, held_out: int = 0, seed: int = 7) -> Ranking:
    """Learn from labelled rows whose crc32(doc_id as text) mod folds is not held_out.

    At most `sample` labelled rows, those of the smallest hash of doc_id, are used: a bounded sample of labels, and
    the only rows that the driver sees. Null qualities and labels of unknown documents are ignored; without both
    labels every document gets the same score, over the threshold unless all labels are 0.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    own = hashed_sample(own.where(F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) != held_out), "doc_id", sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = text_features(texts.join(F.broadcast(own.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(own), "doc_id").orderBy("doc_id").toPandas()
    x = np.array(rows["features"].to_list(), float).reshape(-1, len(FEATURES))
    good = rows["quality"].to_numpy() == 1
    return rank_pairs(x if len(x) else np.zeros((1, len(FEATURES))), good if len(x) else np.array([True]), pairs, at, seed)


def score_quality(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, _score, _predicted), or the columns `keep`, _score and _predicted: one row per row of docs, repeated or not.

    _score is in 0..1, higher for better texts; _predicted is 1 from model.at on, which ties with it included. Null texts
    count as empty; long ones are read whole; an empty table gives no rows. Other columns are ignored.
    """
    names = keep or [id_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(text or b"") for text in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, len(FEATURES))
            score = model.score(x)
            columns = [*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= model.at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_score", "_predicted"])

    rows = docs.select(*names, F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = rows.select(*names, F.lit(0.0).alias("_score"), F.lit(0).alias("_predicted")).schema
    return rows.mapInArrow(compute, schema)
