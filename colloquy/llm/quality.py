"""Quality classifier: support vectors over n-gram indicators that Naive Bayes has scaled.

Words and runs of marks are tokens; token unigrams, bigrams and a few repetition patterns are
indicators in a hashed space. Each indicator is scaled by the log ratio of its class
probabilities; a linear hinge-loss model is then fitted by dual coordinate descent, and the
margins of held-aside folds give the slope that turns a margin into a probability.

Sums are numpy's own, whose order doesn't depend on threads as that of a linear algebra library may, and scores are
rounded, so the same rows give the same scores in every run. The driver holds the indicators of the training rows as bytes,
at most 2**BITS bits a row (``TRAIN_ROWS`` * 32 KB in all).

Defined results: null and empty texts have no indicators, so their score is that of the
intercept; without labels of both classes every score is the share of label 1 (0.5 without any).
Repeated rows are scored alike, labels other than 0 and 1 are ignored; of an id's labels the greatest counts, of its texts the first
in their order, and ids whose hashes tie are taken by id.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
#: Labelled rows that the model is fitted on at most: those whose doc_id has the smallest hash.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
FOLDS = 3


class _Ids(dict):
    """Token to hashed id; forgets all once it is large, so a worker's memory is bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def indicators(text: str | None, ids: dict) -> np.ndarray:
    """The sorted hashed indicators of a whole text."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int32)
    h = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
    parts = [h * np.uint64(0x9E3779B1)]
    if len(h) > 1:
        parts.append(h[:-1] * np.uint64(0x85EBCA77) + h[1:] * np.uint64(0xC2B2AE3D) + np.uint64(1))
    found = [(p ^ (p >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS) for p in parts]
    marks = []
    for lag in (1, 2):
        same = h[lag:] == h[:-lag]
        run = same[: -4 or None].copy() if len(same) > 4 else np.zeros(0, bool)
        for k in range(1, 5):
            run &= same[k : k - 4 or None] if len(same) > 4 else run
        if run.any():
            marks.append(lag)
    found.append(np.array(marks, np.uint64))
    return np.unique(np.concatenate(found)).astype(np.int32)


class Rows:
    """Sorted indicators of many texts, each kept as numbers or as bits, whichever is shorter."""

    def __init__(self, kept: list[bytes | np.ndarray]):
        self.kept = kept

    def __len__(self) -> int:
        return len(self.kept)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.kept[i]) if isinstance(self.kept[i], bytes) else self.kept[i]

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def some(self, mask: np.ndarray) -> Rows:
        return Rows([self.kept[i] for i in np.flatnonzero(mask)])


def packed(found: np.ndarray) -> bytes:
    if 4 * len(found) <= (1 << BITS) // 8:
        return b"n" + found.astype("<i4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[found] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(kept: bytes) -> np.ndarray:
    if kept[:1] == b"n":
        return np.frombuffer(kept, "<i4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(kept, np.uint8, offset=1))).astype(np.int32)


def fit_hinge(rows: Rows | list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on indicators scaled by ``scale``; rows have unit length by count.

    Returns weights for unscaled indicators and the intercept. Each class weighs the same in sum. The weights are kept with the scale
    in them: an indicator's then moves by the step times its scale squared, and no row needs values of its own.
    """
    n = len(rows)
    bound = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    square = scale * scale
    norm = np.array([square[r].sum() / max(1, len(r)) + 1.0 for r in rows])
    alpha, w, b = np.zeros(n), np.zeros(len(scale)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            r = rows[i]
            root = np.sqrt(max(1, len(r)))
            gradient = y[i] * (w[r].sum() / root + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), bound[i])
            if step := (new - alpha[i]) * y[i]:
                w[r] += step / root * square[r]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < least:
            break
    return w, b


def log_count_ratio(rows: Rows | list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def margin(r: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    return float(weights[r].sum(dtype=np.float64)) / np.sqrt(max(1, len(r))) + intercept


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps."""
    pos = float((y > 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, s = p - t, p * (1 - p) + 1e-9
        grad_a, grad_b = (g * margins).sum() + 1e-3 * a, g.sum()
        aa, ab, bb = (s * margins * margins).sum() + 1e-3, (s * margins).sum(), s.sum()
        det = aa * bb - ab * ab
        step = np.array([(bb * grad_a - ab * grad_b) / det, (aa * grad_b - ab * grad_a) / det])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: Rows, labels: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(weights, intercept, slope, offset) from indicators and 0/1 labels."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        p = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p)))
    aside = np.zeros(len(y))
    for k in range(FOLDS):
        out = np.arange(len(y)) % FOLDS == k
        inner = rows.some(~out)
        if len(set(y[~out])) < 2:
            continue
        w, b = fit_hinge(inner, y[~out], log_count_ratio(inner, y[~out]))
        aside[out] = [margin(r, w, b) for r in rows.some(out)]
    w, b = fit_hinge(rows, y, log_count_ratio(rows, y))
    return (w.astype(np.float32), b, *platt(aside, y))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """Fit on at most ``train_rows`` labelled documents; ``labels`` has doc_id and label (0 or 1)."""
    spark = documents.sparkSession
    chosen = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    few = spark.createDataFrame([tuple(r) for r in chosen.collect()], "key long, label int")
    texts = documents.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(few), "key")

    def make():
        ids = _Ids()
        return lambda c: [c[0], c[2], [packed(indicators(t, ids)) for t in c[1]]]

    got = common.map_rows(texts.select("key", "text", "label"), make, "key long, label int, found binary").toArrow()
    kept, keys = got["found"].to_pylist(), got["key"].to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], kept[i]))
    return fit(Rows([kept[i] for i in order]), got["label"].to_numpy()[order])


def score(documents: DataFrame, model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        weights, intercept, slope, offset = shared.value
        ids = _Ids()

        def run(c):
            z = np.array([margin(indicators(t, ids), weights, intercept) for t in c[1]])
            return [c[0], np.round(1 / (1 + np.exp(-np.clip(slope * z + offset, -35, 35))), 6).tolist()]

        return run

    return common.map_rows(documents.select("doc_id", "text"), make, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = train(documents, labels.where(common.remainder(F.col("doc_id"), 5) != 0))
    return score(documents, model).select(
        "doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
