"""Language identification by a string kernel.

A text is the set of its character n-grams of orders 1 to 4 (hashed); the kernel of two texts
is the number of shared n-grams over the root of both sizes. A sample of training texts serves as
Nystroem landmarks, one ridge regression per language is fitted on them, and the
landmarks and regressions are folded into one matrix, so that scoring is a product of a batch
of presence rows with it.

The matrix is rounded so that every sum of its entries is exact, whatever the order: a text has the same score alone and in any
batch. Kernels of training texts are counts, exact too, and the rest of the fit keeps to one order of sums.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing could be
learned; ties go to the first language in sorted order; repeated rows score alike, and count each in training, where
those of one id are taken in the order of their texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common

BITS = 15
ORDERS = 4
#: Training texts a language and in all, and landmarks, at most (the texts with the smallest hashes of their doc_id).
TRAIN_PER_LANG, TRAIN_ROWS, LANDMARKS = 300, 3000, 300
RIDGE = 1e-2
#: Binary places of the matrix: 2**BITS entries below 2**GUARD sum up exactly in 53 bits.
PLACES, GUARD = 30, 8
BATCH = 64


def ngrams(text: str) -> np.ndarray:
    """Presence of the hashed n-grams of a whole text, as a row of booleans."""
    row = np.zeros(1 << BITS, bool)
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        row[h >> np.uint32(32 - BITS)] = True
    return row


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of all rows of both; the counts are whole numbers below 2**24, so products of floats give them exactly."""
    shared = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    root = lambda x: np.sqrt(np.maximum(1, x.sum(1, dtype=np.int64)))
    return shared / root(a)[:, None] / root(b)[None, :]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a positive definite system by Cholesky's method, row by row in a fixed order of sums."""
    a, b = a.copy(), b.copy()
    n = len(a)
    for k in range(n):
        a[k, k] = np.sqrt(max(a[k, k], 1e-300))
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[None, k + 1 :, k]
    for k in range(n):
        b[k] /= a[k, k]
        b[k + 1 :] -= a[k + 1 :, k, None] * b[None, k]
    for k in reversed(range(n)):
        b[k] /= a[k, k]
        b[:k] -= a[k, :k, None] * b[None, k]
    return b


def coefficients(rows: np.ndarray, pick: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Of the landmarks, for each column of ``y``: least weighted squares plus ``ridge`` times the squared norm of the function."""
    cross, inner = kernel(rows, rows[pick]), kernel(rows[pick], rows[pick])
    left = np.zeros_like(inner)
    right = np.zeros((len(pick), y.shape[1]))
    for k in range(0, len(rows), 64):  # small products, each summed in numpy's own order
        part = cross[k : k + 64] * weight[k : k + 64, None]
        left += np.einsum("ij,ik->jk", part, cross[k : k + 64])
        right += np.einsum("ij,ik->jk", part, y[k : k + 64])
    jitter = 1e-9 * (1 + np.trace(left) / len(pick))
    return solve(left + ridge * inner + jitter * np.eye(len(pick)), right)


def fit(rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and the folded matrix (n-gram buckets x languages)."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((1 << BITS, 0))
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.maximum(1, (y > 0).sum(0))[np.argmax(y, 1)]  # every language weighs the same
    pick = np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int)
    c = coefficients(rows, pick, y, weight, ridge)
    matrix = np.zeros((1 << BITS, len(names)))
    for k, i in enumerate(pick):
        found = np.flatnonzero(rows[i])
        matrix[found] += c[k] / np.sqrt(max(1, len(found)))
    top = float(1 << GUARD)
    return names, np.clip(np.round(matrix * 2.0**PLACES) / 2.0**PLACES, -top, top)


def predict(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if names and has_letter(t)]
    for k in range(0, len(known), BATCH):
        part = known[k : k + BATCH]
        rows = np.stack([ngrams(texts[i]) for i in part]).astype(np.float64)
        out = np.round((rows @ matrix) / np.sqrt(np.maximum(1, rows.sum(1, keepdims=True))), 9)
        best = out.argmax(1)
        for j, i in enumerate(part):
            langs[i], scores[i] = names[best[j]], round(min(1.0, max(0.0, float(out[j, best[j]] + 1) / 2)), 9)
    return langs, scores


def train(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG, total: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on ``labelled`` (doc_id, text, lang), from each language as many texts as the bounds allow.

    The share of a language that is taken follows from its count: rows whose hash falls below it, and that with
    the smallest hash in any case. So every language is learned; beyond ``total`` / 2 languages the texts grow with them.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = common.staged(usable.groupBy("lang").agg(F.count("*").alias("_n"), F.min(place).alias("_first")), "languages")
    n_langs = counts.count()
    if not n_langs:
        return fit(np.zeros((0, 1 << BITS), bool), [])
    each = max(2, min(per_lang, total // n_langs))

    def make():
        return lambda c: [c[0], c[2], [np.packbits(ngrams(t)).tobytes() for t in c[1]]]

    taken = (place < F.lit(float(each)) / F.col("_n")) | (place == F.col("_first"))
    few = usable.select("doc_id", "text", "lang").join(F.broadcast(counts), "lang").where(taken).select("doc_id", "text", "lang")
    got = common.map_rows(few, make, "doc_id long, lang string, bits binary").toArrow()
    bits, langs, ids = got["bits"].to_pylist(), got["lang"].to_pylist(), got["doc_id"].to_pylist()
    order = sorted(range(len(bits)), key=lambda i: (langs[i], ids[i] is None, ids[i] or 0, bits[i]))
    rows = np.stack([np.unpackbits(np.frombuffer(bits[i], np.uint8)).astype(bool) for i in order]) if len(order) else np.zeros((0, 1 << BITS), bool)
    return fit(rows, [langs[i] for i in order])


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        names, matrix = shared.value
        return lambda c: [c[0], *predict(c[1], names, matrix)]

    return common.map_rows(documents.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.remainder(F.col("doc_id"), 4) == 2
    model = train(documents.where(~held))
    return identify(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
