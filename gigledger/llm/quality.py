"""Quality classifier: supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document is the mean of its features'
vectors, and a softmax over it gives the label. Each word also counts under a marker of how often
its own document repeats it, so that loops of any word look alike. Training is stochastic gradient
descent in numpy on a bounded sample, in one task; scoring needs one number per bucket, as the
difference of the two outputs is linear in the features.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled_sample
from .util import crc32_of_id, cut

BUCKET_BITS = 17
NGRAMS = (3, 4)
_P = 0x5851F42D4C957F2D
_P_BACK = pow(_P, -1, 2**64)
_SPACE = 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Features:
    """Bucket numbers of a whole text, vectorised over its code points."""

    def __init__(self):
        self.forth = self.back = np.ones(0, np.uint64)

    def _bucket(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h ^ np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32)
        code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(code)
        if n > len(self.forth):
            self.forth, self.back = _powers(_P, 2 * n), _powers(_P_BACK, 2 * n)
        space = code == _SPACE
        cuts = np.nonzero(space)[0]
        sums = np.cumsum(code * self.forth[:n], dtype=np.uint64)
        begin, end = cuts[:-1], cuts[1:]
        word = (sums[end - 1] - sums[begin]) * self.back[begin]
        parts = [self._bucket(word, 1)]
        for size in NGRAMS:
            if n < size:
                continue
            m = n - size + 1
            h = code[:m].copy()
            for k in range(1, size):
                h = h * np.uint64(_P) + code[k : k + m]
            inner = np.ones(m, bool)
            for k in range(1, size - 1):
                inner &= ~space[k : k + m]
            parts.append(self._bucket(h[inner], size))
        _, times = np.unique(word, return_counts=True)
        share = np.minimum(7, -np.log2(times / len(word))).astype(np.uint64)
        often = np.minimum(6, np.log2(times)).astype(np.uint64)
        parts.append(np.repeat(self._bucket(share * np.uint64(16) + often, 2), times))
        return np.concatenate(parts)


def train(texts: list[str | None], labels: list[int], dim: int = 16, epochs: int = 10, rate: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """(bucket scores, bias): the label-1 logit of a document is the mean of its bucket scores plus the bias."""
    rng = np.random.default_rng(seed)
    features = Features()
    rows = []
    for text in texts:
        found, counts = np.unique(features.of(text), return_counts=True)
        rows.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = ((rng.random((1 << BUCKET_BITS, dim), np.float32) - 0.5) * 2 / dim).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - done / steps)
            done += 1
            found, share = rows[i]
            mean = share @ vectors[found] if len(found) else np.zeros(dim, np.float32)
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(found):
                vectors[found] -= (lr * len(found) ** 0.5) * share[:, None] * (p @ output)[None, :]
            output -= lr * p[:, None] * mean[None, :]
            bias -= np.float32(0.1 * lr) * p
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def subword_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_mod: int = 3,
    held_out_is: int = 1,
    sample_rows: int = 4000,
) -> DataFrame:
    """Per input row: doc_id, held_out, score (0 to 1, probability of label 1), predicted.

    Labels are learnt only where crc32(doc_id) mod held_out_mod is not held_out_is, from at most
    sample_rows of them, half of each class at most (the documented bound); every row is scored on
    its whole text. A sampled id with several texts is learnt with its smallest. Null and blank
    texts get the score of the bias alone, without labels of both classes every score is 0.5.
    Repeated rows each give a row; null ids are dealt by the crc32 of the empty text; other columns
    are ignored.
    """
    held = (F.pmod(crc32_of_id("doc_id"), F.lit(held_out_mod)) == held_out_is).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.where(F.pmod(crc32_of_id(id_col), F.lit(held_out_mod)) != held_out_is)
    sample = rows.join(F.broadcast(labelled_sample(marked, id_col, label_col, sample_rows)), "doc_id")  # at most sample_rows ids
    sample = sample.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # one text each, however many rows share an id

    def fit(table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("doc_id").to_pylist(), table.column("label").to_pylist(), table.column("text").to_pylist()))
        found = {r[1] for r in order}
        scores, bias = train([r[2] for r in order], [r[1] for r in order]) if found == {0, 1} else (np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
        return pa.table({"scores": pa.array([scores.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    model = sample.select("doc_id", "label", "text").groupBy(F.lit(0).alias("one")).applyInArrow(fit, "scores binary, bias double").first()
    scores, bias = (np.frombuffer(bytes(model.scores), "<f4"), model.bias) if model else (np.zeros(1 << BUCKET_BITS, "<f4"), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((scores, bias))  # 2**BUCKET_BITS numbers

    def score(batches):
        scores, bias = shared.value
        features = Features()
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = features.of(text.as_py())
                logit = bias + (float(scores[found].mean(dtype=np.float64)) if len(found) else 0.0)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, logit)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
