"""Document quality: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from biflux.llm.common import utf8
from biflux.runtime import durable

N_STATS = 16
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDE = bytes(range(128, 256))
_MARKS, _SYMBOLS = b".,;:!?", b"#*$%&|<>@^~=+{}[]\\"


def document_stats(text: bytes) -> list[float]:
    """Shares and logarithms that describe a whole text; an empty one has zeros."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    size = len(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    marks = len(text.translate(None, _MARKS))
    endings = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
    return [
        math.log1p(n), sum(map(len, words)) / n, (size - len(text.translate(None, _SYMBOLS))) / size,
        (size - len(text.translate(None, _DIGITS))) / size, (size - len(text.translate(None, _UPPER))) / size,
        (size - marks) / n, (size - len(text.translate(None, _WIDE))) / size,
        len(counts) / n, counts.most_common(1)[0][1] / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), endings / len(lines),
        sum(len(w) <= 3 for w in counts) / len(counts), sum(len(w) >= 15 for w in counts) / len(counts),
        sum(c == 1 for c in counts.values()) / len(counts)]


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [document_stats(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["id", "stats"])

    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>")


class Features:
    """Random Fourier features: inner products approximate a Gaussian kernel over the scaled statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.weights = rng.normal(0.0, 1.0 / width, (N_STATS, size))
        self.shift = rng.uniform(0.0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.deviation, -6, 6)
        waves = np.cos(scaled @ self.weights + self.shift) * math.sqrt(2.0 / len(self.shift))
        return np.hstack([waves, scaled / 6, np.ones((len(stats), 1))])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_STATS)


def _normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows: every partition adds up its own, Spark adds the partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            z = features(_matrix(batch.column(0)))
            full = np.hstack([z, np.asarray(batch.column(1), dtype=float)[:, None]])
            total = total + full.T @ full
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    summed = rows.select("stats", F.col("label").cast("double")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = max((r.j for r in summed), default=-1) + 1
    full = np.zeros((n, n))
    for r in summed:
        full[r.i, r.j] = full[r.j, r.i] = r.v
    return full[:-1, :-1], full[:-1, -1]


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over (x, positives, rows) in order of x: block centres and their rates."""
    blocks: list[list[float]] = []
    for x, positive, n in sorted(points):
        blocks.append([x * n, positive, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def _scored(rows: DataFrame, features: Features, beta: np.ndarray, columns: list[str], curve=None) -> DataFrame:
    """Columns with the ridge score, or with the calibrated one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = features(_matrix(batch.column(0))) @ beta
            out = np.clip(np.interp(raw, *curve), 0, 1) if curve else raw
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.float64())], names=[*columns, "score"])

    rows = rows.select("stats", *columns)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, score double")


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          size: int = 192, width: float = 4.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> DataFrame:
    """(id, score): the higher, the likelier label 1; every row of ``docs`` has one.

    All given labels are learned (hold rows out before the call). Of repeated labels of an id the lowest counts; null
    labels and ids are none. Null texts are empty, an empty text has statistics of zero, repeated rows score alike; other
    columns are ignored. Without any label every score is 0.5. The driver sees a (size + 18)^2 matrix and ``bins`` counts.
    """
    stats = durable(statistics(docs, id_col=id_col, text_col=text_col))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    train = durable(stats.join(known, "id").select("stats", "label"))
    moments = train.select("label", *[F.col("stats")[k].alias(f"s{k}") for k in range(N_STATS)]).agg(
        F.count("*").alias("n"), *[F.avg(f"s{k}").alias(f"m{k}") for k in range(N_STATS)], *[F.stddev_pop(f"s{k}").alias(f"d{k}") for k in range(N_STATS)]).first()
    if not moments.n:
        return stats.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    mean = np.array([moments[f"m{k}"] for k in range(N_STATS)])
    deviation = np.array([moments[f"d{k}"] or 1.0 for k in range(N_STATS)])
    features = Features(mean, deviation, size, width, seed)
    products, target = _normal_equations(train, features)
    penalty = ridge * moments.n * np.eye(len(products))
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(products + penalty, target)
    raw = _scored(train, features, beta, ["label"])
    counted = raw.groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "score")) * bins / 3).alias("bin")).agg(
        F.avg("score").alias("x"), F.sum("label").alias("positive"), F.count("*").alias("n")).collect()
    curve = isotonic([(r.x, float(r.positive), float(r.n)) for r in counted])
    return _scored(stats, features, beta, ["id"], curve).withColumnRenamed("id", id_col)
