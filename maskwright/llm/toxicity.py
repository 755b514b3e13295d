"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Distinct n-grams of a text are hashed into buckets. Over a bounded sample of the labelled rows, documents of either
label are counted for each bucket (summed in ranges of buckets, never as a whole in one place); the buckets whose
log-count ratio is surest become features, and a logistic regression on the scaled features is fitted by quasi-Newton
steps, each a Spark job that sums gradients over the partitions. Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import frugal, in_arrow, slices, texts_of, with_column
from .spark_util import cut

#: Lengths of the n-grams, and bits of a bucket number.
SIZES, BITS = (2, 3, 4, 5), 20
#: Labelled rows that the classifier is fitted to, at most (about); they are drawn by a hash of their id.
SAMPLE_ROWS = 16_384
#: Buckets that become features, at most, and ranges in which buckets are counted.
FEATURES, RANGES = 1 << 13, 64
#: Added to each count of a ratio; penalty on squared weights; weight of a toxic row in the loss; quasi-Newton steps.
SMOOTH, PENALTY, BALANCE, STEPS = 1.0, 1.0, 2.0, 30
#: Characters that are hashed at once; n-grams that reach over the seams are not lost.
PIECE_CHARS = 1 << 17
_MULTIPLIER, _SPREAD = np.uint64(0x9DDFEA08EB382D69), np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Distinct n-gram buckets of texts, without sorting: the last place that a bucket is written marks it."""

    def __init__(self, sizes: tuple[int, ...] = SIZES, bits: int = BITS):
        self.sizes, self.shift = sizes, np.uint64(64 - bits)
        self.place, self.stamp, self.text = np.zeros(1 << bits, np.int32), np.full(1 << bits, -1, np.int64), 0

    def distinct(self, text: str) -> np.ndarray:
        """The buckets of ``text``, lower-cased and with a space at either end; in no particular order."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.text += 1
        most, out = max(self.sizes), []
        for start in range(0, len(codes), PIECE_CHARS):
            piece = codes[start : start + PIECE_CHARS + most - 1]
            hashed, found = np.zeros(len(piece), np.uint64), []
            for n in range(1, most + 1):
                hashed = hashed[: len(piece) - n + 1] * _MULTIPLIER + piece[n - 1 :] + np.uint64(n)
                if n in self.sizes:
                    found.append(((hashed[:PIECE_CHARS] * _SPREAD) >> self.shift).astype(np.int64))
            found = np.concatenate(found)
            at = np.arange(len(found), dtype=np.int32)
            self.place[found] = at
            found = found[self.place[found] == at]
            if len(codes) > PIECE_CHARS:
                found = found[self.stamp[found] != self.text]
                self.stamp[found] = self.text
            out.append(found)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``weights`` by bucket (those of features are not 0) and the constant ``bias``."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        grams = Grams(bits=len(self.weights).bit_length() - 1)
        sums = np.array([self.weights[grams.distinct(t)].sum() for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))


def _count(rows: DataFrame, bits: int) -> DataFrame:
    """``bucket, pos, neg``: documents of either label with the bucket, packed by range of buckets."""
    width = (1 << bits) // RANGES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(bits=bits), np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                for text, label in zip(texts_of(part, "text"), part.column(part.schema.get_field_index("label")).to_pylist(), strict=True):
                    counts[label, grams.distinct(text)] += 1
        pairs = [(r, counts[:, r * width : (r + 1) * width]) for r in range(RANGES)]
        pairs = [(r, c.tobytes()) for r, c in pairs if c.any()]
        yield pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in pairs], pa.int64()), "packed": pa.array([c for _, c in pairs], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, width), np.int64)
        for batch in table.to_batches(max_chunksize=16):
            for p in batch.column(1).to_pylist():
                total += np.frombuffer(p, np.int32).reshape(2, width)
        held = np.flatnonzero(total.sum(0) >= 3)
        return pa.table({"bucket": held + table["range"][0].as_py() * width, "pos": total[1, held], "neg": total[0, held]})

    return in_arrow(rows.select("text", "label"), partial, "range long, packed binary").groupBy("range").applyInArrow(frugal(add), "bucket long, pos long, neg long")


def _loss(features: DataFrame, weights: np.ndarray, balance: float) -> tuple[float, np.ndarray]:
    """Logistic loss of ``weights`` (the last is the bias) over all rows, and its gradient; positive rows weigh ``balance``."""
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, loss = shared.value, 0.0
        gradient = np.zeros(len(w))
        for batch in batches:
            packed = batch.column(0).to_pylist()
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            columns, y = np.frombuffer(b"".join(packed), np.int32), batch.column(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            margin = np.bincount(row, w[columns], minlength=len(sizes)) + w[-1]
            sign, mass = 2.0 * y - 1, np.where(y == 1, balance, 1.0)
            loss += float((mass * np.logaddexp(0, -sign * margin)).sum())
            slope = -sign * mass / (1 + np.exp(np.clip(sign * margin, -500, 500)))
            gradient += np.bincount(columns, np.repeat(slope, sizes), minlength=len(w))
            gradient[-1] += slope.sum()
        yield pa.RecordBatch.from_pydict({"loss": pa.array([loss]), "gradient": pa.array([gradient.tobytes()], pa.binary())})

    rows = in_arrow(features.select("packed", "label"), partial, "loss double, gradient binary").collect()  # one row a partition of the bounded sample
    shared.destroy()
    return sum(r.loss for r in rows), np.sum([np.frombuffer(bytes(r.gradient)) for r in rows], axis=0)


def _fit(features: DataFrame, ratio: np.ndarray, balance: float, penalty: float, steps: int) -> np.ndarray:
    """Weights of the scaled features, by limited-memory quasi-Newton steps with backtracking."""
    scale = np.append(ratio, 1.0)

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _loss(features, v * scale, balance)
        shrunk = np.append(v[:-1], 0)
        return loss + penalty / 2 * float(shrunk @ shrunk), gradient * scale + penalty * shrunk

    at = np.zeros(len(scale))
    f, g = value(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, terms = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d = d - a * y
            terms.append(a)
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12))
        for (s, y), a in zip(past, reversed(terms), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, float(g @ d)
        for _ in range(12):
            f_new, g_new = value(at + step * d)
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g_new - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-8:]
        small, at, f, g = f - f_new < 1e-4 * f, at + s, f_new, g_new
        if small:
            break
    return at * scale


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, bits: int = BITS, penalty: float = PENALTY, balance: float = BALANCE, steps: int = STEPS) -> Model:
    """A model fitted to at most about ``sample_rows`` of the texts that ``labels`` marks 0 or 1.

    Other labels and null ids are left out; of several labels of a document the largest holds; null counts as the
    empty text. Without rows of both labels the model gives every text their share (0.5 without any).
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).join(marks, F.col("row_id") == F.col("label_id"))
    n = marks.count()
    dice = F.pmod(F.xxhash64("row_id", F.lit("sample")), F.lit(1 << 30))
    rows = known.where(dice < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30)))
    rows = rows.select("text", "label").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = cut(rows)
    n_pos, n_neg = (rows.where(F.col("label") == k).count() for k in (1, 0))
    if not n_pos or not n_neg:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        return Model(np.zeros(1 << bits, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    ratio = F.log((F.col("pos") + SMOOTH) / (n_pos + 2 * SMOOTH)) - F.log((F.col("neg") + SMOOTH) / (n_neg + 2 * SMOOTH))
    counted = _count(rows, bits).withColumn("ratio", ratio)
    sure = F.abs("ratio") * F.sqrt((F.col("pos") + SMOOTH) * (F.col("neg") + SMOOTH) / (F.col("pos") + F.col("neg") + 2 * SMOOTH))
    best = counted.orderBy(sure.desc(), "bucket").limit(FEATURES).select("bucket", "ratio").toPandas().sort_values("bucket")
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)
    number = np.full(1 << bits, -1, np.int32)
    number[buckets] = np.arange(len(buckets), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def pick(texts: list[str]) -> list[bytes]:
        grams, out = Grams(bits=bits), []
        for t in texts:
            own = shared.value[grams.distinct(t)]
            out.append(np.sort(own[own >= 0]).tobytes())
        return out

    features = cut(with_column(rows, "text", "packed", "binary", pick, drop=True))
    fitted = _fit(features, ratios, balance, penalty, steps)
    weights = np.zeros(1 << bits, np.float32)
    weights[buckets] = fitted[:-1]
    return Model(weights, float(fitted[-1]))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", drop: bool = False) -> DataFrame:
    """``docs`` (without its text if ``drop``) with ``score_col``: from 0 to 1, higher where toxic is likelier.

    Null counts as the empty text, which has the model's constant. Other columns stay; one named ``score_col`` is
    replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_column(docs, text_col, score_col, "double", lambda texts: shared.value.scores(texts).tolist(), drop=drop)
