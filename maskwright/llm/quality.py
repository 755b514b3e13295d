"""Quality scores: a regularised quadratic discriminant over statistics of a text.

A text is counted once: characters of each class, words, repeats, lines. Counts become shares that a typical text
smooths, so that short texts are near it, and are transformed to be nearly normal (square roots of shares, logarithms of
lengths). Each class has a mean and a covariance, shrunk towards a sphere; the score is the odds of the two densities, by
Mahalanobis distances under Cholesky factors that the model keeps inverted. Fitting sums counts, moments and products
over all labelled texts in Spark: nothing is sampled and only sums reach the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrow_rows import in_arrow, with_column
from .spark_util import cut
from .words import Words

#: What is counted: a share's name, what it is a share of, and how much a typical text weighs in it.
COUNTED = (
    ("letters", "chars", 200), ("capitals", "letters", 200), ("digits", "chars", 200), ("stops", "chars", 200), ("symbols", "chars", 200),
    ("repeats", "words", 40), ("distinct", "words", 40), ("length", "words", 40), ("square", "words", 40), ("short", "words", 40), ("titles", "words", 40), ("lines", "words", 40),
)
FIELDS = ("chars", "words", *(name for name, _, _ in COUNTED))
#: Weight of the sphere in a covariance, and how many standard deviations a statistic may be from the mean.
SHRINK, REACH = 0.05, 8.0
#: Words among which distinct ones are counted, longest short word in bytes, characters that are looked up at once.
SPAN, SHORT, PIECE = 64, 3, 1 << 18
#: Classes of characters; those beyond the table are symbols.
SMALL, CAPITAL, DIGIT, BLANK, STOP, SYMBOL = range(6)
STOPS = ".,;:?'\"-()"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full((1 << 16) + 1, SYMBOL, np.uint8)
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))
        if kind in ("Lu", "Lt"):
            out[code] = CAPITAL
        elif kind[0] in "LM":
            out[code] = SMALL
        elif kind[0] == "N":
            out[code] = DIGIT
        elif kind[0] == "Z" or chr(code).isspace():
            out[code] = BLANK
    out[[ord(c) for c in STOPS]] = STOP
    return out


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)


def statistics(texts: list[str]) -> np.ndarray:
    """``FIELDS`` of each text."""
    table, chars = _classes(), np.zeros((len(texts), 6))
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, text in enumerate(texts):
        for a in range(0, len(text), PIECE):
            chars[i] += np.bincount(table[_codes(text[a : a + PIECE])], minlength=6)
    offsets = np.cumsum([0, *map(len, encoded)])
    flat = np.frombuffer(b"".join(encoded), np.uint8)
    words, n = Words(flat, offsets), len(texts)
    per_text = lambda hit: np.bincount(words.text[hit], minlength=n)
    count = np.bincount(words.text, minlength=n)
    same = _as_before(words.text, words.hash)
    # distinct words of each span of a text
    span = (np.arange(len(words)) - (np.cumsum(count) - count)[words.text]) // SPAN
    order = np.lexsort((words.hash, span, words.text))
    new = ~_as_before(words.text[order], span[order], words.hash[order])
    size = (words.end - words.start).astype(np.float64)
    titled = table[_initials(flat, words.start)] == CAPITAL
    lines = np.array([e.count(b"\n") for e in encoded])
    shares = {
        "chars": chars.sum(axis=1), "words": count, "letters": chars[:, SMALL] + chars[:, CAPITAL], "capitals": chars[:, CAPITAL], "digits": chars[:, DIGIT], "stops": chars[:, STOP],
        "symbols": chars[:, SYMBOL], "repeats": per_text(same), "distinct": np.bincount(words.text[order][new], minlength=n), "length": np.bincount(words.text, size, minlength=n),
        "square": np.bincount(words.text, size**2, minlength=n), "short": per_text(size <= SHORT), "titles": per_text(titled), "lines": lines,
    }
    return np.stack([shares[f] for f in FIELDS], axis=1).astype(np.float64)


def _as_before(*columns: np.ndarray) -> np.ndarray:
    """Rows that equal the one before them."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _initials(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Code points that begin at ``start`` (those beyond the table as its end)."""
    at = lambda k: flat[np.minimum(start + k, max(len(flat) - 1, 0))].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    a, b, c = at(0), at(1) & 63, at(2) & 63
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 1 << 16)))
    return np.minimum(code, 1 << 16)


@dataclass(frozen=True)
class Model:
    """``typical`` shares, mean and deviation of the statistics, and of each class: its mean, inverse Cholesky factor,
    and the constant of its log density. Without classes the score is ``share``."""

    share: float
    typical: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def scores(self, counted: np.ndarray) -> np.ndarray:
        """Of rows of ``FIELDS``."""
        if not self.classes:
            return np.full(len(counted), self.share)
        z = standard(transformed(counted, self.typical), self.centre, self.spread)
        low, high = (constant - ((z - mean) @ factor.T) ** 2 @ np.ones(z.shape[1]) / 2 for mean, factor, constant in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def transformed(counted: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Smoothed shares of ``FIELDS``, nearly normal; words by mean and deviation of their length."""
    at = {f: i for i, f in enumerate(FIELDS)}
    shares = {}
    for (name, of, weight), usual in zip(COUNTED, typical, strict=True):
        shares[name] = (counted[:, at[name]] + weight * usual) / (counted[:, at[of]] + weight)
    deviation = np.sqrt(np.maximum(shares.pop("square") - shares["length"] ** 2, 0))
    length = shares.pop("length")
    return np.stack([*(np.sqrt(x) for x in shares.values()), np.log1p(length), np.log1p(deviation)], axis=1)


def standard(values: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((values - centre) / spread, -REACH, REACH)


def _shaped(counted: DataFrame, then: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``label`` and the statistics ``z0 ..`` that ``then`` makes of counts."""
    n = len(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = then(np.stack([batch.column(i + 1).to_numpy() for i in range(len(FIELDS))], axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values.T)], names=["label", *(f"z{i}" for i in range(n))])

    return in_arrow(counted.select("label", *FIELDS), run, "label int, " + ", ".join(f"z{i} double" for i in range(n)))


def _moments(rows: DataFrame, by: list[str]) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of the statistics, for each value of ``by``; sums alone reach the driver."""
    d = len(COUNTED)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    means, products = [F.avg(f"z{i}").alias(f"m{i}") for i in range(d)], [F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy(*by).agg(F.count("*").alias("n"), *means, *products).collect():
        covariance = np.zeros((d, d))
        for i, j in pairs:
            covariance[i, j] = covariance[j, i] = r[f"c{i}_{j}"]
        out[tuple(r[c] for c in by)] = r["n"], np.array([r[f"m{i}"] for i in range(d)]), covariance
    return out


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``statistics`` (``FIELDS`` in order) in place of the text; null counts as the empty text.

    Other columns stay; one named ``statistics`` is replaced. Texts are read here alone: fitting and scoring take what
    is counted, and a join of labels moves no text.
    """
    kind = pa.list_(pa.float64())
    return with_column(docs, text_col, "statistics", "array<double>", lambda texts: pa.array(list(statistics(texts)), kind), drop=True)


def train_quality(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = SHRINK) -> Model:
    """A model fitted to all documents of ``measured`` that ``labels`` marks 0 or 1.

    Other labels and null ids are left out; of several labels of a document the largest holds. With rows of one label
    alone, or none, the model gives every document their share (0.5 without any).
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = measured.select(F.col(id_col).alias("row_id"), "statistics").join(marks, F.col("row_id") == F.col("label_id"))
    counted = cut(known.select("label", *(F.col("statistics")[i].alias(f) for i, f in enumerate(FIELDS))))
    found = {r.label: r.n for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_low, n_high = found.get(0, 0), found.get(1, 0)
    share, none = (n_high / (n_low + n_high) if found else 0.5), np.zeros(0)
    if not n_low or not n_high:
        return Model(share, none, none, none, ())
    # the typical share of the texts that have any of what it is a share of
    usual = counted.agg(*(F.percentile_approx(F.try_divide(name, of), 0.5).alias(name) for name, of, _ in COUNTED)).first()
    typical = np.array([x or 0.0 for x in usual])
    _, centre, covariance = _moments(_shaped(counted, lambda c: transformed(c, typical)), [])[()]
    spread = np.sqrt(np.diag(covariance)) + 1e-9
    moments = _moments(_shaped(counted, lambda c: standard(transformed(c, typical), centre, spread)), ["label"])
    classes = []
    for label in (0, 1):
        n, mean, covariance = moments[(label,)]
        shrunk = (1 - shrink) * covariance + (shrink * np.trace(covariance) / len(mean) + 1e-6) * np.eye(len(mean))
        factor = np.linalg.cholesky(shrunk)
        classes.append((mean, np.linalg.inv(factor), float(np.log(n / (n_low + n_high)) - np.log(np.diag(factor)).sum())))
    return Model(share, typical, centre, spread, tuple(classes))


def score_quality(measured: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """``measured`` with ``score_col`` in place of its statistics: from 0 to 1, higher where label 1 is likelier.

    An empty text scores as a typical one. Other columns stay; one named ``score_col`` is replaced. An empty table
    gives an empty table.
    """
    shared = measured.sparkSession.sparkContext.broadcast(model)
    others = [f for f in measured.schema.fields if f.name not in ("statistics", score_col)]
    schema = StructType([*others, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            counted = column("statistics").flatten().to_numpy().reshape(-1, len(FIELDS))
            columns = [column(f.name) for f in others] + [pa.array(shared.value.scores(counted))]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return in_arrow(measured, run, schema)
