"""Quality scoring by Bradley-Terry pairwise ranking.

Each text has a fixed number of features. Every document labelled 1 is set against every one
labelled 0; the chance that the first wins is the logistic function of the difference of their
strengths, strength being linear in the features, so the logistic loss on feature differences gives
the weights. No row is left out and no pair: pairs are counted by bins of strength. The threshold is the quantile of strengths that leaves the labelled share of zeros
below; the score is the logistic function of the strength less the threshold.

Defined results: null and empty texts have zero features and get a score like any other. Without
labels of both kinds every score is 0.5. Rows with a null label make no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch
from feedloom.llm.samples import label_counts
from feedloom.llm.textarrays import NOT_SPACE, Texts, byte_table, texts

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "lower", "digit", "high", "space", "stops",
    "marks", "odd_marks", "shouts", "odd_ends", "lone_marks", "upper_words", "repeated_next", "distinct", "line_words", "stop_ends",
]

TRAINING_PARTS = 32
FINE, COARSE = 512, 64

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "high": bytes(range(128, 256)),
    "space": b" \t\n\x0b\x0c\r",
    "stops": b".,;:?",
    "marks": b"'\"()-_/",
    "odd_marks": b"#$%&*+<=>@[\\]^`{|}~",
    "shouts": b"!",
}


def features(part: Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(part)
    size = np.diff(part.offsets)
    out = np.zeros((n, len(FEATURES)))
    named = {name: out[:, i] for i, name in enumerate(FEATURES)}
    bounds = part.offsets
    names = list(_CLASSES)
    kind = np.full(256, len(names), np.uint8)
    for i, name in enumerate(names):
        kind[byte_table(_CLASSES[name])] = i
    kinds = kind[part.data]
    for i, name in enumerate(names):
        before = np.concatenate([[0], np.cumsum(kinds == i)])
        named[name][:] = (before[bounds[1:]] - before[bounds[:-1]]) / np.maximum(size, 1)
    starts, ends, first = part.spans(NOT_SPACE)
    words = np.diff(first)
    named["log_bytes"][:] = np.log1p(size)
    named["log_words"][:] = np.log1p(words)
    if len(starts) == 0:
        return out
    per = np.maximum(words, 1)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[first[1:]] - sums[first[:-1]]

    length = ends - starts
    named["word_bytes"][:] = np.log1p(total(length) / per)
    some = words > 0
    named["longest_word"][some] = np.log1p(np.maximum.reduceat(length, first[:-1][some]))
    last, opening = kinds[ends - 1], kinds[starts]
    odd, shout, upper, stop = names.index("odd_marks"), names.index("shouts"), names.index("upper"), names.index("stops")
    named["odd_ends"][:] = total((last == odd) | (last == shout)) / per
    named["stop_ends"][:] = total(last == stop) / per
    named["lone_marks"][:] = total((length == 1) & (last >= stop) & (last <= shout)) / per
    named["upper_words"][:] = total((opening == upper) & (length > 1) & (kinds[np.minimum(starts + 1, len(kinds) - 1)] == upper)) / per
    hashes = part.span_hashes(starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][some]] = False
    named["repeated_next"][:] = total(again) / per
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    named["distinct"][:] = np.where(some, np.bincount(owner[order], fresh, minlength=n) / per**0.9, 0)
    lines = np.concatenate([[0], np.cumsum(part.data == 10)])
    named["line_words"][:] = np.log1p(words / (1 + lines[bounds[1:]] - lines[bounds[:-1]]))
    return out


def feature_column(text: Column) -> Column:
    """The features of a text column as an array of doubles."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = [np.empty((0, len(FEATURES)))] + [features(part) for part in texts(column)]
            flat = np.concatenate(rows)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compute, "array<double>")(text)


@dataclass
class QualityModel:
    weights: np.ndarray
    threshold: float

    def score(self, row: Column) -> Column:
        """Of an array of features; plain column arithmetic."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(strength_of(self.weights, row) - F.lit(self.threshold))))


def fit_quality(
    featured: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    features_col: str = "features",
    label_col: str = "quality",
) -> QualityModel:
    """Fit on all labelled rows; `featured` has ids and feature arrays.

    Of rows that share an id one takes part, an id of both labels goes with 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    counts = label_counts(known, "label")
    nothing = QualityModel(np.zeros(len(FEATURES)), 0.0)
    if len(counts) < 2:
        return nothing
    own = known.filter("id is not null").groupBy("id").agg(F.min("label").alias("label"))
    # one row of an id is chosen before the join, so that no id is hot
    rows = featured.select(F.col(id_col).alias("id"), F.col(features_col).alias("x")).groupBy("id")
    rows = rows.agg(F.min_by("x", F.xxhash64("x")).alias("x")).join(own, "id")
    rows, _ = write_scratch(rows.select("label", "x").repartition(TRAINING_PARTS), "training")
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return nothing
    weights = bradley_terry(rows)
    return QualityModel(weights, _threshold(rows.select("label", strength_of(weights, F.col("x")).alias("s")), counts, found))


def strength_of(weights: np.ndarray, row: Column) -> Column:
    """Of an array of features; plain column arithmetic."""
    strength = F.lit(0.0)
    for i, w in enumerate(weights.tolist()):
        strength = strength + F.lit(w) * row[i]
    return strength


def _summed(rows: DataFrame, tally: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `tally(x, y)`, an array of fixed size, over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = total + tally(x, batch.column("label").to_numpy())
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    return sum(np.frombuffer(r["total"]) for r in rows.mapInArrow(add, "total binary").collect())


def _grouped(key: np.ndarray, groups: int, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` by key."""
    out = np.zeros((groups, values.shape[1]))
    order = np.argsort(key, kind="stable")
    own, first = np.unique(key[order], return_index=True)
    out[own] = np.add.reduceat(values[order], first)
    return out


def _bin(strength: np.ndarray, bins: int) -> np.ndarray:
    """Bins of equal width near 0, ever wider ones away from it."""
    return np.clip(np.floor(np.arcsinh(strength) * (bins / 16) + bins / 2), 0, bins - 1).astype(np.int64)


def bradley_terry(rows: DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """Weights of least logistic loss over all pairs of a row labelled 1 and one labelled 0.

    Newton steps, each one pass over `label, x`. The loss of a pair depends on the strengths alone, so
    the rows are tallied by label and bin of strength, and each pair of bins counts with the pairs of rows in it, at
    the mean strengths of the bins (FINE of them for the slope, 1/32 wide near 0; COARSE ones for the curvature).
    """
    k = len(FEATURES)
    origin = np.array(rows.first()["x"])
    shifted = _summed(rows, lambda x, y: np.concatenate([[len(x)], (x - origin).sum(axis=0), ((x - origin) ** 2).sum(axis=0)]))
    offset = shifted[1 : k + 1] / shifted[0]
    spread = np.sqrt(np.maximum(shifted[k + 1 :] / shifted[0] - offset**2, 0))
    spread[spread < 1e-9] = 1.0
    mean = origin + offset
    w = np.zeros(k)

    def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = (x - mean) / spread
        strength, one = z @ w, np.ones((len(z), 1))
        fine = _grouped(_bin(strength, FINE) + FINE * y, 2 * FINE, np.hstack([one, z]))
        key = _bin(strength, COARSE) + COARSE * y
        squares = np.zeros((2 * COARSE, k, k))
        for own in np.unique(key):
            squares[own] = z[key == own].T @ z[key == own]
        coarse = _grouped(key, 2 * COARSE, np.hstack([one, z]))
        return np.concatenate([fine.ravel(), coarse.ravel(), squares.ravel()])

    def lost(sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts, sums and, by pairs of bins, the chance that the row labelled 0 wins."""
        n, total = sums[:, :, 0], sums[:, :, 1:]
        s = total @ w / np.maximum(n, 1)
        return n, total, 1 / (1 + np.exp(np.clip(s[1][:, None] - s[0][None, :], -60, 60)))

    for _ in range(25):
        sums = _summed(rows, tally)
        fine, coarse, squares = np.split(sums, [2 * FINE * (k + 1), 2 * (FINE + COARSE) * (k + 1)])
        n, total, lose = lost(fine.reshape(2, FINE, k + 1))
        pairs = n[0].sum() * n[1].sum()
        slope = ridge * w - ((lose @ n[0]) @ total[1] - (n[1] @ lose) @ total[0]) / pairs
        n, total, lose = lost(coarse.reshape(2, COARSE, k + 1))
        bend, squares = lose * (1 - lose), squares.reshape(2, COARSE, k, k)
        cross = total[1].T @ bend @ total[0]
        curve = np.tensordot(bend @ n[0], squares[1], 1) + np.tensordot(n[1] @ bend, squares[0], 1) - cross - cross.T
        step = np.linalg.solve(curve / pairs + ridge * np.eye(k), slope)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    # sums go in any order: their last digits are left out
    return np.array([float(f"{v:.6g}") for v in w / spread])


def _threshold(strengths: DataFrame, counts: dict, found: dict) -> float:
    """The quantile of `label, s` that leaves the share of label 0 in `counts` below.

    Rows `found` weigh as much as the labelled rows they stand for. Exact: counts by ever narrower ranges of strength.
    """
    weight = {label: counts[label] * found[1 - label] for label in (0, 1)}
    goal = counts[0] * found[0] * found[1]
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    below, above, inside = 0, high, strengths
    while True:
        part = F.floor((F.col("s") - F.lit(low)) * (1024 / (high - low))) if high > low else F.lit(0)
        counted = inside.groupBy(part.alias("part")).agg(
            F.min("s").alias("low"), F.max("s").alias("high"), *(F.count_if(F.col("label") == i).alias(f"n{i}") for i in (0, 1))
        )
        bins = sorted(counted.collect(), key=lambda r: r["low"])
        for i, row in enumerate(bins):
            mass = row["n0"] * weight[0] + row["n1"] * weight[1]
            if below + mass >= goal or i == len(bins) - 1:
                break
            below += mass
        above = bins[i + 1]["low"] if i + 1 < len(bins) else above
        if row["low"] == row["high"]:
            # of rows as strong those labelled 1 come last
            last = below + mass - weight[1 if row["n1"] else 0] < goal
            return (row["low"] + (above if last else row["low"])) / 2
        low, high = row["low"], row["high"]
        inside = strengths.filter(F.col("s").between(low, high))
