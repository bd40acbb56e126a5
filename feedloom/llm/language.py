"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) under an elastic net, then calibrated with one
temperature. Document frequencies count every training text; weights are fitted on a bounded sample
of labelled rows, `per_label` of each label. A text's score adds over its words, so applying the
model reads each text once and moves nothing.

Defined results: a null text, or one without a letter, is `und` with score 1. Rows with a null label
do not train. With no labelled row at all every text is `und` with score 0. Repeated rows count as
often as they occur. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.samples import one_row_each, sample_ids
from feedloom.llm.textarrays import texts
from feedloom.llm.wordgrams import GramCounter, linear_words

UNDETERMINED = "und"
SIZES = (1, 2, 3)
SCALE = 20.0  # term frequencies are shares; this brings them near one


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # buckets x labels, with the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float

    def predict(self, text: Column) -> Column:
        """A struct of `label` and `score` for a text column."""
        labels, weights, bias, temperature = self.labels, self.weights, self.bias, self.temperature

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = linear_words(weights, SIZES) if labels else None
            for column in batches:
                names, scores = [], []
                for part in texts(column):
                    if table is None:
                        has_letter = _has_letter(part)
                        names += [UNDETERMINED] * len(part)
                        scores.append(np.where(has_letter, 0.0, 1.0))
                        continue
                    sums, _ = table.sums(part)
                    total = sums[:, -1]
                    logits = (sums[:, :-1] * (SCALE / np.maximum(total, 1))[:, None] + bias) / temperature
                    chance = softmax(logits)
                    best = chance.argmax(axis=1)
                    names += [labels[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                    scores.append(np.where(total > 0, chance[np.arange(len(part)), best], 1.0))
                flat = np.concatenate(scores) if scores else np.empty(0)
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flat, pa.float64())], ["label", "score"])

        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(score, "label string, score double")(text)


def _has_letter(part) -> np.ndarray:
    return np.array([any(map(str.isalpha, part.raw(i).decode("utf-8", "replace"))) for i in range(len(part))], bool)


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def fit_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = 600,
    buckets: int = 1 << 14,
    epochs: int = 3,
    l1: float = 0.002,
    l2: float = 0.02,
) -> LanguageModel:
    """Fit on the rows of `docs` that have a text and a label.

    At most `per_label` rows of each label are drawn for the weights, a fifth of which calibrate the
    temperature instead; their sparse counts are what the driver gets. Of rows that share an id and a
    label one takes part. More than 1,000 labels are refused.
    """
    training = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(
        "text is not null and label is not null"
    )
    drawn = sample_ids(training, "id", "label", per_label)
    rows = one_row_each(training, drawn, "text").mapInArrow(_featurizer(buckets), "id string, label string, found array<int>, times array<int>").collect()
    if not rows:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0)
    idf = inverse_document_frequencies(training.select("text"), buckets)
    labels = sorted({r["label"] for r in rows})
    number = {name: i for i, name in enumerate(labels)}
    examples = []
    for r in sorted(rows, key=lambda r: hash_of(r["id"])):
        found, times = np.array(r["found"], np.int64), np.array(r["times"], np.float64)
        if len(found):
            examples.append((found, SCALE * times / times.sum() * idf[found], number[r["label"]]))
    aside = [e for i, e in enumerate(examples) if i % 5 == 4]
    weights, bias = ftrl([e for i, e in enumerate(examples) if i % 5 != 4], len(labels), buckets, epochs, l1, l2)
    logits = np.array([(values[:, None] * weights[found]).sum(axis=0) + bias for found, values, _ in aside])
    temperature = calibrate(logits, np.array([y for *_, y in aside])) if aside else 1.0
    return LanguageModel(labels, weights * idf[:, None], bias, temperature)


def hash_of(value: str) -> int:
    import zlib

    return zlib.crc32(str(value).encode()) * 2654435761 % (1 << 32)


def _featurizer(buckets: int):
    def features(batches):
        counter = GramCounter(SIZES, buckets)
        for batch in batches:
            found, times = [], []
            for own, n in counter.counts(batch.column("text")):
                found.append(own.astype(np.int32))
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pc.cast(batch.column("id"), pa.string()), pc.cast(batch.column("label"), pa.string()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["id", "label", "found", "times"],
            )

    return features


def inverse_document_frequencies(docs: DataFrame, buckets: int) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 of every bucket, over all texts; at most `buckets` sums reach the driver."""

    def count(batches):
        counter, seen, n = GramCounter(SIZES, buckets), np.zeros(buckets, np.int64), 0
        for batch in batches:
            for own, _ in counter.counts(batch.column("text")):
                seen[own] += 1
                n += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(seen[found], n))], ["bucket", "n"])

    sums = docs.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(buckets)
    total = 0
    for r in sums:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            seen[r["bucket"]] = r["n"]
    return np.log((1 + total) / (1 + seen)) + 1


def ftrl(examples, n_labels: int, buckets: int, epochs: int, l1: float, l2: float, alpha: float = 0.3, beta: float = 1.0):
    """FTRL-proximal, one example at a time: sparse weights (buckets x labels) and biases."""
    z, n = np.zeros((buckets + 1, n_labels)), np.zeros((buckets + 1, n_labels))

    def current(found):
        strength = np.where(found < buckets, l1, 0.0)[:, None]
        zs = z[found]
        return np.where(np.abs(zs) <= strength, 0.0, -(zs - np.sign(zs) * strength) / ((beta + np.sqrt(n[found])) / alpha + l2))

    for _ in range(epochs):
        for found, values, y in examples:
            found, values = np.append(found, buckets), np.append(values, 1.0)
            weights = current(found)
            gap = softmax((values @ weights)[None])[0]
            gap[y] -= 1.0
            slope = values[:, None] * gap
            pull = (np.sqrt(n[found] + slope**2) - np.sqrt(n[found])) / alpha
            z[found] += slope - pull * weights
            n[found] += slope**2
    everything = current(np.arange(buckets + 1))
    return everything[:-1], everything[-1]


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        chance = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(chance[np.arange(len(truth)), truth], 1e-12)).mean() + 1e-4 * log_t**2

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))
