"""Toxicity scoring.

Every character n-gram of a text's words, and every word, has an embedding; a text is the average of
them, and a linear softmax over the average tells its class. Embeddings and softmax are trained
jointly in numpy (gradient descent on the log-loss) on a bounded sample of labelled rows. A misspelling that no
training text holds shares most n-grams with the word it comes from. As the softmax is linear, a
word's n-grams collapse to one number when the model is applied.

Defined results: null and empty texts, and texts without letters or digits, get the score of the bias
alone. Without rows of both labels every score is 0. Rows with a null label do not train.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.language import hash_of
from feedloom.llm.samples import label_counts, one_row_each, sample_ids
from feedloom.llm.textarrays import texts
from feedloom.llm.wordgrams import GramCounter, linear_words

SIZES = (3, 4, 5, 6)


@dataclass
class ToxicityModel:
    margins: np.ndarray  # of each bucket's embedding: its weight for class 1 less that for class 0
    bias: float
    shift: float  # log-odds of class 1 among the labelled rows, less those of the sample

    def score(self, text: Column) -> Column:
        weights, bias = self.margins[:, None], self.bias + self.shift

        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = linear_words(weights, SIZES, "letters and digits", whole=True)
            for column in batches:
                out = [np.empty(0)]
                for part in texts(column):
                    sums, _ = table.sums(part)
                    out.append(1 / (1 + np.exp(-np.clip(sums[:, 0] / np.maximum(sums[:, 1], 1) + bias, -700, 700))))
                yield pa.array(np.concatenate(out), pa.float64())

        apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(apply, "double")(text)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = 1500,
    buckets: int = 1 << 17,
    dims: int = 2,
    epochs: int = 45,
) -> ToxicityModel:
    """Fit on at most `per_label` labelled rows of each class; of rows that share an id one takes part."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    counts = label_counts(known, "label")
    nothing = ToxicityModel(np.zeros(buckets), -700.0, 0.0)
    if len(counts) < 2:
        return nothing
    drawn = sample_ids(known, "id", "label", per_label)

    def features(batches):
        counter = GramCounter(SIZES, buckets, "letters and digits", True)
        for batch in batches:
            found, times = [], []
            for own, n in counter.counts(batch.column("text")):
                found.append(own.astype(np.int32).tobytes())
                times.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pc.cast(batch.column("id"), pa.string()), batch.column("label"), pa.array(found, pa.binary()), pa.array(times, pa.binary())],
                ["id", "label", "found", "times"],
            )

    own = one_row_each(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), drawn, "text")
    rows = sorted(own.mapInArrow(features, "id string, label int, found binary, times binary").toLocalIterator(), key=lambda r: hash_of(r["id"]))
    truth = np.array([r["label"] for r in rows], np.float64)
    if len(set(truth.tolist())) < 2:
        return nothing
    found = [np.frombuffer(r["found"], np.int32) for r in rows]
    times = [np.frombuffer(r["times"], np.int32) for r in rows]
    del rows
    margins, bias = train(found, times, truth, buckets, dims, epochs)
    odds = np.log(counts[1] / counts[0]) - np.log(truth.sum() / (len(truth) - truth.sum()))
    return ToxicityModel(margins, bias, float(odds))


def train(found, times, truth, buckets: int, dims: int, epochs: int, rate: float = 1.0, scale: float = 40.0, seed: int = 7):
    """Embeddings and softmax together; returns each bucket's margin and the bias.

    An embedding is its bucket's inverse document frequency in the sample times a trained vector, so
    that rare n-grams learn as fast as frequent ones. Plain gradient descent with momentum: what few
    texts hold moves little. Buckets that fewer than three sampled texts hold keep no weight.
    """
    held = np.zeros(buckets, np.int32)
    for own in found:
        held[own] += 1
    rarity = np.log(len(found) / np.maximum(held, 1)).astype(np.float32)
    place = (np.cumsum(held >= 3) - 1).astype(np.int32)
    used = np.flatnonzero(held >= 3)
    prior = float(np.log(truth.sum() / (len(truth) - truth.sum())))
    if not len(used):
        return np.zeros(buckets), prior
    columns, shares = [], []
    for own, n in zip(found, times, strict=True):
        kept = held[own] >= 3
        columns.append(place[own[kept]])
        shares.append((scale / max(1, n.sum()) * n[kept] * rarity[own[kept]]).astype(np.float32))
    sizes = np.array([len(c) for c in columns], np.int64)
    flat, share = np.concatenate(columns), np.concatenate(shares)
    by_bucket = np.argsort(flat, kind="stable").astype(np.int32)
    text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_bucket]
    sorted_share, firsts = share[by_bucket], np.searchsorted(flat[by_bucket], np.arange(len(used), dtype=np.int32))
    del columns, shares, by_bucket
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (len(used), dims)).astype(np.float32)
    classes = (np.array([[-0.5, 0.5]]) * rng.choice([-1, 1], (dims, 1))).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moving = [np.zeros_like(p) for p in (vectors, classes, bias)]
    hot = np.column_stack([1 - truth, truth]).astype(np.float32)
    weight = (hot * (len(truth) / (2 * hot.sum(axis=0)))).sum(axis=1, keepdims=True) / len(truth)
    for _ in range(epochs):
        mean = np.column_stack([_text_sums(share * vectors[flat, d], sizes) for d in range(dims)])
        logits = mean @ classes + bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        gap = (chance - hot) * weight
        back = gap @ classes.T
        slopes = [
            np.column_stack([np.add.reduceat(sorted_share * back[text_of, d], firsts) for d in range(dims)]),
            mean.T @ gap,
            gap.sum(axis=0),
        ]
        length = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        for p, g, m in zip((vectors, classes, bias), slopes, moving, strict=True):
            m *= 0.9
            m += g / max(1.0, length)
            p -= rate * m
    margins = np.zeros(buckets)
    margins[used] = scale * rarity[used] * (vectors @ (classes[:, 1] - classes[:, 0]))
    return margins, float(bias[1] - bias[0]) + prior


def _text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.float32)
    some = sizes > 0
    out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out
