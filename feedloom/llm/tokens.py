"""Token counts by a linear longest-match automaton.

A word, with one space before it, is cut greedily into the longest pieces of a vocabulary. The
automaton is the vocabulary's trie with a failure link per node: where no child fits, the pieces that
are certain by then are popped and the walk goes on at the link. How many pieces a failure pops is
computed beforehand, so counting takes a constant number of steps per byte on average and builds no
piece. Each distinct word is walked once per task; its count is kept in a bounded table.

Words are what white space (space and bytes 9 to 13) separates; their bytes are taken unchanged.
Bytes that the vocabulary lacks count as one piece each.

Defined results: null and empty texts, and texts of white space, have no tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.textarrays import texts
from feedloom.llm.wordgrams import WordTable, add_up


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: a line holds a piece in base 64 and its rank. Read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class Automaton:
    """child[node << 8 | byte] -> node; the root is 0."""

    child: dict[int, int]
    link: list[int]
    pops: list[int]

    def count(self, text: bytes) -> int:
        child, link, pops = self.child.get, self.link, self.pops
        node, pieces = 0, 0
        for byte in text:
            to = child(node << 8 | byte)
            while to is None:
                if node == 0:  # not in the vocabulary: a piece of its own
                    pieces += 1
                    to = 0
                    break
                pieces += pops[node]
                node = link[node]
                to = child(node << 8 | byte)
            node = to
        while node:
            pieces += pops[node]
            node = link[node]
        return pieces


def build(pieces: list[bytes]) -> Automaton:
    """Nodes in order of depth; the link and pops of a node follow from those of its parent."""
    child, parent, byte_of, known, level = {}, [0], [0], [True], [0]
    for piece in sorted(set(pieces), key=lambda p: (len(p), p)):
        node = 0
        for byte in piece:
            to = child.get(node << 8 | byte)
            if to is None:
                to = child[node << 8 | byte] = len(parent)
                parent.append(node)
                byte_of.append(byte)
                known.append(False)
                level.append(level[node] + 1)
            node = to
        known[node] = True
    link, pops = [0] * len(parent), [0] * len(parent)
    for node in sorted(range(1, len(parent)), key=level.__getitem__):
        if known[node]:
            pops[node] = 1
            continue
        byte, at = byte_of[node], parent[node]
        popped = 0
        if at == 0:
            pops[node] = 1  # a first byte that is no piece itself stands alone
            continue
        while True:
            popped += pops[at]
            at = link[at]
            to = child.get(at << 8 | byte)
            if to is not None:
                link[node], pops[node] = to, popped
                break
            if at == 0:
                link[node], pops[node] = 0, popped + 1
                break
    return Automaton(child, link, pops)


def token_counts(spark: SparkSession, text: Column, pieces: list[bytes]) -> Column:
    """The number of pieces of a text column. The broadcast grows with the vocabulary alone."""
    shared = spark.sparkContext.broadcast(build(pieces))

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        table = WordTable(1, lambda words: np.array([[automaton.count(b" " + w)] for w in words], np.int64), np.int64)
        for column in batches:
            out = [np.empty(0, np.int64)]
            for part in texts(column):
                body, ends, words, counts = part.data.tobytes(), part.offsets.tolist(), [], np.zeros(len(part), np.int64)
                for i in range(len(part)):
                    own = body[ends[i] : ends[i + 1]].split()
                    counts[i] = len(own)
                    words += own
                numbers = table.numbers(words)
                out.append(add_up(table.rows[numbers], counts)[:, 0].astype(np.int64))
            yield pa.array(np.concatenate(out), pa.int64())

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compute, "long")(text)
