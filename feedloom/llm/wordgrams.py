"""Per-word results that add up over a text, computed once per word and task.

A model that sums over the character n-grams of a text's words needs each distinct word once. A
`WordTable` keeps what a word adds, computes unseen words together, and forgets everything when it
has grown to its bound, so a task's memory depends on neither the number of words nor their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from feedloom.llm.textarrays import Texts, mix, texts

MAX_WORDS = 150_000
MAX_KEY_BYTES = 12_000_000
#: Characters whose n-grams are held at a time.
SLICE = 1 << 18
#: A text of more bytes is counted without an index of its words.
LONG_TEXT = 1 << 20


class _Index(dict):
    """Numbers words as they come and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class WordTable:
    """`compute(words)` gives a row of numbers for each word."""

    def __init__(self, width: int, compute: Callable[[list[bytes]], np.ndarray], dtype=np.float64) -> None:
        self.width, self.compute, self.dtype = width, compute, dtype
        self._clear()

    def _clear(self) -> None:
        self.index, self.rows, self.key_bytes = _Index(), np.empty((1024, self.width), self.dtype), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of the words, valid until the next call."""
        if len(self.index) > MAX_WORDS or self.key_bytes > MAX_KEY_BYTES:
            self._clear()
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            fresh, self.index.fresh = self.index.fresh, []
            self.key_bytes += sum(map(len, fresh))
            need, have = len(self.index), len(self.index) - len(fresh)
            if need > len(self.rows):
                grown = np.empty((max(need, 2 * len(self.rows)), self.width), self.dtype)
                grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have:need] = self.compute(fresh)
        return found

    def sums(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """What the words of each text add up to, and how many words it has."""
        words, counts = split_words(part)
        numbers = self.numbers(words)  # may replace the rows
        return add_up(self.rows[numbers], counts), counts


def split_words(part: Texts) -> tuple[list[bytes], np.ndarray]:
    """White-space separated words of all texts, A-Z lower-cased, and their number by text."""
    body, words, counts = part.data.tobytes().lower(), [], np.zeros(len(part), np.int64)
    ends = part.offsets.tolist()
    for i in range(len(part)):
        own = body[ends[i] : ends[i + 1]].split()
        counts[i] = len(own)
        words += own
    return words, counts


def add_up(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; zeros for an empty group."""
    out = np.zeros((len(counts), rows.shape[1]), np.float64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
    return out


def gram_slices(
    words: list[bytes], sizes: tuple[int, ...], buckets: int, keep: str = "letters", whole: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of the character n-grams of the words and the word each belongs to, slice by slice.

    Words are case-folded and framed by word marks; `keep` drops all but letters, or but letters and
    digits. A word that has none is without n-grams. `whole` adds a bucket for the word itself. A slice
    holds the n-grams that start in some SLICE characters, so a word of any length takes little memory.
    """
    wanted = str.isalpha if keep == "letters" else str.isalnum
    plain = [_filtered(w.decode("utf-8", "replace").lower(), wanted) for w in words]
    lengths = np.array([len(w) + 2 if w else 0 for w in plain], np.int64)
    all_ends = np.cumsum(lengths)
    framed = np.frombuffer("".join(f"<{w}>" if w else "" for w in plain).encode("utf-32-le"), np.uint32)
    del plain
    sums = np.zeros(len(words) if whole else 0, np.uint64)
    overlap = max(sizes) - 1
    for start in range(0, len(framed), SLICE):
        size = min(SLICE, len(framed) - start)
        letters = framed[start : start + size + overlap].astype(np.uint64)
        at = np.arange(start, start + len(letters))
        low, high = np.searchsorted(all_ends, [start, start + size - 1], "right")
        own = np.diff(np.clip(all_ends[low : high + 1], start, start + size), prepend=start)
        owner = np.repeat(np.arange(low, high + 1), own)
        ends = all_ends[owner]
        found, owners = [], []
        rolled = np.zeros(len(letters), np.uint64)
        for n in range(1, max(sizes) + 1):
            reach = len(letters) - n + 1
            if reach <= 0:
                break
            rolled = rolled[:reach] * np.uint64(0x100000001B3) + letters[n - 1 :]
            if n in sizes:
                firsts = min(reach, size)
                inside = at[:firsts] + n <= ends[:firsts]
                found.append(mix(rolled[:firsts][inside] + np.uint64(n)) % np.uint64(buckets))
                owners.append(owner[:firsts][inside])
        if whole:
            places = (at[:size] - (ends - lengths[owner])).astype(np.uint64)
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[new]] += np.add.reduceat(mix(letters[:size] + np.uint64(0x9E37) * places), new)
            done = owner[new][all_ends[owner[new]] <= start + size]
            found.append(mix(sums[done]) % np.uint64(buckets))
            owners.append(done)
        owners_all = np.concatenate(owners)
        order = np.argsort(owners_all, kind="stable")
        yield np.concatenate(found)[order].astype(np.int64), owners_all[order]


def _filtered(word: str, wanted: Callable[[str], bool]) -> str:
    if wanted(word):
        return word
    if len(word) <= SLICE:
        return "".join(filter(wanted, word))
    pieces = (word[i : i + SLICE] for i in range(0, len(word), SLICE))
    return "".join("".join(filter(wanted, piece)) for piece in pieces)


def gram_buckets(words: list[bytes], *args) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of `gram_slices` word by word, and their number by word."""
    found, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for ids, owner in gram_slices(words, *args):
        found.append(ids)
        owners.append(owner)
    return np.concatenate(found), np.bincount(np.concatenate(owners), minlength=len(words))


def linear_words(weights: np.ndarray, sizes: tuple[int, ...], keep: str = "letters", whole: bool = False) -> WordTable:
    """Adds up the rows of `weights` over all n-grams of a text; the last column counts them."""
    buckets, width = weights.shape

    def compute(words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), width + 1), np.float64)
        for ids, owner in gram_slices(words, sizes, buckets, keep, whole):
            if len(ids):
                low, high = owner[0], owner[-1] + 1
                counts = np.bincount(owner - low)
                out[low:high, :width] += add_up(weights[ids], counts)
                out[low:high, width] += counts
        return out

    return WordTable(width + 1, compute)


class GramCounter:
    """The n-gram buckets of whole texts with their counts."""

    def __init__(self, sizes: tuple[int, ...], buckets: int, keep: str = "letters", whole: bool = False) -> None:
        self.args, self.buckets = (sizes, buckets, keep, whole), buckets

    def counts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct buckets of each text in turn, and how often each occurs."""
        for part in texts(column):
            words, counts = split_words(part)
            if len(part) == 1 and len(part.data) > LONG_TEXT:
                each = np.zeros(self.buckets, np.int64)
                for i in range(0, len(words), SLICE):
                    for ids, _ in gram_slices(words[i : i + SLICE], *self.args):
                        each += np.bincount(ids, minlength=self.buckets)
                found = np.flatnonzero(each)
                yield found, each[found]
                continue
            known = _Index()
            numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ids, sizes = gram_buckets(known.fresh, *self.args)
            starts = np.cumsum(sizes) - sizes
            at = 0
            for n in counts.tolist():
                own, times = np.unique(numbers[at : at + n], return_counts=True)
                at += n
                length = sizes[own]
                inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                each = np.bincount(
                    ids[np.repeat(starts[own], length) + inner], np.repeat(times, length), minlength=0
                )
                found = np.flatnonzero(each)
                yield found, each[found].astype(np.int64)
