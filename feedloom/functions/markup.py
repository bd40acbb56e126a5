"""Tokenising HTML into text runs.

Spark has no function for tag soup, so this one step is an Arrow UDF around
the standard library's tokenizer. It only says where the runs are and under
which element; every rule about them is a column expression elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.shipping import ship_by_value

ship_by_value(__name__)

# Elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)

# Elements whose text is not part of the readable text.
UNREADABLE = frozenset(["script", "style", "template", "rt", "rp"])

# What a task turns into runs at a time.
SLICE_CHARS = 1 << 19

RUN = pa.struct(
    [
        ("lead", pa.string()),
        ("markup", pa.string()),
        ("text", pa.string()),
        ("parent", pa.string()),
        ("readable", pa.bool_()),
    ]
)
RUNS_DDL = (
    "ARRAY<STRUCT<lead: STRING, markup: STRING, text: STRING, parent: STRING, readable: BOOLEAN>>"
)


class _RunReader(HTMLParser):
    """Collects maximal text runs with their offsets and open elements.

    Open elements are counted by name, so that neither a run nor an end tag looks through
    all of them: pages may leave any number unclosed. The html may be fed in pieces.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self._at = 0  # characters read before the current construct
        self._open: list[str] = []
        self._counts: Counter[str] = Counter()
        self._unreadable = 0  # open elements whose text is not for readers
        self._run_start: int | None = None
        self.spans: list[tuple[int, int, str | None, bool]] = []

    def updatepos(self, i, j):
        self._at += max(0, j - i)
        return j

    def settled(self) -> int:
        """Offset from which on characters may belong to spans yet to come."""
        return self._at if self._run_start is None else self._run_start

    def finish(self, length: int) -> None:
        self.close()
        self._end_run(length)

    def _here(self) -> int:
        return self._at

    def _text_here(self) -> None:
        if self._run_start is None:
            self._run_start = self._here()

    def _end_run(self, end: int) -> None:
        if self._run_start is not None and self._run_start < end:
            self._add(self._run_start, end)
        self._run_start = None

    def _add(self, start: int, end: int) -> None:
        parent = self._open[-1] if self._open else None
        self.spans.append((start, end, parent, not self._unreadable))

    def handle_data(self, data):
        self._text_here()

    def handle_entityref(self, name):
        self._text_here()

    def handle_charref(self, name):
        self._text_here()

    def handle_starttag(self, tag, attrs):
        self._end_run(self._here())
        if tag not in VOID:
            self._open.append(tag)
            self._counts[tag] += 1
            self._unreadable += tag in UNREADABLE

    def handle_startendtag(self, tag, attrs):
        self._end_run(self._here())

    def handle_endtag(self, tag):
        self._end_run(self._here())
        closed = None
        while self._counts[tag] and closed != tag:
            closed = self._open.pop()
            self._counts[closed] -= 1
            self._unreadable -= closed in UNREADABLE

    def handle_comment(self, data):
        self._end_run(self._here())

    def handle_decl(self, decl):
        self._end_run(self._here())

    def handle_pi(self, data):
        self._end_run(self._here())

    def unknown_decl(self, data):
        self._end_run(self._here())
        if data.startswith("CDATA["):
            start = self._here() + len("<![CDATA[")
            self._add(start, start + len(data) - len("CDATA["))


def _text_of(markup: str, parent: str | None) -> str:
    # script and style are raw text, character references there mean nothing
    return markup if parent in ("script", "style") else unescape(markup)


def text_runs(html: str) -> list[dict]:
    """Runs in document order; a last one without text carries what follows.

    Joining ``lead`` and ``markup`` of all of them gives the input back.
    """
    runs = []
    done = 0
    reader = _RunReader()
    reader.feed(html)
    reader.finish(len(html))
    for start, end, parent, readable in reader.spans:
        markup = html[start:end]
        runs.append(
            {
                "lead": html[done:start],
                "markup": markup,
                "text": _text_of(markup, parent),
                "parent": parent,
                "readable": readable,
            }
        )
        done = end
    runs.append(
        {"lead": html[done:], "markup": "", "text": None, "parent": None, "readable": False}
    )
    return runs


def glued_runs(pieces: Iterable[str]) -> Iterator[tuple[str, str | None]]:
    """Text and parent of the runs of the html that the pieces make up, a piece at a time.

    No more is held than the open elements, a piece, and what of those before it is not closed yet.
    """
    reader = _RunReader()
    held, start = "", 0  # the html from offset ``start`` on

    def closed() -> Iterator[tuple[str, str | None]]:
        for first, end, parent, _ in reader.spans:
            yield _text_of(held[first - start : end - start], parent), parent
        reader.spans.clear()

    for piece in pieces:
        held += piece
        reader.feed(piece)
        yield from closed()
        held, start = held[reader.settled() - start :], reader.settled()
    reader.finish(start + len(held))
    yield from closed()


def slices(column: pa.Array, size: Callable[[int], int]) -> Iterator[pa.Array]:
    """The column in slices of SLICE_CHARS characters or one value; ``size`` is that of a value."""
    first, held = 0, 0
    for i in range(len(column)):
        held += size(i)
        if held >= SLICE_CHARS:
            yield column.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < len(column):
        yield column.slice(first)


def _text_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # the runs of a whole batch would be several times its texts, as objects
    for html in batches:
        lengths = pc.fill_null(pc.utf8_length(html), 0).to_pylist()
        for part in slices(html, lengths.__getitem__):
            yield pa.array([text_runs(value or "") for value in part.to_pylist()], type=pa.list_(RUN))


_text_runs.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def runs_of(html: Column) -> Column:
    """Array of text runs of an HTML column."""
    return F.arrow_udf(_text_runs, RUNS_DDL)(html)
