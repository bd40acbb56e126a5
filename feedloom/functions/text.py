"""Column helpers for text: whitespace, folding, hashing, cutting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace characters, as the inside of a Java
# regular-expression class (Java's own \s covers the ASCII ones only).
SPACE = (
    r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# The same characters as a list, for trimming. Trimming looks at
# the ends only, where a pattern would try every position of the text.
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "".join(map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Text without whitespace at either end."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one blank."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def fold(text: Column) -> Column:
    """Key under which spellings differing only in case are equal.

    Going through upper case first makes sharp s meet ss and the two small
    sigmas meet each other. The empty text in between is there because the
    optimizer takes lower(upper(x)) for lower(x), which these are not.
    """
    return F.lower(F.concat(F.upper(text), F.lit("")))


def source_hash(title: Column, content: Column) -> Column:
    """SHA-256 hex of the UTF-8 title, a zero byte and the UTF-8 content."""
    return F.sha2(
        F.concat(F.encode(title, "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")), 256
    )


def excerpt(text: Column, max_chars: int) -> Column:
    """Cut to ``max_chars`` and back to the last blank; short text stays whole."""
    head = F.left(text, F.lit(max_chars))
    to_last_blank = strip(F.regexp_replace(head, "(?s) [^ ]*\\z", ""))
    cut = F.when(to_last_blank != "", to_last_blank).otherwise(strip(head))
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


def preview(text: Column, max_chars: int) -> Column:
    """One-line preview: ``<empty>`` for nothing, dots where something was cut."""
    line = strip(collapse(text))
    return (
        F.when(line == "", F.lit("<empty>"))
        .when(F.length(line) <= max_chars, line)
        .otherwise(F.concat(rstrip(F.left(line, F.lit(max_chars - 3))), F.lit("...")))
    )


def escape_markup(text: Column) -> Column:
    """Text as it must be written between tags."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))
