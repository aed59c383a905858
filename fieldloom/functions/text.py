"""Text functions: ``Column -> Column``, native except for entity decoding."""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldloom import constants as C

# Unicode whitespace: the characters, and a pattern for runs of them (the Unicode class of the
# regex engine leaves out four separators).
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Every Unicode decimal digit beside ASCII, and the ASCII digit it stands for.
_DIGITS = [
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
]
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _clean_with_entities(texts: pd.Series) -> pd.Series:
    # str.split and str.strip take the same whitespace as SPACE_RUN.
    return texts.map(lambda t: html.unescape(" ".join(t.split())).strip(), na_action="ignore")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.trim(text, F.lit(SPACE_CHARACTERS))


def decode_entities(text: Column) -> Column:
    """Decode HTML entities; only rows that hold an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def clean_text(text: Column) -> Column:
    """Collapse whitespace, then decode entities, then strip; null becomes empty text.

    The order matters: a no-break space written as an entity survives inside the text. Only
    texts with an ampersand travel to Python.
    """
    decoded = _clean_with_entities(F.when(F.contains(text, F.lit("&")), text))
    plain = strip(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    return F.coalesce(decoded, plain)


def truncate_text(text: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, back at a space in the last fifth, and add an ellipsis."""
    cut = F.left(text, F.lit(limit))
    from_end = F.instr(F.reverse(cut), " ")
    last_space = F.length(cut) - from_end
    on_word = (from_end > 0) & (last_space > limit * 0.8)
    kept = F.when(on_word, F.left(cut, last_space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit("...")))


def normalize_amount(text: Column) -> Column:
    """Read an amount from free text.

    A lone comma is a decimal mark, with a dot present it separates thousands, and a ``k``
    anywhere multiplies by a thousand. What does not parse is null.
    """
    kept = F.regexp_replace(F.lower(text), r"[^\p{Nd}.,k]", "")
    return let(F.translate(kept, "".join(_DIGITS), _DIGIT_VALUES), _amount)


def _amount(kept: Column) -> Column:
    comma = F.when(F.contains(kept, F.lit(".")), "").otherwise(".")
    number = F.replace(F.replace(kept, F.lit("k"), F.lit("")), F.lit(","), comma)
    factor = F.when(F.contains(kept, F.lit("k")), 1000.0).otherwise(1.0)
    return number.try_cast("double") * factor


def to_number(text: Column) -> Column:
    """Number written in plain or exponent form, else null."""
    pattern = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.trim(text).try_cast("double"))


def to_boolean(text: Column) -> Column:
    """Boolean, or null when the text is not one."""
    return text.try_cast("boolean")


# What follows "//" after an optional scheme, as far as a path, a query or a fragment begins. Crawled
# URLs hold characters that strict parsers refuse, so none is used.
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_authority(url: Column) -> Column:
    """Lower-case authority of a URL, with port and user part; empty without ``//``, ``unknown`` for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), F.lit("unknown"))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user part, port and brackets; empty when there is none."""
    authority = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))
    host = F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")
    return F.regexp_replace(host, r"[\[\]]", "")


def host_contains(url: Column, part: str) -> Column:
    """True when the host, not the rest of the URL, holds ``part``."""
    return F.contains(url_host(url), F.lit(part))


def url_key(url: Column) -> Column:
    """Stable key of a URL."""
    return F.sha2(url, 256)


def url_id(ordinal: Column) -> Column:
    """Display name of the item at a 1-based position."""
    return F.format_string("url_%03d", ordinal)


def estimate_tokens(text: Column) -> Column:
    """Characters divided by four, as a whole number."""
    return F.floor(F.length(text) / 4)


def preview(text: Column, limit: int = C.PREVIEW_LENGTH) -> Column:
    """First ``limit`` characters, with an ellipsis when something was left out."""
    head = F.left(text, F.lit(limit))
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def reply_accepted(text: Column) -> Column:
    """True when a reply holds OK in any case."""
    return F.contains(F.upper(text), F.lit("OK"))


def is_substantial(text: Column) -> Column:
    """True when the stripped text is longer than the least useful content."""
    return F.coalesce(F.length(strip(text)) > C.MIN_CONTENT_LENGTH, F.lit(False))


def epoch_seconds() -> Column:
    """Now, as seconds since the epoch."""
    return F.unix_millis(F.current_timestamp()) / F.lit(1000.0)


def run_stamp() -> Column:
    """Now, in the form used in output names."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
