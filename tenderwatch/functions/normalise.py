"""Scalar normalisers for text, dates, amounts, links and content hashes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that also count as blank.
_BLANK = r"[\s\x1c-\x1f]+"
_AT_ENDS = rf"(?U)^{_BLANK}|{_BLANK}$"
# An object with a quoted "url" field (group 3), or else the first link in braces (group 4).
_LINK_IN_OBJECT = (
    r"""(?s)^\s*\{(?:(?:.*?,)?\s*(['"])url\1\s*:\s*(['"])(.*?)(?<!\\)\2\s*[,}].*"""
    r"""|.*?(https?://[^\s'}]+).*\})\s*$"""
)

#: zeros before a packed text that is no hash: longer than any packed hash
_NOT_HASH = 33

# Accepted date shapes, in the order they are tried.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
]
ISO_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalise_text(c: Column) -> Column:
    """Collapse white space, trim and upper-case; blank text becomes NULL."""
    return F.upper(blank_to_null(F.trim(F.regexp_replace(c, rf"(?U){_BLANK}", " "))))


def normalise_date(c: Column) -> Column:
    """Text to date by the first accepted shape; the local date of ISO timestamps is kept."""
    text = F.regexp_replace(c, _AT_ENDS, "")
    tries = [F.when(text.rlike(shape), F.try_to_date(text, fmt)) for shape, fmt in DATE_FORMATS]
    iso = F.when(text.rlike(ISO_TIMESTAMP), F.try_to_date(F.substring(text, 1, 10), "y-M-d"))
    return F.coalesce(*tries, iso)


def normalise_amount(c: Column) -> Column:
    """Text amount in either decimal convention to DECIMAL(20,2); unreadable text is NULL."""
    x = F.regexp_replace(c, r"[^0-9.,\-]", "")
    after_comma = F.instr(F.reverse(x), ",") - 1
    after_dot = F.instr(F.reverse(x), ".") - 1
    has_comma, has_dot = x.contains(","), x.contains(".")
    comma_is_decimal = F.when(has_dot, after_comma < after_dot).otherwise(after_comma <= 2)
    as_point = F.translate(F.translate(x, ".", ""), ",", ".")
    plain = F.when(has_comma & comma_is_decimal, as_point).otherwise(F.translate(x, ",", ""))
    return plain.try_cast("decimal(20,2)")


def is_blank(c: Column) -> Column:
    """NULL, empty or nothing but white space."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalise_url(c: Column) -> Column:
    """Unwrap a link stored as an object with a ``url`` field; other text is only trimmed.

    One replacement does both: for the trimming alternatives the groups are empty.
    """
    return blank_to_null(F.regexp_replace(c, rf"{_LINK_IN_OBJECT}|{_AT_ENDS}", "$3$4"))


def row_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the non-NULL fields in name order: equal content gives an equal hash."""
    ignored = {"id", "created_at", "updated_at", "row_hash"}
    parts = [
        F.concat(F.lit(f"{name}="), fields[name].cast("string"))
        for name in sorted(fields)
        if name not in ignored
    ]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def pack_hash(c: Column) -> Column:
    """A content hash in 32 bytes instead of 64 letters, for joins that compare hashes.

    Any other text keeps its bytes behind 33 zeros, so packed values are equal just where hashes are.
    """
    other = F.concat(F.lit(bytes(_NOT_HASH)), c.cast("binary"))
    return F.when(c.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(c)).otherwise(other)


def unpack_hash(c: Column) -> Column:
    """The hash that ``pack_hash`` packed."""
    other = F.substring(c, _NOT_HASH + 1, 2**31 - 1).cast("string")
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(other)


def stringify_nested(c: Column, dtype) -> Column:
    """Nested values (objects, lists) become JSON text; plain values pass."""
    nested = dtype.typeName() in ("struct", "array", "map")
    return F.to_json(c) if nested else c
