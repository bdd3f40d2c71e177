"""Functions with the source dialect's rules, as compositions of built-in ones: an empty string is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracket classes of regular expressions.
CLASSES = {"[:digit:]": "0-9", "[:alpha:]": "A-Za-z", "[:alnum:]": "A-Za-z0-9", "[:upper:]": "A-Z", "[:lower:]": "a-z", "[:space:]": r"\s", "[:punct:]": r"\p{Punct}"}
#: Parts of date formats.
DATE_PARTS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF6": "SSSSSS", "FF3": "SSS", "MON": "MMM", "AM": "a"}

SEPARATOR = "\x1f"


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def concat(*parts: Column) -> Column:
    """``||``: a NULL part counts as an empty one; an empty result is NULL."""
    return null_if_empty(F.concat_ws("", *(p.cast("string") for p in parts)))


def trim(x: Column, chars: str | None = None, side: str = "both") -> Column:
    f = {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side]
    return null_if_empty(f(x) if chars is None else f(x, F.lit(chars)))


def initcap(x: Column) -> Column:
    """A word starts after anything but a letter or digit."""
    return F.regexp_replace(F.initcap(F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}])", "$1 ")), r"([^\p{L}\p{N}]) ", "$1")


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """Position 0 is 1; one before the start gives NULL."""
    start = start or 1
    n = F.char_length(x)
    begin = F.lit(start) if start > 0 else n + start + 1
    part = F.substring(x, begin, F.lit(length) if length is not None else n)
    return F.when((begin >= 1) & (begin <= n), null_if_empty(part))


def pattern(regex: str) -> str:
    for name, chars in CLASSES.items():
        regex = regex.replace(name, chars)
    return regex


def regexp_replace(x: Column, regex: str, by: str = "") -> Column:
    return null_if_empty(F.regexp_replace(x, pattern(regex), by))


def regexp_substr(x: Column, regex: str) -> Column:
    return F.regexp_substr(x, F.lit(pattern(regex)))


def date_format(fmt: str) -> str:
    out, k = "", 0
    while k < len(fmt):
        part = next((p for p in sorted(DATE_PARTS, key=len, reverse=True) if fmt.upper().startswith(p, k)), None)
        out += DATE_PARTS[part] if part else fmt[k]
        k += len(part) if part else 1
    return out


def to_char(x: Column, fmt: str) -> Column:
    return F.date_format(x, date_format(fmt))


def number_text(x: Column, scale: int = 10) -> Column:
    """A number without an exponent or trailing zeros."""
    text = x.cast(f"decimal(38,{scale})").cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def to_date(x: Column, fmt: str) -> Column:
    """NULL where the text doesn't fit; :func:`failed` tells that from a NULL text."""
    return F.try_to_timestamp(x, F.lit(date_format(fmt)))


def to_number(x: Column, type_: str = "decimal(38,10)") -> Column:
    return F.trim(x).try_cast(type_)


def failed(given: Column, got: Column) -> Column:
    return given.isNotNull() & got.isNull()


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero."""
    shift = F.lit(10**digits)
    scaled = x.cast("decimal(38,10)") * shift
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / shift


def greatest(*xs: Column) -> Column:
    """NULL if any is."""
    some_null = F.lit(False)
    for x in xs:
        some_null = some_null | x.isNull()
    return F.when(~some_null, F.greatest(*xs))


def hash32(x: Column) -> Column:
    """The first 32 bits of the text's MD5 as a number; NULL hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(x.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def key_text(x: Column, type_: str) -> Column:
    """A key part as text that compares equal on both sides."""
    if type_ in ("date", "datetime"):
        return F.date_format(x.cast("timestamp"), "yyyyMMddHHmmss")
    if type_.startswith("timestamp"):
        return F.date_format(x.cast("timestamp"), "yyyyMMddHHmmssSSSSSS")
    if type_ in ("int", "bigint", "long"):
        return x.cast("string")
    if type_.startswith(("decimal", "number", "double")):
        return number_text(x)
    return F.rtrim(x) if type_.startswith("char") else x.cast("string")


def normalised_key(parts: list[tuple[Column, str]]) -> Column:
    """Parts joined with the unit separator; NULL if any part is."""
    texts = [key_text(x, t) for x, t in parts]
    some_null = F.lit(False)
    for t in texts:
        some_null = some_null | t.isNull()
    return F.when(~some_null, F.concat_ws(SEPARATOR, *texts))
