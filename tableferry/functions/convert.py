"""Conversions that fail for a row, not for the load: their forms that give NULL, and what tells that they failed.

``CAST``, ``TO_NUMBER``, ``TO_DATE`` and ``TO_TIMESTAMP`` in the SQL text of an expression are looked for outside quotes,
by name and matching parentheses; all else is left to Spark.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error numbers of conversions that failed.
TOO_LARGE, BAD_NUMBER, BAD_DATE = 1438, 1722, 1861

_QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`"
_CALL = re.compile(rf"{_QUOTED}|(?<![\w.])(cast|to_number|to_date|to_timestamp)\s*\(", re.IGNORECASE)
_PART = re.compile(rf"{_QUOTED}|\(|\)|,|\bas\b", re.IGNORECASE)
_CHOICE = re.compile(rf"{_QUOTED}|\b(case|if|iff|decode)\b", re.IGNORECASE)


@dataclasses.dataclass(frozen=True)
class Conversion:
    """``given``: SQL of what is converted; ``tried``: SQL of the conversion, NULL where it fails; its kind of type."""

    given: str
    tried: str
    kind: str

    def failed(self) -> Column:
        """An empty text is NULL, which is no failure."""
        given = F.expr(self.given).cast("string")
        return given.isNotNull() & (given != "") & F.expr(self.tried).isNull()

    def number(self) -> Column:
        return error_of(F.expr(self.given), self.kind)


def error_of(given: Column, kind: str) -> Column:
    """The error number of a value that doesn't convert: a number that doesn't fit is another error than no number."""
    if kind.startswith(("date", "timestamp")):
        return F.lit(BAD_DATE)
    return F.when(F.trim(given.cast("string")).try_cast("double").isNull(), BAD_NUMBER).otherwise(TOO_LARGE)


def arguments(text: str, start: int) -> tuple[list[str], int]:
    """What stands between the parenthesis before ``start`` and its mate, split at commas and AS; the place after."""
    depth, parts, at = 1, [], start
    for m in _PART.finditer(text, start):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if depth == 0:
                return [*parts, text[at : m.start()].strip()], m.end()
        elif depth == 1 and (m[0] == "," or m[0].lower() == "as"):
            parts.append(text[at : m.start()].strip())
            at = m.end()
    raise ValueError(f"a parenthesis isn't closed: {text}")


def tried(text: str, instead: int | None = None) -> tuple[str, list[Conversion]]:
    """The expression with conversions that give NULL where they fail, and those conversions, inner ones first.
    ``instead``: 0 or 1 for another value in place of that NULL, one of two."""
    out, found, at = [], [], 0
    while m := _CALL.search(text, at):
        out.append(text[at : m.start()])
        if not m[1]:
            out.append(m[0])
            at = m.end()
            continue
        parts, at = arguments(text, m.end())
        given, inner = tried(parts[0], instead)
        rest = "".join(f", {p}" for p in parts[1:])
        name = m[1].lower()
        if name == "cast":
            made, kind = f"TRY_CAST({given} AS {parts[1]}{''.join(', ' + p for p in parts[2:])})", parts[1].lower()
        elif name == "to_number":
            made, kind = (f"TRY_TO_NUMBER({given}{rest})" if rest else f"TRY_CAST(trim({given}) AS DECIMAL(38,10))"), "decimal"
        elif name == "to_date":
            made, kind = f"CAST(TRY_TO_TIMESTAMP({given}{rest}) AS DATE)", "date"
        else:
            made, kind = f"TRY_TO_TIMESTAMP({given}{rest})", "timestamp"
        found += [*inner, Conversion(given, made, kind)]
        if instead is not None:
            values = ("DATE '1970-01-01'", "DATE '2999-12-31'") if kind.startswith(("date", "timestamp")) else ("'true'", "'false'") if kind == "boolean" else ("'0'", "'1'")
            made = f"CASE WHEN CAST({given} AS STRING) <> '' AND {made} IS NULL THEN CAST({values[instead]} AS {kind}) ELSE {made} END"
        out.append(f"({made})" if instead is not None else made)
    return "".join([*out, text[at:]]), found


def reached(text: str) -> Column:
    """Whether conversions that failed matter for a row: always, unless the expression chooses between parts; then if
    other values in their place would give another result."""
    if not any(m[1] for m in _CHOICE.finditer(text)):
        return F.lit(True)
    plain, one, other = (F.expr(tried(text, k)[0]) for k in (None, 0, 1))
    return ~(plain.eqNullSafe(one) & plain.eqNullSafe(other))
