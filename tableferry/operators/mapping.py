"""Mapped projection, NULL rules and row constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.convert import TOO_LARGE, error_of, reached, tried
from ..spec import ColumnMapping, Mapping

#: Error numbers of the rejects, besides those of conversions.
DUPLICATE, NOT_NULL, TOO_LONG = 1, 1400, 12899


def literal(value: str | None, type_: str) -> Column:
    """A typed literal; an empty text is NULL, and quotes around a text are dropped."""
    if value is not None and len(value) > 1 and value[0] == value[-1] == "'":
        value = value[1:-1]
    return F.lit(value or None).cast(type_)


def value(c: ColumnMapping, run_ts: str) -> Column | None:
    """The column's value under its NULL rule; None if nothing is written. What doesn't convert is NULL here, and
    ``conversion_error`` tells."""
    x = None
    if c.expr is not None:
        x = F.expr(tried(c.expr)[0])
        x = F.nullif(x.cast("string"), F.lit("")) if c.type == "string" else x.try_cast(c.type)
    fill = None
    if c.null_rule == "DEFAULT":
        fill = literal(c.fill, c.type)
    elif c.null_rule == "SYSDATE":
        fill = F.lit(run_ts).cast("timestamp").cast(c.type)
    elif c.null_rule == "EMPTY" and x is not None:
        fill = F.lit("")
    elif c.null_rule == "CUSTOM" and c.fill:
        fill = F.expr(tried(c.fill)[0]).try_cast(c.type)
    if x is None:
        return fill.cast(c.type) if fill is not None else None
    return (F.coalesce(x.cast(c.type), fill.cast(c.type)) if fill is not None else x.cast(c.type)).cast(c.type)


def conversion_error(c: ColumnMapping) -> Column:
    """The error number of the first conversion of the column's expression that fails, or of the one to its type; else
    NULL. Where the expression chooses between parts (CASE, IF, DECODE), one within counts if the result hangs on it."""
    if c.expr is None:
        return F.lit(None).cast("int")
    text, conversions = tried(c.expr)
    x = F.expr(text)
    found = [F.when(v.failed() & reached(c.expr), v.number()) for v in conversions]
    if c.type != "string":
        given = x.cast("string")
        found.append(F.when(given.isNotNull() & (given != "") & x.try_cast(c.type).isNull(), error_of(x, c.type)))
    return F.coalesce(*found, F.lit(None).cast("int"))


#: Columns of a mapped row's failed conversion, until its constraints are checked.
FAILED = ("__err_num", "__err_col")


def map_columns(df: DataFrame, mapping: Mapping, run_ts: str, keep: list[str] | None = None, checked: bool = False) -> DataFrame:
    """The target's columns that are written, in its order, besides source columns to keep. ``checked``: with what
    ``constraint_check`` needs to reject rows for conversions that failed."""
    made = [(c, value(c, run_ts)) for c in mapping.columns]
    errors = []
    if checked:
        number, column = F.lit(None).cast("int"), F.lit(None).cast("string")
        for c in reversed([c for c, v in made if v is not None]):
            error = conversion_error(c)
            number, column = F.coalesce(error, number), F.when(error.isNotNull(), F.lit(c.target)).otherwise(column)
        errors = [number.alias(FAILED[0]), column.alias(FAILED[1])]
    return df.select(*(v.alias(c.target) for c, v in made if v is not None), *(keep or []), *errors)


def reasons(mapping: Mapping) -> tuple[Column, Column]:
    """Error number and column of the first rule that a mapped row breaks; NULLs for a good row."""
    number, column = F.lit(None).cast("int"), F.lit(None).cast("string")
    for c in reversed([c for c in mapping.columns if c.target in mapping.written]):
        x = F.col(c.target)
        rules = []
        if c.not_null:
            rules.append((x.isNull(), NOT_NULL))
        if c.max_len is not None:
            rules.append((F.char_length(x) > c.max_len, TOO_LONG))
        if c.max_digits is not None:
            rules.append((F.abs(x) >= F.lit(10**c.max_digits), TOO_LARGE))
        for broken, err in reversed(rules):
            broken = F.coalesce(broken, F.lit(False))
            number, column = F.when(broken, F.lit(err)).otherwise(number), F.when(broken, F.lit(c.target)).otherwise(column)
    return number, column


def constraint_check(mapped: DataFrame, mapping: Mapping) -> DataFrame:
    """Mapped rows with err_num and err_col. A conversion that failed comes before all other rules."""
    number, column = reasons(mapping)
    if FAILED[0] in mapped.columns:
        failed = F.col(FAILED[0])
        number, column = F.coalesce(failed, number), F.when(failed.isNotNull(), F.col(FAILED[1])).otherwise(column)
    return mapped.withColumns({"err_num": number, "err_col": column}).drop(*FAILED)


def whole_key(key: list[str]) -> Column:
    """Whether no part of the key is NULL: a key with a NULL part equals none, not even itself."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).isNotNull()
    return out


def _by_key(df: DataFrame, key: list[str], *more: Column) -> WindowSpec:
    """Rows of a key together; those with a NULL in it apart, spread by all their columns."""
    return Window.partitionBy(*key, F.when(~whole_key(key), F.xxhash64(*df.columns)), *more)


def dedup_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as when rows are merged one by one in order; all rows without a whole key."""
    w = _by_key(df, key).orderBy(*[o.desc() for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") == 1) | ~whole_key(key)).drop("__rn")


def first_wins(checked: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Among good rows of a key the first stays good; the rest break the key. Rows without a whole key break none."""
    good = F.when(F.col("err_num").isNull(), 0).otherwise(1)
    w = _by_key(checked, key, good).orderBy(*order)
    again = F.col("err_num").isNull() & (F.row_number().over(w) > 1) & whole_key(key)
    return checked.withColumn("__again", again).withColumns({
        "err_col": F.when(F.col("__again"), F.lit(",".join(key))).otherwise(F.col("err_col")),
        "err_num": F.when(F.col("__again"), F.lit(DUPLICATE)).otherwise(F.col("err_num")),
    }).drop("__again")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error columns, and rejects with them."""
    return checked.where("err_num IS NULL").drop("err_num", "err_col"), checked.where("err_num IS NOT NULL")
