"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token counts. The cells' weights are raked
in turn to the target shares of each margin until every margin is met. A cell can't give more than it has: those that
would have to are held at all they have, and the others are raked again until the margins are met as well as that
allows; what is still off is returned. Every document is then kept with the probability that its cell's weight calls
for, by a hash of its id: a rerun keeps the same documents.

A null margin value is a value of its own, a null text has no tokens. Texts may be of any length. Targets of
values that no cell has are left out and the rest scaled up; values without a target share get none. Repeated
rows share a fate, as they share an id; so do ties. Further columns are kept, but for those of the names that
are added. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import text_of, written

MARGINS = ("source", "lang", "topic")
#: A margin is met if its shares are off by less. Targets that zero cells can't meet never settle: then rounds end.
SETTLED, MOST_ROUNDS = 1e-6, 100
#: Raking with held cells also ends once a round brings it nearer by less than this share: it may have nowhere to go.
STALLED = 0.02
#: Cells that hold up to this share of the wanted tokens are held at what they have, so that the rarest don't set the rate.
SHORT = 0.01
#: Columns that are added.
ADDED = ("_source", "_lang", "_topic", "_tokens", "weight", "chance", "kept", "residual")
NONE = "\\N"


def tokens_of(text: Column) -> Column:
    """A token for every four bytes, begun or whole."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse genre by form, where a corpus has no topic column."""
    n = F.greatest(F.char_length(text), F.lit(1))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(digits > 0.03 * n, "figures")
        .when(n / lines < 40, "list")
        .when(n < 600, "note")
        .when(n < 4000, "article")
        .otherwise("longread")
    )


def with_margins(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic (never null) and _tokens."""
    text = text_of()
    return docs.withColumns({
        "_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "_topic": topic_of(text),
        "_tokens": tokens_of(text),
    })


def cells(docs: DataFrame) -> DataFrame:
    """Token counts by cell; sums start before the shuffle, so a hot source is a few rows. There are at most
    as many cells as combinations of margin values, whatever the number of documents."""
    keys = [f"_{m}" for m in MARGINS]
    return docs.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def tempered(cell: DataFrame, power: float) -> list[DataFrame]:
    """Target shares of each margin: its own shares to a power, made to sum to 1."""
    out = []
    for m in MARGINS:
        own = cell.groupBy(f"_{m}").agg(F.sum("tokens").cast("double").alias("t"))
        total = own.agg(F.sum(F.pow("t", F.lit(power)))).first()[0]
        out.append(own.select(F.col(f"_{m}"), (F.pow("t", F.lit(power)) / F.lit(float(total or 1.0))).alias("share")))
    return out


def raked(cell: DataFrame, targets: Sequence[DataFrame], settled: float = SETTLED, most: int = MOST_ROUNDS, held: float | None = None) -> DataFrame:
    """Cells with ``weight``: tokens that the targets ask of each, summing to all tokens. ``held``: no weight is more
    than so many times the cell's tokens; then rounds start from the weights that ``cell`` has.

    ``targets``: for each margin (value, share). In each round the weights of a margin's value are scaled to its
    share of all, margin after margin; a zero cell stays zero. Sums are made before the shuffle, so a value that
    most cells have is a few rows. Rounds end once no share was off by ``settled`` or more.
    """
    rows, keys = cell, [f"_{m}" for m in MARGINS]
    for m, target in zip(MARGINS, targets, strict=True):
        rows = rows.join(target.select(F.col(target.columns[0]).alias(f"_{m}"), F.col("share").cast("double").alias(f"share_{m}")), f"_{m}", "left")
    rows = written(rows.fillna(0.0, [f"share_{m}" for m in MARGINS]), "cells")
    for m in MARGINS:  # what is asked of values that cells have, as shares of their own sum
        given = rows.groupBy(f"_{m}").agg(F.first(f"share_{m}").alias("s")).agg(F.sum("s")).first()[0]
        rows = rows.withColumn(f"share_{m}", F.col(f"share_{m}") / F.lit(float(given or 1.0)))
    rows = written(rows.withColumn("weight", F.col("tokens").cast("double") if held is None else F.least("weight", F.col("tokens") * held)), "cells")
    total = float(rows.agg(F.sum("tokens")).first()[0] or 0)
    if total == 0:
        return rows
    before = float("inf")
    for _ in range(most):
        rows = rows.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            now = rows.groupBy(f"_{m}").agg(F.sum("weight").alias("now"))
            share = F.col(f"share_{m}")
            rows = rows.join(now, f"_{m}").withColumns({
                "off": F.greatest("off", F.when(F.col("now") > 0, F.abs(F.col("now") / total - share)).otherwise(0.0)),
                "weight": F.when(F.col("now") > 0, F.col("weight") * share * total / F.col("now")).otherwise(0.0),
            }).drop("now")
        if held is not None:
            rows = rows.withColumn("weight", F.least("weight", F.col("tokens") * held))
        seen = Observation()
        rows = written(rows.observe(seen, F.max("off").alias("off")).drop("off").select(*keys, "tokens", "n_docs", *(f"share_{m}" for m in MARGINS), "weight"), "cells")
        off = seen.get["off"] or 0.0
        if off < settled or held is not None and off > (1 - STALLED) * before:
            break
        before = off
    return rows


def residual(fit: DataFrame) -> float:
    """How far the share of any margin value is off its target; ``fit`` as ``raked`` gives it."""
    total = float(fit.agg(F.sum("weight")).first()[0] or 0)
    if total == 0:
        return 0.0
    off = [fit.groupBy(f"_{m}").agg(F.sum("weight").alias("w"), F.first(f"share_{m}").alias("s")).agg(F.max(F.abs(F.col("w") / total - F.col("s")))).first()[0] for m in MARGINS]
    return float(max(off))


def scale_of(fit: DataFrame, short: float = SHORT) -> float:
    """The ratio that is kept whole: cells of a larger one hold at most ``short`` of the wanted tokens. Their number
    does not matter: ratios are summed in steps of about two percent, a few thousand rows at most."""
    step = F.floor(F.log(F.col("ratio")) * 50)
    steps = fit.where("ratio > 0").groupBy(step.alias("step")).agg(F.sum("weight").alias("w"), F.max("ratio").alias("top")).orderBy(F.desc("step")).collect()
    left = short * sum(r["w"] for r in steps)
    for r in steps:
        left -= r["w"]
        if left < 0:
            return float(r["top"])
    return float(steps[-1]["top"]) if steps else 1.0


def mixed(docs: DataFrame, key: str = "doc_id", power: float = 0.7, targets: Sequence[DataFrame] | None = None, seed: int = 7, short: float = SHORT, tokens: str | None = None, rate: float | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, ``weight`` (wanted over present tokens of the cell),
    ``chance`` (of being kept: the weight over the largest one), ``kept``, and ``residual``, one value: how far the
    expected share of any source, language or topic is off its target.

    ``tokens``: a column with counts of tokens, if there is one. Cells that would need more than they have, with
    less than ``short`` of all wanted tokens together, keep every document. Targets default to the tempered shares.
    ``rate``: cells of this weight or more keep every document instead, however many they are, and the others are thinned to
    their weight over it. At 1, a cell loses only what goes beyond what the targets ask of it in a corpus as large as this
    one; what cells of a larger weight lack stays lacking, and shows in ``residual``.
    """
    kept_columns = [c for c in docs.columns if c.lower() not in ADDED]
    packed = docs.select(F.struct(*kept_columns).alias("row"), key, "text", *(c for c in ("source", "lang") if c != key), *([F.col(tokens).alias("_given")] if tokens else []))
    rows = with_margins(packed)
    if tokens:
        rows = rows.withColumn("_tokens", F.coalesce(F.col("_given"), F.lit(0)).cast("long"))
    cell = written(cells(rows), "cells")
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    targets = targets or tempered(cell, power)
    fit = raked(cell, targets)
    top = rate or scale_of(fit.withColumn("ratio", ratio), short)
    if rate is None and not fit.where(ratio > top).isEmpty():
        fit = raked(fit.select(*(f"_{m}" for m in MARGINS), "tokens", "n_docs", "weight"), targets, held=top)
    off = residual(fit.withColumn("weight", F.least("weight", F.col("tokens") * top)))
    fit = fit.withColumn("ratio", ratio)
    keys = [f"_{m}" for m in MARGINS]
    fit = written(fit.select(*keys, "weight", "ratio"), "fit")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    out = rows.join(fit.drop("weight"), keys).withColumns({"weight": F.col("ratio"), "chance": F.least(F.lit(1.0), F.col("ratio") / top), "residual": F.lit(off)})
    return out.withColumn("kept", draw < F.col("chance")).select(*(F.col("row")[c].alias(c) for c in kept_columns), *ADDED)
