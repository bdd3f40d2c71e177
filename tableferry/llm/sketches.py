"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

Every hash of a five-word shingle below a fixed fraction of the hash range is retained, so sketches
of any two documents sample the same shingles: unions of sketches are sketches of unions, and
containment between very unequal documents is a ratio of counts. The least hash is retained too, so
a text with any word has a non-empty sketch. A text of one to four words has one shingle, the whole.

Null texts count as empty: no shingle, the empty fingerprint. Two empty sketches are alike by 1,
an empty and another one by 0. Texts may be of any length. Rows that share a doc_id are ordered by text, so
equal rows follow each other; a null doc_id comes last. Columns other than doc_id and text are not looked at,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

WORDS = 5
#: One shingle hash in so many is retained.
SCALE = 8
#: Fences between id ranges, and ranges between two fences: their product bounds what the driver gathers.
FENCES, BETWEEN = 256, 1024
#: Bytes of text that a task sorts, about, and ranges for each task.
TASK_BYTES, RANGES_A_TASK = 32 << 20, 8


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted distinct 64-bit hashes."""
    bound = -(1 << 63) + (1 << 64) // scale

    def shingles(hashes: Column) -> Column:
        n = F.size(hashes)
        starts = F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(starts, lambda k: F.xxhash64(*(F.get(hashes, k + (d - 1)) for d in range(WORDS))))
        )

    def retained(all_: Column) -> Column:
        least = F.filter(F.array(F.array_min(all_)), lambda h: h.isNotNull())
        return F.array_sort(F.array_distinct(F.concat(F.filter(all_, lambda h: h < bound), least)))

    return _let(_let(F.transform(words(text), lambda w: F.xxhash64(w)), shingles), retained)


def as_text(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: DataFrame, key: str, column: str = "sketch") -> DataFrame:
    """Sketches of the unions of the documents of each key."""
    return sketches.select(key, F.explode(column).alias("h")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("h")).alias(column))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """key and its sketch."""
    return docs.select(key, sketch(text_of(text), scale).alias("sketch"))


def _id_ranges(docs: DataFrame, key: str, tasks: int) -> tuple[Column, Column]:
    """The range that an id belongs to, descending, and for its first id the other range that it follows.

    Fences are approximate quantiles of the ids; between two of them ids are dealt evenly.
    """
    spark = docs.sparkSession
    pieces = RANGES_A_TASK * tasks
    fences = min(FENCES, pieces)
    between = min(BETWEEN, -(-pieces // fences))
    cuts = sorted(set(docs.stat.approxQuantile(key, [k / fences for k in range(fences + 1)], 1 / (4 * fences)))) or [0.0]
    lits = F.array(*map(F.lit, cuts))
    at = F.greatest(F.size(F.filter(lits, lambda c: c <= F.col(key))), F.lit(1))
    low, high = F.element_at(lits, at), F.element_at(lits, F.least(at + 1, F.lit(len(cuts))))
    part = F.least(F.greatest(F.floor((F.col(key) - low) * between / F.greatest(high - low, F.lit(1.0))), F.lit(0)), F.lit(between - 1))
    number = F.coalesce(-(at * between + part).cast("long"), F.lit(1).cast("long"))
    firsts = docs.select(number.alias("r"), key).groupBy("r").agg(F.max(key).alias("first")).orderBy("r").collect()
    follows = {firsts[k]["first"]: firsts[k - 1]["r"] for k in range(len(firsts))}
    if not follows:
        return number, F.lit(None).cast("long")
    pairs = spark.createDataFrame([(i, r) for i, r in follows.items()], "id long, r long")
    return number, pairs


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with ``next``: a struct of the given columns of the row that follows by descending key;
    after the last comes the first.

    Rows are shuffled once, by id range; the first row of a range also goes, as a copy, to the end of
    the range before it. There are as many tasks and ranges as the bytes of the first column call for.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(columns[0])), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    number, pairs = _id_ranges(docs, key, tasks)
    dealt = docs.withColumn("_range", number)
    if isinstance(pairs, DataFrame):
        to = F.broadcast(pairs.withColumnRenamed("id", "_id").withColumnRenamed("r", "_to"))
        dealt = dealt.join(to, F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")
    else:
        dealt = dealt.withColumn("_to", pairs)
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_to").alias("r"), F.lit(True).alias("copy"))
    dealt = dealt.withColumn("_as", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select(*docs.columns, F.col("_as.r").alias("_r"), F.col("_as.copy").alias("_copy")).repartition(tasks, "_r")
    order = Window.partitionBy("_r").orderBy("_copy", F.col(key).desc_nulls_last(), *columns[:1])
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_copy")).drop("_r", "_copy")


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: see the README on op2."""
    base = docs.select("doc_id", text_of().alias("text")).withColumn("fp", sketch(F.col("text"), scale))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = with_next(base, "doc_id", ["text", "fp"]).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fp",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring(F.col("next.text"), F.lit(1), cut)).alias("edited"),
        F.col("next.fp").alias("next_fp"),
    )
    rows = rows.withColumn("edited_fp", sketch(F.col("edited"), scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("edited_fp")).alias("kept_in_edited"),
    )
