"""Source divergence audit: which sources of a language use which words unlike the rest.

Each language is a matrix of counts, a row a source and a column a kept term. Its columns are dealt to strips by a
hash, its rows to bands, and a task has a strip of two bands, with a K-squared tree over each: all cells are one node,
and every node that isn't empty has four children, down to single cells. Both trees are walked together. A quadrant
that is empty in both bands is left at once, as each of its cells adds the same to a pair of sources; those are priced
at the end by one product. Elsewhere the cells are compared one by one. Sums of strips add up to a pair's value.

All numbers are exact integers: shares are billionths with two pseudo-counts a term, and p and q are compared by
floor((p - q)^2 / (p + q)).

Texts are read as bytes, whole. A null text, language or source counts as ''. Every row is a document of its own,
whatever ids it has. Ties go to the lesser item by bytes. A source without terms still is a group, and one that is
alone in its language has no pairs. An empty table has no rows. Further columns aren't looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Documents that a kept term has at least, and terms that are reported of each group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Rows of a band and columns of a strip, about: what a task holds of both bands at once.
BAND, STRIP = 64, 4096
#: Columns that two trees are walked over at once.
WALK = 256
#: Entries of a task's counts before they are handed on.
HELD = 200_000
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8 bytes), n, n_docs: summed once a task before they are dealt to be summed for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str, bytes], int] = {}
        held: dict[tuple[str, str, bytes], int] = {}

        def out() -> pa.RecordBatch:
            lang, source, term = zip(*n, strict=True) if n else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n.values(), pa.int64()), pa.array(held.values(), pa.int64())]
            batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])
            n.clear()
            held.clear()
            return batch

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                for term, k in Counter((text.as_py() or b"").translate(_TERMS).split()).items():
                    key = (lang, source, term)
                    n[key] = n.get(key, 0) + k
                    held[key] = held.get(key, 0) + 1
                if len(n) >= HELD:
                    yield out()
        yield out()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), in two steps, so that it stays exact up to 10**13 words."""
    d = total + 2 * terms
    high, rest = F.call_function("div", (n + 2) * 100_000, d), ((n + 2) * 100_000) % d
    return 1 + high * 10_000 + F.call_function("div", rest * 10_000, d)


def shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    high, rest = np.divmod((n + 2) * 100_000, d)
    return 1 + high * 10_000 + rest * 10_000 // d


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tree:
    """A K-squared tree of the cells (row, column) of a matrix: at each level the nodes that aren't empty, sorted."""

    def __init__(self, rows: int, row: np.ndarray, column: np.ndarray, n: np.ndarray, depth: int):
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        self.rows, self.depth, self.n = rows, depth, n[order]
        self.levels = [np.unique(self._name(row >> k, column >> k)) for k in range(depth, 0, -1)] + [self._name(row, column)]

    @staticmethod
    def _name(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return row << 32 | column

    def find(self, level: int, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the nodes aren't empty, and where they are in their level."""
        name, nodes = self._name(row, column), self.levels[level]
        if len(nodes) == 0:
            return np.zeros(len(name), bool), np.zeros(len(name), np.int64)
        at = np.minimum(np.searchsorted(nodes, name), len(nodes) - 1)
        return nodes[at] == name, at

    def counts(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        held, at = self.find(self.depth, row, column)
        return np.where(held, self.n[at], 0) if len(self.n) else np.zeros(len(row), np.int64)


def walked(a: Tree, b: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (row of a, row of b, column) where a, b or both have a count. The others are never reached: a quadrant is
    left where it is empty in both. ``same``: a is b, and each pair of rows comes once."""
    first = np.zeros(1, np.int64)
    todo = [(0, first, first, first)]
    while todo:
        level, i, j, c = todo.pop()
        side = a.depth - level
        held = (a.find(level, i, c)[0] | b.find(level, j, c)[0]) & (i << side < a.rows) & (j << side < b.rows)
        if same:
            held &= (i < j) if level == a.depth else (i <= j)
        i, j, c = i[held], j[held], c[held]
        if level == a.depth:
            yield i, j, c
            continue
        # Down to strips of WALK columns one quadrant column at a time, so that few cells are held at once.
        parts = [c == x for x in np.unique(c)] if 1 << side >= WALK else [slice(None)]
        for part in parts:
            x, y, z = (2 * v[part] for v in (i, j, c))
            todo.append((level + 1, *(np.concatenate([v + (k >> s & 1) for k in range(8)]) for v, s in ((x, 2), (y, 1), (z, 0)))))


def pair_sums(cells: DataFrame) -> DataFrame:
    """lang, source, item, d, e, terms, total, cells: for two sources of a language their summed distances over the
    cells of a strip that a walk reaches, and how many those are.

    ``cells``: lang, lo, hi (bands), strip, band, source, d (N + 2V), terms (V), column and n. Rows without a column
    list the sources, of which each task has all of its two bands.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        band, source = table["band"].to_numpy(), table["source"].to_pylist()
        column, n, d = table["column"].to_numpy(), table["n"].to_numpy(), table["d"].to_numpy()
        lists = column < 0
        sides = []
        for x in (lo, hi):
            listed = sorted((source[k], int(d[k])) for k in np.flatnonzero(lists & (band == x)))
            at = {s: k for k, (s, _) in enumerate(listed)}
            mine = np.flatnonzero(~lists & (band == x))
            row = np.fromiter((at[source[k]] for k in mine), np.int64, len(mine))
            sides.append(([s for s, _ in listed], np.array([v for _, v in listed], np.int64), row, column[mine], n[mine]))
        top = max([1, *(len(s[0]) for s in sides), *(int(s[3].max(initial=0)) + 1 for s in sides)])
        depth = max(1, (top - 1).bit_length())
        (names, d_a, *_), (others, d_b, *_) = sides
        a = Tree(len(names), *sides[0][2:], depth)
        b = a if lo == hi else Tree(len(others), *sides[1][2:], depth)
        total, reached = (np.zeros(len(names) * len(others), np.int64) for _ in range(2))
        if len(a.n) or len(b.n):
            for i, j, c in walked(a, b, lo == hi):
                p, q = shares(a.counts(i, c), d_a[i]), shares(b.counts(j, c), d_b[j])
                at = i * len(others) + j
                order = np.argsort(at, kind="stable")
                pairs, starts = np.unique(at[order], return_index=True)
                if len(pairs):
                    total[pairs] += np.add.reduceat(distance(p, q)[order], starts)
                    reached[pairs] += np.diff(np.append(starts, len(at)))
        i, j = np.divmod(np.arange(len(total)), max(1, len(others)))
        use = np.flatnonzero(i < j) if lo == hi else np.arange(len(total))
        i, j = i[use], j[use]
        k = len(use)
        terms = table["terms"][0].as_py()
        columns = [pa.array([key[0].as_py()] * k, pa.string()), pa.array([names[x] for x in i], pa.string()), pa.array([others[x] for x in j], pa.string())]
        columns += [pa.array(x, pa.int64()) for x in (d_a[i], d_b[j], np.full(k, terms), total[use], reached[use])]
        return pa.Table.from_arrays(columns, names=["lang", "source", "item", "d", "e", "terms", "total", "cells"])

    shape = "lang string, source string, item string, d long, e long, terms long, total long, cells long"
    return cells.groupBy("lang", "lo", "hi", "strip").applyInArrow(run, shape)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item").cast("binary"))
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each group the distance to every other source of its language (part
    ``pair``), and the kept terms that it has more of than its language, the most telling first (part ``term``)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counts = written(term_counts(rows), "term-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    # Columns: strips by a hash of the term, and within a strip the frequent terms first, so that quadrants are full or empty.
    kept = written(by_term.where(F.col("n_docs") >= least_docs), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    of_lang = of_lang.withColumn("strips", F.ceil(F.col("terms") / STRIP).cast("int"))
    strip = F.pmod(F.xxhash64("term"), F.col("strips").cast("long")).cast("int")
    in_strip = Window.partitionBy("lang", "strip").orderBy(F.desc("lang_n"), "term")
    columns = kept.join(of_lang.select("lang", "strips"), "lang").withColumn("strip", strip).drop("strips")
    columns = written(columns.withColumn("column", F.row_number().over(in_strip).cast("long") - 1), "columns")
    entries = written(counts.join(columns.select("lang", "term", "strip", "column", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "strip", "column", "n", "lang_n"), "entries")

    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"]).fillna(1, ["strips"])
    groups = written(groups, "groups")
    bands = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BAND).cast("int").alias("bands"))
    groups = written(groups.join(bands, "lang").withColumn("band", F.pmod(F.xxhash64("source"), F.col("bands").cast("long")).cast("int")), "banded")

    found = entries.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("total"), F.col("terms")),
        "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms")),
    })
    gap = F.col("p") - F.col("q")
    found = found.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    terms = ranked(found).where(F.col("rank") <= top_terms)

    # Every band meets every band of its language once, strip by strip: (lo, hi) with lo <= hi.
    facts = ["lang", "source", "band", "bands", (F.col("total") + 2 * F.col("terms")).alias("d"), "terms"]
    listed = groups.select(*facts, F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")).withColumns({"column": F.lit(-1).cast("long"), "n": F.lit(0).cast("long")})
    held = entries.select("lang", "source", "strip", "column", "n").join(groups.select(*facts), ["lang", "source"])
    cells = listed.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    cells = cells.select("lang", F.least("band", "other").alias("lo"), F.greatest("band", "other").alias("hi"), "strip", "band", "source", "d", "terms", "column", "n")
    sums = pair_sums(cells).groupBy("lang", "source", "item", "d", "e", "terms").agg(F.sum("total").alias("total"), F.sum("cells").alias("cells"))
    one, two = (1 + F.when(F.col("terms") > 0, F.call_function("div", F.lit(2 * 10**9).cast("long"), F.col(c))).otherwise(0) for c in ("d", "e"))
    empty = F.call_function("div", (one - two) * (one - two), one + two)
    sums = written(sums.select("lang", "source", "item", (F.col("total") + (F.col("terms") - F.col("cells")) * empty).alias("value")), "pairs")
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = ranked(both.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(terms)


#: The same rows in plain SQL.
SQL = f"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS doc FROM documents),
    w AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
    v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY 1),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
    p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (t.total + 2 * v.terms)::HUGEINT AS p,
          1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.total + 2 * v.terms)::HUGEINT AS q
          FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
    pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
    te AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM te),
    x AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
    SELECT lang, source, part, item, value, rank FROM x WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
