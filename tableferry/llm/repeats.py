"""Exact removal of repeated byte strings by sparse prefix doubling: ranks of windows at growing lengths.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Ranking every byte
position would write many times the input, so ranked positions are sparse: a window (a string of that length) is
named by an anchor inside it, the position with the least hash among the 200-byte strings that the window holds.
Equal windows have their anchors at the same place. An anchor stands for all windows that it names at once, up
to 201, which have its 200 bytes in common and span up to 600.

* Round 0 names the anchor's 200 bytes; each later round pairs the rank of the round before with the name of a
  longer common part (386, then 400 bytes), and Spark brings equal pairs together and ranks them anew.
* A position whose rank is unique drops out.
* One whose whole span has an equal elsewhere is past the threshold: all its windows repeat.
* The rest are split into ranges of fewer windows, so that the common part grows, and are ranked again.

Only one representative of equal spans is ranked again, so copies, however many, are a few rows. Ranks are
numbers that Spark gives to whole classes; names are 64-bit hashes of the text they span. Spans count as equal if
the ranks and two names agree, 128 bits at least.

Shorter passages stay, and are told: the same ranks over words (``WORDS``) instead of bytes find every passage of 50
words or more that another document has too. Words are those of ``shingling``, so neither A-Z nor spaces between words
matter. A passage that is repeated just within one document doesn't count.

A null text has no bytes. Matches don't cross documents; overlapping ones count. Texts may be of any length.
Repeated rows are documents of their own: if their text is long enough, all its bytes go. Rows sharing a doc_id
are told apart by their text. Columns other than doc_id and text are not looked at, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, dropped, sliced, text_of, written
from .shingling import chunks, mix, prefix_sums, word_hashes

LENGTH, GRAM = 400, 200
#: Widths of the ranges of windows at an anchor, level by level.
WIDTHS = (LENGTH - GRAM + 1, 15, 1)
#: What tells documents apart: their id and a hash of their text.
KEY = ("id", "h")
#: Bytes of text that one round of array operations takes. A worker holds about 100 bytes for each of them, also between tasks.
PIECE = 1 << 18
RANKED = "id long, h long, w long, n int, prev long, common long, whole long"


@dataclasses.dataclass(frozen=True)
class Kind:
    """Strings of ``length`` bytes or words with anchors of ``gram``, ranked by ranges of ``widths``. ``across``: only those
    that two documents have count; else any two places do."""

    unit: str
    length: int
    gram: int
    widths: tuple[int, ...]
    across: bool

    def hashes(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums and inverse powers over the texts end to end, and each text's begin and end."""
        if self.unit == "word":
            doc, units = word_hashes(data)
            size = np.bincount(doc, minlength=len(data))
        else:
            size, units = np.array([len(b) for b in data], np.int64), np.frombuffer(b"".join(data), np.uint8)
        end = np.cumsum(size)
        return *prefix_sums(units), end - size, end


BYTES = Kind("byte", LENGTH, GRAM, WIDTHS, across=False)
WORDS = Kind("word", 50, 16, (35, 6, 1), across=True)


def _span(s: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((s[b] - s[a]) * q[a] ^ ((b - a).astype(np.uint64) << np.uint64(50)))


def anchors(s: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: Kind = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the first and the last start of the windows that each names.

    A window's anchor is the position with the least hash among its strings of 200 bytes (16 words), the leftmost of
    equal ones. Windows of one anchor follow each other.
    """
    n = int(end[-1]) if len(end) else 0
    if n < kind.length:
        return (np.zeros(0, np.int64),) * 3
    p = np.arange(n - kind.gram + 1)
    bits = np.uint64(int(n).bit_length())
    best = (_span(s, q, p, p + kind.gram) >> bits << bits) | p.astype(np.uint64)
    step, reach = 1, kind.widths[0]
    while step * 2 <= reach:  # best[i]: the least of positions i to i + step - 1
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < reach:
        best = np.minimum(best[: len(best) - (reach - step)], best[reach - step :])
    inside = np.zeros(n + 1, np.int64)  # windows that lie within one text
    fit = end - begin >= kind.length
    np.add.at(inside, begin[fit], 1)
    np.add.at(inside, end[fit] - kind.length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(best)] > 0)
    at = (best[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return at[new], windows[new], windows[last]


def _ranked(s, q, at: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of ranges of windows, ``first`` to ``last``, at anchors: of the part that all windows starting
    ``low`` to ``low + width - 1`` places before an anchor have in common, and of the range's whole span."""
    high = np.minimum(low + width - 1, kind.length - kind.gram)
    level = np.uint64(width)
    common = mix(_span(s, q, at - low, at - high + kind.length) ^ (low.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + level))
    cut = ((at - first).astype(np.uint64) << np.uint64(10)) + (at - last).astype(np.uint64)
    whole = mix(_span(s, q, first, last + kind.length) ^ (cut * np.uint64(0xA24BAED4963EE407) + level)) ^ common
    return common, whole


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place in its text and its range of windows, as one integer."""
    return at << 16 | (at - first) << 8 | (at - last)


def _unpack(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = w >> 16
    return at, at - (w >> 8 & 255), at - (w & 255)


def _firsts(doc: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its document with its names."""
    order = np.lexsort((*names, doc))
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for x in (doc, *names):
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.zeros(len(doc), bool)
    out[order] = new
    return out


def _rank(rows: DataFrame, kind: Kind, level: int, names_only: bool = False, among: Bits | None = None) -> DataFrame:
    """Ranges of one level with the rank of the level before, their names, and n, which is summed over equal ones: 1 for
    each, or each document, and 2 for those that were found to repeat. ``rows``: id, h, text and, past the first level, nodes
    to split (w, rank, n). ``names_only``: just the names of common parts; ``among``: only ranges whose common part
    these bits may hold."""
    width, shape = kind.widths[level], "common long" if names_only else RANKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, hs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            nodes = batch.column(3) if level else None
            for start, data in chunks(batch.column(2).to_pylist(), PIECE):
                s, q, begin, end = kind.hashes(data)
                if level == 0:
                    at, first, last = anchors(s, q, begin, end, kind)
                    doc, low, prev = np.searchsorted(end, at, "right"), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    n = np.ones(len(at), np.int32)
                else:
                    part = nodes.slice(start, len(data))
                    doc = np.repeat(np.arange(len(data)), part.value_lengths().to_numpy(zero_copy_only=False))
                    w, prev, n = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
                    at, first, last = _unpack(w)
                    cells = (at - first) // width - (at - last) // width + 1
                    nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
                    low = np.repeat((at - last) // width, cells) * width + nth * width
                    doc, at, first, last, prev, n = (np.repeat(x, cells) for x in (doc, at, first, last, prev, n))
                    first, last = np.maximum(first, at - low - (width - 1)), np.minimum(last, at - low)
                    at, first, last = (x + begin[doc] for x in (at, first, last))
                common, whole = _ranked(s, q, at, low, first, last, width, kind)
                if names_only:
                    common = common[_firsts(doc, common)] if kind.across else common
                    yield pa.RecordBatch.from_arrays([pa.array(common.view(np.int64))], names=["common"])
                    continue
                if among is not None:
                    hit = among.may_hold(common.view(np.int64))
                    doc, at, first, last, n, prev, common, whole = (x[hit] for x in (doc, at, first, last, n, prev, common, whole))
                if kind.across:
                    n = np.where(n > 1, 2, _firsts(doc, whole, common, prev)).astype(np.int32)
                w = _pack(at, first, last) - (begin[doc] << 16)
                columns = (ids[start + doc], hs[start + doc], w, n, prev, common.view(np.int64), whole.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "h", "w", "n", "prev", "common", "whole"])

    return rows.select(*KEY, "text", *(["nodes"] if level else [])).mapInArrow(run, shape)


def _decided(rows: DataFrame, kind: Kind, level: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, h, w) of ranges that repeat; (id, h, nodes) of those to rank again, if there is a further level, each with
    one representative of every repeated span of its class.

    At the first level, whose ranges are one to every hundred bytes of text, only the names of common parts are
    brought together; rows are written for those that may occur twice, as told by bits of bounded size.
    """
    among, keys = None, ["prev", "common"] if level else ["common"]
    if level == 0:
        names = _rank(rows, kind, 0, names_only=True).groupBy("common").agg(F.count(F.lit(1)).alias("n"))
        shared = written(names.where("n > 1").select("common"), "shared")
        among = Bits(shared)
        dropped(shared)
    alive = written(_rank(rows, kind, level, among=among).select(*KEY, "w", "n", *keys, "whole"), f"alive-{level}")
    one = F.struct(*KEY, "w")
    spans = written(alive.groupBy(*keys, "whole").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, one)).alias("one")), f"spans-{level}")
    repeated = written(alive.where("n < 2").join(spans.where("n > 1").select(*keys, "whole"), [*keys, "whole"], "left_semi").select(*KEY, "w"), f"found-{level}")
    if level + 1 == len(kind.widths):
        dropped(alive, spans)
        return repeated, None
    # Classes with a span that has no equal yet go on, under a number of their own.
    open_ = spans.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1 AND least = 1")
    ranks = written(open_.select(*keys, F.monotonically_increasing_id().alias("rank")), f"ranks-{level}")
    again = spans.join(ranks, keys).select("one.*", "rank", F.least("n", F.lit(2)).cast("int").alias("n"))
    if kind.across:  # a span that just one document has, at its further places there
        more = alive.where("n = 0").join(spans.where("n = 1").select(*keys, "whole"), [*keys, "whole"], "left_semi")
        again = again.unionByName(more.join(ranks, keys).select(*KEY, "w", "rank", "n"))
    nodes = written(again.groupBy(*KEY).agg(F.collect_list(F.struct("w", "rank", "n")).alias("nodes")), f"nodes-{level}")
    dropped(alive, spans, ranks)
    return repeated, nodes


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "h": F.xxhash64("text")})


def _met(docs: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``docs``, which Python has filtered, joined by id and h. Always by a shuffle: after a broadcast, a task would hold a
    Python worker for the filter and one for what comes after the join, and executors keep all their workers."""
    return docs.join(few.hint("merge"), list(KEY), how)


def removed_runs(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes (words) that the windows from first to last starts cover."""
    runs: list[list[int]] = []
    for first, last in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    return [(a, b) for a, b in runs]


def repeated_runs(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """id, h, runs: the bytes (words) that repeat, as sorted runs from a to b. ``docs``: id, h, text."""
    rows, out = docs, None
    for level in range(len(kind.widths)):
        found, nodes = _decided(rows, kind, level)
        out = found if out is None else out.union(found)
        if nodes is not None:
            rows = _met(docs.where(Bits(nodes.select("h")).test("h")), nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            runs = []
            for w in batch.column(2):
                _, first, last = _unpack(np.array(w.as_py(), np.int64))
                runs.append([{"a": a, "b": b} for a, b in removed_runs(list(zip(first.tolist(), last.tolist(), strict=True)), kind.length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["id", "h", "runs"])

    return out.groupBy(*KEY).agg(F.collect_list("w").alias("ws")).mapInArrow(run, "id long, h long, runs array<struct<a:long,b:long>>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, text (what is left of it), and n_passages and
    n_passage_words: maximal runs of words of the given text that lie in passages of 50 words or more that another
    document has too, and the words in them. These count, they don't remove.

    A character that a removed run cuts in two shows in ``text`` as U+FFFD; the digest is of the bytes.
    """
    rows = _keyed(docs.select("doc_id", text_of().alias("text")))
    passages = repeated_runs(rows.where(F.octet_length("text") >= 2 * WORDS.length - 1).select(*KEY, "text"), WORDS)
    words = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    passages = written(passages.select(*KEY, F.size("runs").cast("long").alias("n_passages"), words.alias("n_passage_words")), "passages")
    runs = repeated_runs(rows.where(F.octet_length("text") >= LENGTH).select(*KEY, "text"))
    runs = written(runs.join(passages, list(KEY), "full_outer"), "runs")
    may = Bits(runs.select("h"))  # only documents that may have runs are shuffled to them
    cut = _met(rows.where(may.test("h")), runs, "left").select("doc_id", "h", "text", "runs", "n_passages", "n_passage_words")
    whole = rows.select("doc_id", "h", "text")
    return _left_over(cut, None).unionByName(_left_over(whole, may))


def _left_over(rows: DataFrame, but: Bits | None) -> DataFrame:
    """What is left of each text. ``rows``: doc_id, h, text and, if ``but`` is None, runs and counts of passages; else
    rows without, of which those that ``but`` may hold are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if but is not None:
                batch = batch.filter(pa.array(~but.may_hold(batch.column(1).to_numpy(zero_copy_only=False))))
            n, removed, spans, sha, kept = [], [], [], [], []
            runs = batch.column(3).to_pylist() if but is None else [None] * batch.num_rows
            for t, cuts in zip(batch.column(2).to_pylist(), runs, strict=True):
                data, at, parts = t.encode("utf-8"), 0, []
                for cut in cuts or ():
                    parts.append(data[at : cut["a"]])
                    at = cut["b"]
                left = b"".join([*parts, data[at:]])
                n.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(len(cuts or ()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if cuts else t)
            left_over = [a - b for a, b in zip(n, removed, strict=True)]
            counts = [pa.array(x, pa.int64()) for x in (n, removed, spans, left_over)]
            shared = [pc.fill_null(batch.column(k), 0) if but is None else pa.array(np.zeros(len(n), np.int64)) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], pa.array(sha, pa.string()), counts[3], pa.array(kept, pa.string()), *shared], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text", "n_passages", "n_passage_words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, text string, n_passages long, n_passage_words long")
