"""Benchmark decontamination by a distributed positional inverted index.

The index has a row a segment, a run of whole documents: its distinct terms and, term after term, the positions where
each stands. It is written once, from one pass over the texts, and any number of tests can be held against it. A
test's windows of words are sent to every segment, a block of bounded size at a time. A window of which the segment
lacks a term is over at once; else the list of its rarest term, shifted by the term's place in the window, says where
it could start, and the lists of the other terms are intersected with that, from the rarest on. What is left after
all of them is a phrase match. Lists of one segment suffice, as no document lies in two.

A proximity match needs the window's terms within so many words of a document, in any order. It starts from the
rarest term too.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased; they are compared by 64-bit hashes,
and a phrase of ten words by ten of them. Null texts have no words. Texts are read whole, whatever their length; a
longer text than a segment is one by itself. Every row is a document of its own, whatever ids it has; benchmark rows
with one id are one item, and a null id counts as ''. Further columns are not looked at. Empty tables give rows
without hits, or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .shingling import mix, prefix_sums

#: Words of a window, and words within which the terms of a window make a proximity match.
WINDOW, SPAN = 10, 12
#: Bytes of text in a segment, unless its one document has more.
SEGMENT = 1 << 20
#: Positions left free between documents: no match spans two.
GAP = 64
#: Windows that are sent at once: up to about 20 MB and their items' ids.
BLOCK = 200_000
#: Places that are looked at at once.
PLACES = 1 << 20

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Stands for no word, in windows of fewer than WINDOW.
NONE = np.uint64(0)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, hash) of all words, in order."""
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.diff(np.concatenate(([False], _WORD[raw])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begins) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, q = prefix_sums(raw)
    word = mix((s[ends] - s[begins]) * q[begins] ^ ((ends - begins).astype(np.uint64) << np.uint64(48)))
    word[word == NONE] = np.uint64(1)
    return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, "right"), word


def _steps(x: np.ndarray) -> bytes:
    """Differences, which compress better."""
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _segment(ids: list, texts: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    doc, word = words_of(texts)
    n = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(n + GAP) - n
    at = (np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + starts[doc]).astype(np.uint32)
    order = np.argsort(word, kind="stable")
    terms, first = np.unique(word[order], return_index=True)
    counts = np.diff(np.append(first, len(word))).astype(np.uint32)
    columns = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(kind)), pa.array([n.tolist()], pa.list_(pa.int64()))]
    packed = (starts.astype(np.int64).tobytes(), terms.tobytes(), counts.tobytes(), _steps(at[order]))
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in packed)], names=["segment", "ids", "n_words", "starts", "terms", "counts", "postings"])


def index(docs: DataFrame, key: str = "doc_id", size: int = SEGMENT) -> DataFrame:
    """segment, ids, n_words, starts, terms, counts, postings: a row a segment. Written, as segments are named anew
    each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if ids and held + len(text) > size:
                    yield _segment(ids, texts, kind)
                    ids, texts, held = [], [], 0
                ids.append(batch.column(0)[k].as_py())
                texts.append(text)
                held += len(text) + 16
        if ids:
            yield _segment(ids, texts, kind)

    kind = docs.schema[key].dataType.simpleString()
    shape = f"segment string, ids array<{kind}>, n_words array<long>, starts binary, terms binary, counts binary, postings binary"
    return written(docs.select(key, "text").mapInArrow(run, shape), "index")


def windows(items: DataFrame, key: str = "item_id", width: int = WINDOW) -> DataFrame:
    """item, terms: the distinct windows of each item, as ``width`` hashes; those of a shorter item end with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, terms = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                _, word = words_of([text or b""])
                if 0 < len(word) < width:
                    word = np.concatenate((word, np.full(width - len(word), NONE)))
                for k in range(len(word) - width + 1):
                    item.append(name)
                    terms.append(word[k : k + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(terms, pa.binary())], names=["item", "terms"])

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), "text")
    return rows.mapInArrow(run, "item string, terms binary").distinct()


class Segment:
    """Posting lists of a segment, behind one sorted array of (term, position)."""

    def __init__(self, starts: bytes, terms: bytes, counts: bytes, postings: bytes):
        self.starts, self.terms = np.frombuffer(starts, np.int64), np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        at = np.cumsum(np.frombuffer(postings, np.uint32), dtype=np.uint32).astype(np.int64)
        self.postings = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) | at

    def held(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the terms (by number) stand at these positions."""
        name = term << 32 | at
        k = np.searchsorted(self.postings, name)
        return self.postings[np.minimum(k, len(self.postings) - 1)] == name

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the terms stand anywhere from low to high."""
        k = np.searchsorted(self.postings, term << 32 | np.maximum(low, 0))
        return (k < len(self.postings)) & (self.postings[np.minimum(k, len(self.postings) - 1)] <= (term << 32 | high))


class Test:
    """A block of windows: their items, and their distinct terms apart, as windows share most of them."""

    def __init__(self, items: list[str], terms: list[bytes], width: int):
        self.items = items
        wanted = np.frombuffer(b"".join(terms), np.uint64).reshape(-1, width)
        self.length = (wanted != NONE).sum(1)
        self.terms, self.which = np.unique(wanted, return_inverse=True)
        self.which = self.which.reshape(wanted.shape)

    def matches(self, held: Segment, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(window, position, near) of phrase matches and of proximity matches."""
        if len(held.terms) == 0 or len(self.items) == 0:
            return
        k = np.minimum(np.searchsorted(held.terms, self.terms), len(held.terms) - 1)
        there = (held.terms[k] == self.terms) | (self.terms == NONE)
        left = np.flatnonzero(there[self.which].all(1))  # windows of which the segment has all terms
        if len(left) == 0:
            return
        term = np.where(self.terms == NONE, -1, k)[self.which[left]]
        n = np.where(term < 0, 1 << 60, held.counts[term])
        order = np.argsort(n, axis=1, kind="stable")
        n = np.take_along_axis(n, order, 1)
        ends = np.cumsum(n[:, 0])
        a = 0
        while a < len(left):  # some windows at a time, so that few places are looked at at once
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, "right")))
            part = np.arange(a, b)
            w = np.repeat(part, n[part, 0])
            seed = order[w, 0]
            at = held.postings[held.first[term[w, seed]] + np.arange(len(w)) - np.repeat(np.cumsum(n[part, 0]) - n[part, 0], n[part, 0])] & 0xFFFFFFFF
            yield left[(x := self._phrases(held, term, order, w, at - seed))[0]], x[1], False
            yield left[(x := self._near(held, term, order, w, at, span))[0]], x[1], True
            a = b

    def _phrases(self, held: Segment, term: np.ndarray, order: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = start >= 0
        w, start = w[use], start[use]
        for k in range(1, term.shape[1]):
            place = order[w, k]
            t = term[w, place]
            use = (t < 0) | held.held(np.maximum(t, 0), start + place)
            w, start = w[use], start[use]
        return w, start

    def _near(self, held: Segment, term: np.ndarray, order: np.ndarray, w: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        for k in range(1, term.shape[1]):  # each term near enough to the rarest one
            t = term[w, order[w, k]]
            use = (t < 0) | held.within(np.maximum(t, 0), at - span + 1, at + span - 1)
            w, at = w[use], at[use]
        found = np.zeros(len(w), bool)
        for back in range(span):  # and all of them within one stretch
            todo = np.flatnonzero(~found)
            for k in range(term.shape[1]):
                low = at[todo] - back
                t = term[w[todo], order[w[todo], k]]
                todo = todo[(t < 0) | held.within(np.maximum(t, 0), low, low + span - 1)]
            found[todo] = True
        return w[found], at[found]


def matches(segments: DataFrame, tests: DataFrame, span: int = SPAN, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """segment, ord, item, near, low, high: where an item stands in a document, as runs of its words [low, high).
    Proximity matches have no run. ``tests``: as ``windows`` gives them."""
    if not width <= span <= GAP:
        raise ValueError("a span holds a window, and is no longer than the gap between documents")
    tests = written(tests, "windows")
    blocks = max(1, -(-tests.count() // block))
    shape = "segment string, ord int, item string, near boolean, low long, high long"
    out = None
    for number in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == number).collect()  # a block's windows, about BLOCK
        sent = segments.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [bytes(r["terms"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = Test(*sent.value, width)
            names = sorted(set(test.items))
            number_of = {x: k for k, x in enumerate(names)}
            item = np.fromiter((number_of[x] for x in test.items), np.int64, len(test.items))
            for batch in batches:
                for k in range(batch.num_rows):
                    held = Segment(*(batch.column(c)[k].as_py() for c in range(1, 5)))
                    runs: list[np.ndarray] = []
                    for w, at, near in test.matches(held, span):
                        doc = np.searchsorted(held.starts, at, "right") - 1
                        low = np.where(near, -1, at - held.starts[doc])
                        high = np.where(near, -1, low + test.length[w])
                        runs.append(np.unique(np.stack((np.full(len(w), near, np.int64), doc, item[w], low, high), 1), axis=0))
                    found = joined(np.unique(np.concatenate(runs), axis=0)) if runs else np.zeros((0, 5), np.int64)
                    near, doc, which, low, high = found.T
                    columns = [batch.column(0)[k : k + 1].take(pa.array(np.zeros(len(found), np.int64))), pa.array(doc.astype(np.int32)), pa.array([names[x] for x in which], pa.string()), pa.array(near.astype(bool)), pa.array(low), pa.array(high)]
                    yield pa.RecordBatch.from_arrays(columns, names=["segment", "ord", "item", "near", "low", "high"])

        found = segments.select("segment", "starts", "terms", "counts", "postings").mapInArrow(run, shape)
        out = found if out is None else out.unionByName(found)
    return out


def joined(found: np.ndarray) -> np.ndarray:
    """Sorted rows (near, document, item, low, high): runs of an item that touch are one, as are repeats."""
    if len(found) == 0:
        return found
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(1) | (found[1:, 3] > found[:-1, 4])
    first = np.flatnonzero(new)
    return np.concatenate((found[first, :4], found[np.append(first[1:], len(found)) - 1, 4:]), axis=1)


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    segments = index(docs)
    found = written(matches(segments, windows(benchmark), span, block=block), "matches")
    own = ["segment", "ord"]
    before = F.max("high").over(Window.partitionBy(*own).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    runs = found.where("NOT near").withColumn("before", F.coalesce(before, F.lit(0)))
    hit = runs.groupBy(*own).agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", "before"))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    close = found.where("near").groupBy(*own).agg(F.count_distinct("item").alias("n_near"))
    rows = segments.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ord", "doc"))
    rows = rows.join(hit, own, "left").join(close, own, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("doc.ids").alias("doc_id"),
        F.col("doc.n_words").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same rows in plain SQL.
SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS.format("text")} AS words FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("text")} AS words FROM benchmark),
    w AS (SELECT DISTINCT item, words[k:k + {WINDOW - 1}] AS terms FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS k FROM b WHERE len(words) > 0)),
    p AS (SELECT doc, words, unnest(range(1, len(words) + 1)) AS k FROM d),
    g AS (SELECT doc, k, n, words[k:k + n - 1] AS terms FROM p, (SELECT DISTINCT len(terms) AS n FROM w) l WHERE k + n - 1 <= len(words)),
    m AS (SELECT g.doc, g.k, g.n, w.item FROM g JOIN w ON w.terms = g.terms),
    h AS (SELECT doc, count(*) AS n_hit FROM (SELECT DISTINCT doc, unnest(range(k, k + n)) AS at FROM m) GROUP BY doc),
    i AS (SELECT doc, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc),
    o AS (SELECT words[k] AS word, count(*) AS n FROM p GROUP BY 1),
    s AS (SELECT item, terms, arg_min(word, (n, word)) AS rare FROM (SELECT item, terms, unnest(terms) AS word FROM w) JOIN o USING (word) GROUP BY 1, 2),
    c AS (SELECT p.doc, s.item FROM p JOIN s ON p.words[p.k] = s.rare
          WHERE len(list_filter(range(greatest(1, p.k - {SPAN - 1}), p.k + 1), lambda x: list_has_all(p.words[x:x + {SPAN - 1}], s.terms))) > 0),
    n AS (SELECT doc, count(DISTINCT item) AS n_near FROM c GROUP BY doc)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN h USING (doc) LEFT JOIN i USING (doc) LEFT JOIN n USING (doc)"""
