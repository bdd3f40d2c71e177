"""Near-duplicate documents by HyperMinHash registers, and their connected components.

A document's set of shingle hashes is split into buckets; each register holds the leading zeros and some
mantissa bits of its bucket's least hash. Bands of registers propose pairs, a collision-corrected
estimate of the Jaccard similarity drops most wrong ones, and the full sets decide.

Documents with equal sets are one node, so copies, however many, are summed before anything is paired.
In a band's bucket every node is paired with the bucket's least node, and those that this leaves in other
components with the least of them. For buckets that still hold several components, prefix filtering
over the rarest shingles finds all pairs across components that can be linked; pairs within a component
can't change a result. No bucket is collected, capped or dropped.

Null and empty texts have the empty set and are linked with nothing; texts may be of any length. Rows that share a doc_id are one
node. A row with a null doc_id is linked with nothing and kept; its component_id is null. An empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import sliced, written
from .shingling import chunks, shingle_hashes

#: Registers, mantissa bits, and registers a band. A pair at the threshold shares no band with
#: probability (1 - 0.85**4)**32, under 1e-10.
REGISTERS, MANTISSA, BAND = 128, 10, 4
BITS = REGISTERS.bit_length() - 1
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Standard errors below the threshold at which an estimate still goes to the full sets.
SLACK = 6.0
#: Ids (16 MB of them) up to which texts are picked by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 2_000_000
#: Rows of one shingle that a task pairs with the others of that shingle.
MEETING = 256
#: Bytes of text that one round of array operations takes: a worker holds a few times their hashes.
SOME = 400_000

_probes = np.random.default_rng(11).integers(0, REGISTERS, (64, REGISTERS))


def registers(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS of 16 bits. An empty bucket takes the register of another by a fixed probing."""
    out = np.full((n, REGISTERS), 0xFFFF, np.uint16)
    if len(hashes) == 0:
        return out
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.ones(len(hashes), bool)  # hashes are sorted, so the first of a bucket is its least
    first[1:] = (docs[1:] != docs[:-1]) | (bucket[1:] != bucket[:-1])
    rest = (hashes[first] << np.uint64(BITS)) & np.uint64(0xFFFFFFFFFFFFF800)
    zeros = np.where(rest > 0, 64 - np.frexp(rest.astype(np.float64))[1], 64 - BITS).astype(np.uint64)
    mantissa = np.where(zeros < 63, rest << np.minimum(zeros + np.uint64(1), np.uint64(63)), 0).astype(np.uint64) >> np.uint64(64 - MANTISSA)
    out[docs[first], bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    own = out.copy()
    some = (own != 0xFFFF).any(1)
    for probe in _probes:
        rows = np.flatnonzero(some & (out == 0xFFFF).any(1))
        if len(rows) == 0:
            return out
        part = out[rows]
        out[rows] = np.where(part == 0xFFFF, own[rows][:, probe], part)
    for row in np.flatnonzero(some & (out == 0xFFFF).any(1)):
        held = np.flatnonzero(own[row] != 0xFFFF)
        empty = np.flatnonzero(out[row] == 0xFFFF)
        out[row, empty] = own[row, held[np.searchsorted(held, empty) % len(held)]]
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (size of the set), s1 and s2 (a 128-bit digest of the set), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = batch.column(0)
            for start, data in chunks(batch.column(1).to_pylist(), SOME):
                d, h = shingle_hashes(data)
                n = np.bincount(d, minlength=len(data))
                at = np.cumsum(n) - n
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
                squares = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * (h | np.uint64(1)) ^ (h >> np.uint64(7)))))
                regs = registers(d, h, len(data))
                columns = [keys.slice(start, len(data)), pa.array(n, pa.int64())]
                columns += [pa.array((x[at + n] - x[at]).view(np.int64), pa.int64()) for x in (total, squares)]
                columns.append(pa.array([r.tobytes() for r in regs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "registers"])

    return docs.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, s1 long, s2 long, registers binary")


def bands(nodes: DataFrame) -> DataFrame:
    """node, band, value: a band's registers, packed into 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = REGISTERS // BAND
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(ids), count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(ids))), pa.array(values.ravel())], names=["node", "band", "value"])

    return nodes.select("node", "registers").mapInArrow(run, "node long, band int, value long")


def chance_collision(n_a: float, n_b: float) -> float:
    """Probability that registers of unrelated sets of these sizes agree."""
    k = np.arange(0, 64 - BITS, dtype=np.float64)

    def zeros(n: float) -> np.ndarray:
        per = max(1.0, n / REGISTERS)
        return (1 - 2.0 ** -(k + 1)) ** per - (1 - 2.0**-k) ** per

    return float((zeros(n_a) * zeros(n_b)).sum() / 2**MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> float:
    chance = chance_collision(n_a, n_b)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def likely(pairs: DataFrame, nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule out a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    joined = joined.where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = threshold / 100
        for batch in sliced(batches):
            a, b, n_a, n_b, r_a, r_b = (batch.column(k).to_pylist() for k in range(6))
            keep = [
                estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), p, q) >= t - SLACK * (t * (1 - t) / min(REGISTERS, p, q)) ** 0.5
                for x, y, p, q in zip(r_a, r_b, n_a, n_b, strict=True)
            ]
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose full sets are alike. ``texts``: node, text.

    Rows come sorted by a, so the set of a node with many partners is made once a task.
    """
    joined = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")).hint("merge"), "a")
        .select("a", "b", "t_a", "t_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in sliced(batches):
            a, b, t_a, t_b = (batch.column(k).to_pylist() for k in range(4))
            keep = np.zeros(len(a), bool)
            for start, data in chunks(t_b, SOME):
                d, h = shingle_hashes(data)
                ends = np.cumsum(np.bincount(d, minlength=len(data)))
                for k, end in enumerate(ends):
                    own = h[(ends[k - 1] if k else 0) : end]
                    if t_a[start + k] != held[0]:
                        held = t_a[start + k], shingle_hashes([t_a[start + k].encode()])[1]
                    both = len(np.intersect1d(own, held[1], assume_unique=True))
                    keep[start + k] = 100 * both >= threshold * (len(own) + len(held[1]) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[keep]) for x in (a, b)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, component (least node reachable): least labels of neighbours, then labels of labels."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = written(nodes.select("node", F.col("node").alias("component")), name)
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("least"))
        step = label.join(near, label.node == near.a, "left").select("node", "component", F.least("component", "least").alias("least"))
        other = label.select(F.col("node").alias("least"), F.col("component").alias("beyond"))
        new = step.join(other, "least").select("node", F.least("least", "beyond").alias("new"), "component")
        moved = Observation()
        new = new.observe(moved, F.count(F.when(F.col("new") < F.col("component"), 1)).alias("n"))
        label = written(new.select("node", F.col("new").alias("component")), name)
        if not moved.get["n"]:
            return label


def shingle_rows(texts: DataFrame) -> DataFrame:
    """node, s (a hash of the text), n (size of the set), h: a row for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, sets = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for start, data in chunks(batch.column(2).to_pylist(), SOME):
                d, h = shingle_hashes(data)
                n = np.bincount(d, minlength=len(data))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[start + d]), pa.array(sets[start + d]), pa.array(n[d], pa.int64()), pa.array(h.view(np.int64))], names=["node", "s", "n", "h"])

    return texts.select("node", F.xxhash64("text").alias("s"), "text").mapInArrow(run, "node long, s long, n long, h long")


def across(texts: DataFrame, label: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose sets may be alike, by prefix filtering.

    The shingles of each set are put in order of rarity. Two alike sets of n and m shingles share at least
    ``need = ceil(t / (100 + t) * (n + m))``, so the first shared one stands before the last ``need`` of
    both. A set whose own edits fill these places meets nothing, however many copies its origin has.
    """
    rows = written(shingle_rows(texts).join(label, "node"), "shingles")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("df > 1")
    known = rows.join(written(shared.select("h", "df"), "shared"), "h")
    least = F.ceil(F.col("n") * threshold / 100)  # shared with the smallest set that is alike
    prefix = (
        known.groupBy("node", "s", "n", "component").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("hs"))
        .withColumn("own", F.col("n") - F.size("hs"))
        .select("node", "n", "component", "own", F.posexplode("hs").alias("i", "x"))
        .select("node", "n", "component", (F.col("i") + F.col("own")).alias("i"), "x.h")
        .where(F.col("i") + least <= F.col("n"))
    )
    prefix = written(prefix, "prefixes")
    several = prefix.groupBy("h").agg(F.min("component").alias("lead"), F.max("component").alias("last"), F.count(F.lit(1)).alias("rows")).where("lead < last")
    mixed = written(prefix.join(written(several.drop("last"), "several"), "h"), "mixed")
    # Alike sets are of like size: they are in one class of size or in neighbouring ones. The rows of a frequent
    # shingle are dealt to several tasks on one side, and go to each of them on the other.
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold)) + 1e-9)
    parts = F.ceil(F.col("rows") / MEETING).cast("int")
    x = mixed.where("component <> lead").select("h", size.alias("size"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "component", "i")))
    y = mixed.select("h", F.explode(F.array(size - 1, size, size + 1)).alias("size"), parts.alias("parts"), *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "component", "i")))
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * threshold / (100 + threshold))
    meets = (F.col("component_x") != F.col("component_y")) & (F.col("i_x") + need <= F.col("n_x")) & (F.col("i_y") + need <= F.col("n_y"))
    return x.join(y, ["h", "size", "part"]).where(meets).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, component_id, kept.

    What rows are joined to by a bucket or a shingle is written first: Spark splits the rows of a frequent key
    only between two plain shuffles, not where one side is still being summed.
    """
    signed = written(signatures(docs, key, text), "signatures")
    sets = ["n", "s1", "s2"]
    has = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = written(signed.where(has).groupBy(*sets).agg(F.min("id").alias("node"), F.first("registers").alias("registers")), "classes")
    banded = bands(classes)
    crowd = banded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "value", "hub")
    crowded = written(banded.join(written(crowd, "crowd"), ["band", "value"]), "crowded")

    touched = written(crowded.select("node").distinct(), "touched")
    texts = written(picked(docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).where("text IS NOT NULL"), touched), "texts")
    # Each bucket's least node with its other members; then the least of those not linked to it with the rest.
    stars = crowded.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = written(confirmed(likely(stars, classes, threshold), texts, threshold), "links")
    linked_to = links.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    apart = written(crowded.where("node <> hub").join(linked_to, ["hub", "node"], "left_anti").select("band", "value", "node"), "apart")
    hubs = apart.groupBy("band", "value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    again = apart.join(written(hubs, "hubs"), ["band", "value"]).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = links.union(written(confirmed(likely(again, classes, threshold), texts, threshold), "links"))
    label = components(touched, links)

    # All members of buckets that still hold several components, by the shingles they share.
    held = crowded.select("band", "value", "node").join(label, "node")
    several = held.groupBy("band", "value").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band", "value")
    rest = written(crowded.join(written(several, "several"), ["band", "value"], "left_semi").select("node").distinct(), "rest")
    pairs = across(picked(texts, rest), label, threshold)
    more = written(confirmed(likely(pairs, classes, threshold), texts, threshold), "links")
    if not more.isEmpty():
        label = components(touched, links.union(more))

    by_class = classes.select(*sets, "node").join(label, "node", "left").select(*sets, F.coalesce("component", "node").alias("component"))
    linked = signed.select("id", *sets).join(by_class, sets, "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def picked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of the nodes; the nodes are broadcast if they are few."""
    return texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")
