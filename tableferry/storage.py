"""Versioned tables: immutable files, and a small manifest for each version.

A version's manifest is written under a private name and then published under its number, whole, in one step that
fails where the number is taken. It carries the table's facts (watermark, batch id, ...) and names the lists of files
that make the version, so both become visible at once. A writer that finds its number taken looks at what was
committed meanwhile: if that touched nothing it has read or removed, it publishes the same files under the next number;
else it fails with ``Conflict``, and nothing of it shows.

Rows lie in buckets by a hash of their key. Inserting adds files. Merging adds a delta: a file of keys and the columns
that were written, with the number of its version; readers put the last written value of each column in place, and
``fold`` makes base files of them later. The number of buckets grows with the table (linear hashing), while files
that were written before stay as they are: a bucket is found in the files of the bucket it was split from. Each file
is listed with its rows, bytes, buckets and the least and greatest values of its key and time columns, and a small one with
a filter of its keys, so reads of few keys or of late rows open few files.
"""

from __future__ import annotations

import base64
import decimal
import hashlib
import json
import os
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table with a key, and bytes of a bucket: with more, there are more buckets.
BUCKETS, BUCKET_BYTES = 16, 256 << 20
#: Lists of files that a manifest names before they are joined, and commits that it remembers for late writers.
MOST_LISTS, RECENT = 64, 200
#: Parts that rows are dealt to by their bucket, at most. Buckets of one part follow each other.
MOST_TASKS = 16_384
#: Rows of a file that tell how large a row is.
TELLING = 10_000
#: Bits of a filter of keys, and rows of a file that has one: with more it would tell little.
FILTER_BITS, FILTER_ROWS = 8 * 4096, 8192
#: Facts of which two writers can't both be right.
GUARDED = ("watermark", "batch_id", "tasks")
#: File systems whose rename isn't one step that fails where the name is taken.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs", "swift"}


class Conflict(RuntimeError):
    """Another writer has committed what this one relied on."""


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, ``spark.checkpoint.dir``; one of its own in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tableferry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tableferry-{uuid.uuid4().hex[:12]}/{name}"


class Files:
    """Small texts in a folder of any file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def text(self, name: str) -> str:
        fs, p = self._fs(f"{self.folder}/{name}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        out = fs.create(p, False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def delete(self, name: str) -> bool:
        fs, p = self._fs(f"{self.folder}/{name}")
        return bool(fs.delete(p, True))


class Versions(Files):
    """Numbered small files in a folder. One is there whole or not at all, and the first writer of a number has it."""

    def numbers(self) -> list[int]:
        return [int(n) for n in self.names() if n.isdigit()]

    def get(self, number: int) -> dict[str, Any]:
        return json.loads(self.text(f"{number:010d}"))

    def latest(self) -> tuple[int, dict[str, Any] | None]:
        """The last file and its number; 0 and None if there is none."""
        number = max(self.numbers(), default=0)
        return number, self.get(number) if number else None

    def put(self, number: int, said: dict[str, Any]) -> None:
        """Publish a file; Conflict if the number is taken."""
        fs, target = self._fs(f"{self.folder}/{number:010d}")
        scheme = fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            raise ValueError(f"versions need a rename in one step, which {scheme} doesn't have")
        private = f"private-{uuid.uuid4().hex}"
        self.write(private, json.dumps(said, default=str))
        try:
            source = self._fs(f"{self.folder}/{private}")[1]
            if scheme == "file":  # its rename would overwrite; a link never does
                try:
                    os.link(source.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    raise Conflict(f"version {number} was committed by another writer") from None
            elif not fs.rename(source, target):
                raise Conflict(f"version {number} was committed by another writer")
        finally:
            self.delete(private)


def ancestor(bucket: int, n: int) -> int:
    """Where the rows of a bucket lay when there were ``n`` buckets."""
    while bucket >= n:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def meet(a: Iterable[int], n: int, b: Iterable[int], m: int) -> bool:
    """Whether buckets of n and buckets of m can share rows."""
    less = min(n, m)
    return not {ancestor(x, less) for x in a}.isdisjoint({ancestor(x, less) for x in b})


#: Types whose order least and greatest values are kept in.
ORDERED = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double", "date", "timestamp", "string")


def ordered(kind: str) -> bool:
    return kind.split("(")[0].removesuffix("_ntz") in ORDERED


def bound(x: Column, kind: str) -> Column:
    """A value as text that ``comparable`` takes, whatever the session's time zone."""
    return F.unix_micros(x).cast("string") if kind == "timestamp" else x.cast("string")


def comparable(text: str, kind: str) -> Any:
    if kind in ("float", "double"):
        return float("inf") if text == "NaN" else float(text)
    return text if kind.startswith(("string", "date", "timestamp_ntz")) else decimal.Decimal(text)


class SnapshotTable:
    """A table with versions. With a ``key`` its rows lie in ``buckets`` at first. Rows with a NULL in their key match
    nothing. Rows that are merged have distinct keys."""

    def __init__(self, spark: SparkSession, root: str, key: Iterable[str] = (), buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.key = spark, root.rstrip("/"), tuple(key)
        self.buckets, self.bucket_bytes = buckets if self.key else 1, bucket_bytes
        self._versions, self._lists = Versions(spark, f"{self.root}/manifests"), Files(spark, f"{self.root}/lists")
        self._known: dict[str, dict[str, Any]] = {}

    # -- what a version has ---------------------------------------------------------------------
    def versions(self) -> list[int]:
        return self._versions.numbers()

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """version, lists (of files, each with its sequence number), batch_id, watermark, and what else the commit
        said; version 0 if there is none."""
        said = self._versions.latest()[1] if version is None else self._versions.get(version)
        return said or {"version": 0, "lists": [], "recent": [], "schema": None, "batch_id": -1, "watermark": None, "key": list(self.key), "buckets": self.buckets}

    def _list(self, name: str) -> dict[str, Any]:
        if name not in self._known:
            self._known[name] = json.loads(self._lists.text(name))  # written once, so never out of date
        return self._known[name]

    def files(self, version: int | dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """The files of a version: path, of (files of its folder), rows, loose (rows without a whole key), bytes, buckets and of how many, columns
        (of a delta, else None), filter (which bits its keys have, of small files), low, high, seq."""
        said = version if isinstance(version, dict) else self.manifest(version)
        live: dict[str, dict[str, Any]] = {}
        for name, seq in said["lists"]:
            changes = self._list(name)
            for path in changes["gone"]:
                live.pop(path, None)
            for f in changes["adds"]:
                live[f["path"]] = {"seq": seq} | f
        return list(live.values())

    def _schema(self, said: dict[str, Any]) -> StructType:
        if said["schema"] is None:
            raise ValueError(f"nothing has been committed to {self.root}")
        return StructType.fromJson(said["schema"])

    # -- buckets ----------------------------------------------------------------------------------
    def bucket(self, rows: DataFrame, said: dict[str, Any] | None = None, n: int | None = None) -> Column:
        """The bucket of a row. Rows with a NULL in their key are spread by all columns."""
        said = said or self.manifest()
        key, n = said["key"], n or said["buckets"]
        if n == 1 or not key:
            return F.lit(0)
        h = F.when(self._whole(key), F.xxhash64(*self._typed(rows, said))).otherwise(F.xxhash64(*rows.columns))
        half = 1 << (n.bit_length() - 1)
        at = F.pmod(h, F.lit(2 * half))
        return F.when(at < n, at).otherwise(at - half).cast("int")

    @staticmethod
    def _typed(rows: DataFrame, said: dict[str, Any]) -> list[Column]:
        """The key's columns in the table's types."""
        types = {f.name: f.dataType for f in StructType.fromJson(said["schema"])} if said["schema"] else {}

        def same(c: str) -> Column:
            x = F.col(c).cast(types[c]) if c in types else F.col(c)
            kind = types[c].simpleString() if c in types else dict(rows.dtypes)[c]
            return x + 0.0 if kind in ("double", "float") else x  # -0.0 and 0.0 are one key

        return [same(c) for c in said["key"]]

    def _bit(self, rows: DataFrame, said: dict[str, Any]) -> Column:
        """The bit of a row's key in the filters of small files; NULL without a whole key."""
        return F.when(self._whole(said["key"]), F.pmod(F.xxhash64(*self._typed(rows, said), F.lit(1)), F.lit(FILTER_BITS)))

    @staticmethod
    def _whole(key: Iterable[str]) -> Column:
        out = F.lit(True)
        for c in key:
            out = out & F.col(c).isNotNull()
        return out

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that hold the rows' keys, if anything does: numbers, as many as buckets at most."""
        said = self.manifest()
        rows = rows.where(self._whole(said["key"]))
        return sorted(r[0] for r in rows.select(self.bucket(rows, said)).distinct().collect())

    # -- reading ----------------------------------------------------------------------------------
    def read(
        self, version: int | None = None, buckets: Iterable[int] | None = None, where: dict[str, tuple[Any, Any]] | None = None, bits: set[int] | None = None, since: int = 0
    ) -> DataFrame:
        """The rows of a version, or those in some of its buckets. ``where``: for columns the least and greatest value
        that the caller looks for (or None), and ``bits``: those of keys; files without any are left out, rows aren't
        filtered. ``since``: only files that came after that version."""
        said = self.manifest(version)
        schema = self._schema(said)
        live = [f for f in self.wanted(said, buckets, where, bits) if f["seq"] > since]
        rows = self._resolved(live, schema, said["key"])
        if buckets is None or said["buckets"] == 1:
            return rows
        held = set(buckets)
        if all(f["n"] == said["buckets"] and held.issuperset(f["buckets"]) for f in live):
            return rows
        return rows.where(self.bucket(rows, said).isin(sorted(held)))

    def wanted(
        self, said: dict[str, Any], buckets: Iterable[int] | None = None, where: dict[str, tuple[Any, Any]] | None = None, bits: set[int] | None = None
    ) -> list[dict[str, Any]]:
        """Files that may hold rows of the buckets with such values. A column that a delta has written can't tell."""
        live = self.files(said)
        if bits is not None:
            live = [f for f in live if not f["filter"] or self._passes(f["filter"], bits)]
        if buckets is not None:
            held = list(buckets)
            live = [f for f in live if meet(f["buckets"], f["n"], held, said["buckets"])]
        types = {f.name: f.dataType.simpleString() for f in self._schema(said)}
        late = {c for f in live for c in f["columns"] or ()}
        for c, bounds in self._bounds({c: x for c, x in (where or {}).items() if c not in late and ordered(types[c])}, types).items():

            def may(f: dict[str, Any], c=c, bounds=bounds) -> bool:
                if c not in f["low"]:
                    return True
                if f["low"][c] is None:  # all are NULL
                    return False
                least, most = (comparable(f[x][c], types[c]) for x in ("low", "high"))
                return (bounds[0] is None or most >= bounds[0]) and (bounds[1] is None or least <= bounds[1])

            live = [f for f in live if may(f)]
        return live

    @staticmethod
    def _passes(filter_: str, bits: set[int]) -> bool:
        held = zlib.decompress(base64.b64decode(filter_))
        return any(held[b // 8] >> b % 8 & 1 for b in bits)

    def _bounds(self, where: dict[str, tuple[Any, Any]], types: dict[str, str]) -> dict[str, list[Any]]:
        """Values to look for, in the form that files have theirs."""
        if not where:
            return {}
        columns = [bound(F.lit(x).cast(types[c]), types[c]) for c, pair in where.items() for x in pair]
        found = list(self.spark.range(1).select(*(x.alias(f"x{k}") for k, x in enumerate(columns))).first())
        return {c: [None if x is None else comparable(x, types[c]) for x in found[2 * k : 2 * k + 2]] for k, c in enumerate(where)}

    def near(self, rows: DataFrame, said: dict[str, Any] | None = None) -> tuple[DataFrame, list[int]]:
        """Rows of the table (of a version that is at hand) that may share a key with ``rows``, and their buckets: one
        pass over the keys of ``rows``, then the files in whose buckets and between whose least and greatest key they lie;
        of small files only those whose filter has one of the keys."""
        said = said or self.manifest()
        schema = self._schema(said)
        some = rows.where(self._whole(said["key"]))
        keys = [c for c in said["key"] if ordered(schema[c].dataType.simpleString())]
        bounds = [f(F.col(c).cast(schema[c].dataType)) for c in keys for f in (F.min, F.max)]
        bits = F.collect_set(self._bit(some, said)) if said["key"] else F.array()
        found = some.agg(F.collect_set(self.bucket(some, said)), bits, *bounds).first()
        buckets = sorted(found[0])
        where = {c: (found[2 + 2 * k], found[3 + 2 * k]) for k, c in enumerate(keys)}
        return self.read(said["version"], buckets, where, set(found[1]) if said["key"] else None), buckets

    def _scan(self, files: list[dict[str, Any]], schema: StructType) -> DataFrame:
        held: dict[str, list[dict[str, Any]]] = {}
        for f in files:
            held.setdefault(f["path"].rsplit("/", 1)[0], []).append(f)
        # A folder all of whose files are wanted is listed once.
        paths = [f"{self.root}/{p}" for folder, some in held.items() for p in ([folder] if len(some) == some[0]["of"] else [f["path"] for f in some])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _deltas(self, deltas: list[dict[str, Any]], schema: StructType, key: list[str]) -> tuple[DataFrame, dict[str, int]]:
        """Keys with the last written values, in a struct for each set of columns that were always written together
        (NULL if never), and which struct has a column."""
        groups: dict[tuple[int, tuple[str, ...]], list[dict[str, Any]]] = {}
        for f in deltas:
            groups.setdefault((f["seq"], tuple(f["columns"])), []).append(f)
        writers: dict[tuple[int, ...], list[str]] = {}
        for c in schema.names:
            seqs = tuple(sorted(seq for seq, columns in groups if c in columns))
            if seqs:
                writers.setdefault(seqs, []).append(c)
        classes = list(writers.values())
        frames = []
        for (seq, columns), files in sorted(groups.items()):
            rows = self._scan(files, StructType([schema[c] for c in (*key, *columns)])).where(self._whole(key))
            empty = [StructType([schema[c] for c in cs]) for cs in classes]
            values = [(F.struct(*cs) if cs[0] in columns else F.lit(None).cast(t)).alias(f"_v{k}") for k, (cs, t) in enumerate(zip(classes, empty, strict=True))]
            frames.append(rows.select(*key, F.lit(seq).alias("_seq"), *values))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        if len(frames) > 1:
            last = [F.max_by(f"_v{k}", F.when(F.col(f"_v{k}").isNotNull(), F.col("_seq"))).alias(f"_v{k}") for k in range(len(classes))]
            out = out.groupBy(*key).agg(*last)
        return out, {c: k for k, cs in enumerate(classes) for c in cs}

    def _resolved(self, live: list[dict[str, Any]], schema: StructType, key: list[str], fresh: bool = True) -> DataFrame:
        """Base rows with what deltas say of their keys and, unless told otherwise, the rows of keys that only deltas have."""
        base, deltas = self._scan([f for f in live if f["columns"] is None], schema), [f for f in live if f["columns"] is not None]
        if not deltas:
            return base
        late, of = self._deltas(deltas, schema, key)
        late = late.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(key)), *(c for c in late.columns if c.startswith("_v")))
        made = [(F.col(f"_k{key.index(c)}") if c in key else F.col(f"_v{of[c]}")[c] if c in of else F.lit(None).cast(schema[c].dataType)).alias(c) for c in schema.names]
        put = lambda c: F.when(F.col(f"_v{of[c]}").isNotNull(), F.col(f"_v{of[c]}")[c]).otherwise(F.col(c)).alias(c) if c in of else F.col(c)
        same = self._equal(key)
        if not fresh:
            return base.join(late, same, "left").select(*map(put, schema.names))
        limit = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if sum(f["bytes"] for f in deltas) <= limit:
            # Deltas that are broadcast: base rows stay where they are, and their keys are looked at once more.
            held = base.select(*key).join(late, same, "left_semi").distinct()
            rows = base.join(late, same, "left").select(*map(put, schema.names))
            rows = rows.unionByName(late.join(held, same, "left_anti").select(*made))
        else:
            both = base.withColumn("_old", F.lit(True)).join(late, same, "full_outer")
            new = [F.when(F.col("_old"), p).otherwise(x).alias(c) for c, p, x in zip(schema.names, map(put, schema.names), made, strict=True)]
            rows = both.select(*new)
        if loose := [f for f in deltas if f["loose"]]:
            for f in loose:
                some = self._scan([f], StructType([schema[c] for c in (*key, *f["columns"])])).where(~self._whole(key))
                rows = rows.unionByName(some.select(*((F.col(c) if c in some.columns else F.lit(None).cast(schema[c].dataType)).alias(c) for c in schema.names)))
        return rows

    @staticmethod
    def _equal(key: list[str]) -> Column:
        out = F.lit(True)
        for k, c in enumerate(key):
            out = out & (F.col(c) == F.col(f"_k{k}"))
        return out

    def sample(self, percent: float, seed: str = "s") -> DataFrame:
        """About so many of a hundred rows: whole files, taken in the order of a hash of what they hold until there are
        enough. The others aren't opened, so bytes read fall with the percentage. As rows lie in files by a hash of their
        key, a file is no special part of the table. Rows that only deltas have aren't among them."""
        said = self.manifest()
        live = self.files(said)
        base = [f for f in live if f["columns"] is None]
        base.sort(key=lambda f: hashlib.md5(json.dumps([f["rows"], f["buckets"], f["low"], f["high"], seed]).encode()).digest())
        wanted, taken = percent / 100 * sum(f["rows"] for f in base), []
        for f in base:
            if wanted <= 0:
                break
            taken.append(f)
            wanted -= f["rows"]
        return self._resolved(taken + [f for f in live if f["columns"] is not None], self._schema(said), said["key"], fresh=False)

    # -- writing ----------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, said: dict[str, Any], columns: list[str] | None = None) -> list[dict[str, Any]]:
        """Rows in new files. A bucket's lie together; a large one is split over tasks, small ones share a task, and
        files have no more rows than fit a bucket's bytes, as far as earlier files tell."""
        folder, n = f"data/{uuid.uuid4().hex}", said["buckets"]
        large = [f for f in self.files(said) if f["columns"] == columns and f["rows"] >= TELLING]
        most = int(self.bucket_bytes * sum(f["rows"] for f in large) / sum(f["bytes"] for f in large)) if large else 0
        if n > 1 and said["key"]:
            name = "bucket"
            while name in (c.lower() for c in rows.columns):
                name += "_"
            tasks = min(MOST_TASKS, max(n, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
            dealt = rows.withColumn(name, self.bucket(rows, said)).hint("rebalance", tasks, F.col(name)).sortWithinPartitions(name)
            dealt.drop(name).write.option("maxRecordsPerFile", most).parquet(f"{self.root}/{folder}")
        else:
            rows.write.option("maxRecordsPerFile", most).parquet(f"{self.root}/{folder}")
        return self._listed(folder, rows.schema, said, columns)

    def _listed(self, folder: str, schema: StructType, said: dict[str, Any], columns: list[str] | None) -> list[dict[str, Any]]:
        """What is to be said of the files in a folder: one pass over their key and time columns."""
        key = [c for c in said["key"] if c in schema.names]
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        watched = [c for c, kind in kinds.items() if ordered(kind) and (c in key or kind.startswith(("date", "timestamp")))]
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        whole = self._whole(key)
        bounds = [bound(f(c), kinds[c]).alias(f"{name}_{k}") for k, c in enumerate(watched) for name, f in (("low", F.min), ("high", F.max))]
        small = F.count(F.lit(1)) <= FILTER_ROWS
        filter_ = F.when(small, F.bitmap_construct_agg(F.bitmap_bit_position(self._bit(rows, said) + 1))) if key else F.lit(None)
        found = rows.groupBy("_metadata.file_name", "_metadata.file_size").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(~whole, 1)).alias("loose"), F.collect_set(self.bucket(rows, said)).alias("held"), filter_.alias("filter"), *bounds
        )
        found = found.collect()
        return [
            {
                "path": f"{folder}/{r['file_name']}", "of": len(found), "rows": r["n"], "loose": r["loose"] if key else 0, "bytes": r["file_size"], "n": said["buckets"], "buckets": sorted(r["held"]),
                "columns": columns, "filter": base64.b64encode(zlib.compress(r["filter"])).decode() if r["filter"] else None, "low": {c: r[f"low_{k}"] for k, c in enumerate(watched)}, "high": {c: r[f"high_{k}"] for k, c in enumerate(watched)},
            }
            for r in found
        ]

    def _overtaken(self, base: dict[str, Any], now: dict[str, Any], gone: set[str], depends: Iterable[int] | None, facts: dict[str, Any]) -> None:
        """Fail if what was committed between two versions is something that a writer relied on."""
        since = [(v, name) for v, name in now["recent"] if v > base["version"]]
        if len(since) < now["version"] - base["version"]:
            raise Conflict("too many versions were committed by another writer meanwhile")
        if changed := [k for k in GUARDED if k in facts and now.get(k) != base.get(k)]:
            raise Conflict(f"{', '.join(changed)} was committed by another writer")
        if now["schema"] != base["schema"]:
            raise Conflict("another schema was committed by another writer")
        for _, name in since:
            other = self._list(name) if name else {"adds": [], "gone": [], "all": False, "same": True}
            if gone.intersection(other["gone"]) or other["all"] and gone:
                raise Conflict("files were replaced and committed by another writer")
            if other["same"] or depends == []:
                continue
            if depends is None or other["all"] or any(meet(f["buckets"], f["n"], depends, base["buckets"]) for f in other["adds"]):
                raise Conflict("the same buckets were committed by another writer")

    def _commit(
        self, base: dict[str, Any], adds: list[dict[str, Any]], schema: StructType, facts: dict[str, Any],
        gone: Iterable[str] = (), depends: Iterable[int] | None = (), all_: bool = False, same: bool = False,
    ) -> dict[str, Any]:
        """Publish files and facts after ``base``, or after what others have committed since. ``depends``: buckets whose
        rows the writer has read (None: any). ``all_``: no earlier file stays. ``same``: no row changes."""
        gone = set(gone)
        name = None
        if adds or gone or all_:
            name = uuid.uuid4().hex
            self._lists.write(name, json.dumps({"adds": adds, "gone": sorted(gone), "all": all_, "same": same}))
        while True:
            now = self.manifest()
            if now["version"] != base["version"]:
                self._overtaken(base, now, gone, depends if depends is None else list(depends), facts)
            number = now["version"] + 1
            lists = ([] if all_ else now["lists"]) + ([[name, number]] if name else [])
            new = {**now, **facts, "version": number, "lists": lists, "schema": schema.jsonValue(), "recent": [*now["recent"], [number, name]][-RECENT:]}
            if len(lists) > MOST_LISTS:
                joined = uuid.uuid4().hex
                self._lists.write(joined, json.dumps({"adds": self.files(new), "gone": [], "all": True, "same": True}))
                new["lists"] = [[joined, number]]
            held = sum(f["bytes"] for f in self.files(new))
            if new["key"]:
                new["buckets"] = max(new["buckets"], -(-held // self.bucket_bytes))
            try:
                self._versions.put(number, new)
                return new
            except Conflict:
                continue

    def commit(self, rows: DataFrame, base: dict[str, Any] | None = None, **facts: Any) -> dict[str, Any]:
        """All rows anew, as the next version. Facts (batch_id, watermark, ...) become visible with it. ``base``, here
        and below: the version whose facts the caller has gone by, if not the latest."""
        base = base or self.manifest()
        said = base if base["schema"] == rows.schema.jsonValue() else base | {"schema": rows.schema.jsonValue()}
        return self._commit(base, self._write(rows, said), rows.schema, facts, depends=None, all_=True)

    def insert(self, rows: DataFrame, depends: Iterable[int] | None = (), base: dict[str, Any] | None = None, **facts: Any) -> dict[str, Any]:
        """Further rows, in files of their own; none that exist are read or written. ``depends``: buckets that were
        searched for the rows' keys."""
        base = base or self.manifest()
        return self._commit(base, self._write(rows, base), self._schema(base), facts, depends=depends)

    def merge(self, rows: DataFrame, depends: Iterable[int] | None = (), base: dict[str, Any] | None = None, **facts: Any) -> dict[str, Any]:
        """Values for keys, as a delta: known keys get the columns that ``rows`` has, others become rows. Nothing is read.
        Where two writers merge the same key, the later commit counts."""
        base = base or self.manifest()
        schema = self._schema(base)
        columns = [c for c in schema.names if c in rows.columns and c not in base["key"]]
        typed = rows.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in (*base["key"], *columns)))
        return self._commit(base, self._write(typed, base, columns), schema, facts, depends=depends)

    def publish(self, **facts: Any) -> dict[str, Any]:
        """A version with other facts and the same rows."""
        base = self.manifest()
        return self._commit(base, [], self._schema(base), facts)

    def forget(self, column: str, value: Any, version: int | None = None) -> dict[str, Any]:
        """Drop the files all of whose rows have at most this value in a watched column, but for those that came after
        ``version``. No file is opened."""
        base = self.manifest()
        types = {f.name: f.dataType.simpleString() for f in self._schema(base)}
        most = self._bounds({column: (None, value)}, types)[column][1]
        files = self.files(base)
        if any(f["columns"] is not None for f in files):
            raise ValueError("rows with deltas can't be forgotten by file")
        gone = [f["path"] for f in files if f["high"].get(column) is not None and not f["loose"] and comparable(f["high"][column], types[column]) <= most and (version is None or f["seq"] <= version)]
        return self._commit(base, [], self._schema(base), {}, gone) if gone else base

    # -- housekeeping -----------------------------------------------------------------------------
    def fold(self, most: int = 8, share: float = 0.25) -> dict[str, Any]:
        """Keep reads cheap. Deltas that hold more than ``share`` of the base's bytes become base files, with the buckets
        they touch. Else, with more than ``most`` commits of deltas, those in a row that wrote the same columns become one
        delta. Then buckets in more than ``most`` small files are written anew, as are files that were written when
        there was a quarter of the buckets or fewer. Rows don't change, and writers in between don't disturb it."""
        said = self.manifest()
        if said["schema"] is None:
            return said
        live = self.files(said)
        deltas = [f for f in live if f["columns"] is not None]
        base_bytes = sum(f["bytes"] for f in live) - sum(f["bytes"] for f in deltas)
        if deltas and sum(f["bytes"] for f in deltas) > share * base_bytes:
            said = self._fold(said, self._closed(live, deltas))
        elif len({f["seq"] for f in deltas}) > most:
            said = self._join_deltas(said, deltas, most)
        return self._pack(said, most)

    @staticmethod
    def _closed(live: list[dict[str, Any]], some: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """``some`` files and all that share buckets with them, or with those in turn."""
        least = min(f["n"] for f in live)
        at = [{ancestor(b, least) for b in f["buckets"]} for f in live]
        seen: set[int] = set().union(*({ancestor(b, least) for b in f["buckets"]} for f in some))
        while True:
            more = seen.union(*(x for x in at if not x.isdisjoint(seen)))
            if more == seen:
                return [f for f, x in zip(live, at, strict=True) if not x.isdisjoint(seen)]
            seen = more

    def _fold(self, said: dict[str, Any], files: list[dict[str, Any]]) -> dict[str, Any]:
        schema = self._schema(said)
        adds = self._write(self._resolved(files, schema, said["key"]), said)
        return self._commit(said, adds, schema, {}, [f["path"] for f in files], depends=(), same=True)

    def _join_deltas(self, said: dict[str, Any], deltas: list[dict[str, Any]], most: int) -> dict[str, Any]:
        runs: list[list[dict[str, Any]]] = []
        for f in sorted(deltas, key=lambda f: f["seq"]):
            if runs and runs[-1][-1]["columns"] == f["columns"]:
                runs[-1].append(f)
            else:
                runs.append([f])
        if len(runs) > most:  # too mixed
            return self._fold(said, self._closed(self.files(said), deltas))
        schema, key = self._schema(said), said["key"]
        adds, gone = [], []
        for run in runs:
            if len({f["seq"] for f in run}) > 1:
                late, of = self._deltas(run, schema, key)
                rows = late.select(*key, *(F.col(f"_v{of[c]}")[c].alias(c) for c in run[0]["columns"]))
                for f in run:
                    if f["loose"]:
                        rows = rows.unionByName(self._scan([f], rows.schema).where(~self._whole(key)))
                adds += [{"seq": run[-1]["seq"]} | f for f in self._write(rows, said, run[0]["columns"])]
                gone += [f["path"] for f in run]
        return self._commit(said, adds, schema, {}, gone, same=True) if gone else said

    def _pack(self, said: dict[str, Any], most: int) -> dict[str, Any]:
        base = [f for f in self.files(said) if f["columns"] is None]
        small = [f for f in base if f["bytes"] < self.bucket_bytes // 4]
        files_of: dict[int, int] = {}
        for f in small:
            for b in f["buckets"]:
                files_of[b] = files_of.get(b, 0) + 1
        crowded = {b for b, k in files_of.items() if k > most}
        todo = [f for f in base if f["n"] * 4 <= said["buckets"] or f in small and not crowded.isdisjoint(f["buckets"])]
        if not todo:
            return said
        schema = self._schema(said)
        return self._commit(said, self._write(self._scan(todo, schema), said), schema, {}, [f["path"] for f in todo], same=True)

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> int:
        """Delete all but the last ``keep`` versions, and data and lists that these don't name and that are ``hours`` old:
        what is younger may belong to a writer that hasn't committed yet. Choose more than any write takes."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        folders = {f["path"].split("/")[1] for said in kept for f in self.files(said)}
        lists = {name for said in kept for name, _ in (*said["lists"], *((n, v) for v, n in said["recent"])) if name}
        for v in versions[:-keep]:
            self._versions.delete(f"{v:010d}")
        before, gone = (time.time() - hours * 3600) * 1000, 0
        for folder, live in (("data", folders), ("lists", lists)):
            fs, p = self._versions._fs(f"{self.root}/{folder}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in live and s.getModificationTime() <= before:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone
