"""Profiles, pre- and post-load checks, catalog work (A18, B5, B8, B9, C6-C11, D4-D20, G4, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash32, normalised_key
from ..operators import catalog as cat
from ..operators import fileprofile, hashtree, load, profile, reconcile, validate
from ..sources.scan import sample_n, tables
from ..storage import SnapshotTable, new_root
from .fixtures import MEMBER, MERGED, SRC, WITH, members
from .registry import query

KEY = ["member_id"]
WRITTEN = ["member_name", "member_grade", "balance"]
H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
AFTER = f"merged AS ({MERGED})"
#: A target after the load with seeded defects: lost, changed and doubled rows, and values set to NULL.
DEFECTS = """bad AS (SELECT member_id, CASE WHEN member_id % 31 = 0 THEN NULL ELSE member_name END AS member_name, member_grade,
    CASE WHEN member_id % 37 = 0 THEN CAST(balance + 1 AS DECIMAL(13,2)) ELSE balance END AS balance FROM merged WHERE member_id % 41 <> 0 AND member_id < 1000000
    UNION ALL SELECT member_id, member_name, member_grade, balance FROM merged WHERE member_id % 43 = 0 AND member_id < 1000000)"""


def loaded(spark, sf_dir):
    """The members' fixture, the merged target, and the target with defects."""
    m = members(spark, sf_dir)
    merged = load.merge(m.target, m.good, KEY)
    own = merged.where("member_id < 1000000").select(*KEY, *WRITTEN)
    name = F.when(F.col("member_id") % 31 == 0, F.lit(None)).otherwise(F.col("member_name"))
    balance = F.when(F.col("member_id") % 37 == 0, (F.col("balance") + 1).cast("decimal(13,2)")).otherwise(F.col("balance"))
    bad = own.where("member_id % 41 <> 0").withColumns({"member_name": name, "balance": balance}).unionByName(own.where("member_id % 43 = 0"))
    return m, merged, bad


def frame(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- profiles ---------------------------------------------------------------------------------
def _profile_sql(c: str, text: bool) -> str:
    sizes = f"max(length({c})), max(octet_length(encode({c})))" if text else "NULL::BIGINT, NULL::BIGINT"
    blank = f"count(*) FILTER ({c} IS NOT NULL AND trim({c}) = '')" if text else "0"
    top = "NULL::DOUBLE" if text else f"max(abs({c}))::DOUBLE"
    return f"SELECT '{c}', count(*), count(*) FILTER ({c} IS NULL), {blank}, {sizes}, {top} FROM src"


@query(f"WITH src AS ({SRC}), p(column_name, n_rows, n_null, n_blank, max_chars, max_bytes, max_abs) AS (" + " UNION ALL ".join(_profile_sql(c, c in ("c_name", "c_mktsegment", "c_phone")) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_phone")) + ") SELECT * FROM p")
def column_profile(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return profile.column_profile(spark.sql(SRC))


@query("SELECT max(length(text))::BIGINT AS max_chars, max(octet_length(encode(text)))::BIGINT AS max_bytes FROM documents")
def length_profile(spark, sf_dir):
    return frame(spark, sf_dir, "documents").agg(F.max(F.char_length("text")).cast("bigint").alias("max_chars"), F.max(F.octet_length("text")).cast("bigint").alias("max_bytes"))


@query("SELECT max(abs(c_acctbal)) AS max_abs, max(length(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)))::BIGINT AS int_digits FROM customer")
def number_profile(spark, sf_dir):
    x = F.abs("c_acctbal")
    return frame(spark, sf_dir, "customer").agg(F.max(x).alias("max_abs"), F.max(F.char_length(F.floor(x).cast("decimal(38,0)").cast("string"))).cast("bigint").alias("int_digits"))


@query(f"WITH src AS ({SRC}) SELECT 'c_name' AS column_name, count(*) AS n FROM src WHERE c_name IS NULL OR trim(c_name) = '' UNION ALL SELECT 'c_phone', count(*) FROM src WHERE c_phone IS NULL OR trim(c_phone) = ''")
def null_count(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return profile.null_or_blank(spark.sql(SRC), ["c_name", "c_phone"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys_source(spark, sf_dir):
    return profile.duplicate_keys(frame(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{WITH}, {AFTER}, {DEFECTS} SELECT count(*) AS n FROM (SELECT member_id FROM bad GROUP BY 1 HAVING count(*) > 1)")
def post_dup_keys(spark, sf_dir):
    return validate.counted(profile.duplicate_keys(loaded(spark, sf_dir)[2], KEY))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0)")
def orphan_rows(spark, sf_dir):
    parents = frame(spark, sf_dir, "customer").where("c_custkey % 13 <> 0")
    return profile.orphans(frame(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], parents, ["c_custkey"]).select("o_orderkey", "o_custkey")


# -- comparison by hash -----------------------------------------------------------------------
_TEXT = "CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus || chr(31) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')"
_OTHER = "SELECT o_orderkey, CASE WHEN o_orderkey % 2003 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 997 <> 0"


def _sides(spark, sf_dir):
    a = frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    status = F.when(F.col("o_orderkey") % 2003 == 0, "X").otherwise(F.col("o_orderstatus"))
    return a, a.where("o_orderkey % 997 <> 0").withColumn("o_orderstatus", status)


def _hashed(df):
    return validate.row_text(df, ["o_orderkey", "o_orderstatus", "o_orderdate"])


def _buckets_sql(expr: str) -> str:
    side = lambda t: f"SELECT h % 1024 AS bucket, count(*) AS n, sum(h) AS total FROM (SELECT {H.format(expr)} AS h FROM {t}) GROUP BY 1"
    return f"a AS ({side('orders')}), b AS ({side('other')}), u AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, a.n AS n_source, b.n AS n_target, CAST(a.total AS DOUBLE) AS h_source, CAST(b.total AS DOUBLE) AS h_target FROM a FULL OUTER JOIN b ON a.bucket = b.bucket WHERE a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total)"


@query(f"WITH other AS ({_OTHER}), {_buckets_sql('CAST(o_orderkey AS VARCHAR)')} SELECT * FROM u")
def key_hash_buckets(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    sides = [profile.hash_buckets(x, F.col("o_orderkey").cast("string"), 1024) for x in (a, b)]
    return profile.unequal_buckets(*sides).withColumns({c: F.col(c).cast("double") for c in ("h_source", "h_target")})


@query(f"WITH other AS ({_OTHER}), {_buckets_sql('CAST(o_orderkey AS VARCHAR)')} SELECT o_orderkey FROM orders WHERE {H.format('CAST(o_orderkey AS VARCHAR)')} % 1024 IN (SELECT bucket FROM u) AND o_orderkey NOT IN (SELECT o_orderkey FROM other)")
def key_bucket_keys(spark, sf_dir):
    """Keys that are missing in unequal buckets."""
    a, b = _sides(spark, sf_dir)
    h = F.pmod(hash32(F.col("o_orderkey").cast("string")), F.lit(1024))
    bad = profile.unequal_buckets(*(profile.hash_buckets(x, F.col("o_orderkey").cast("string"), 1024) for x in (a, b))).select("bucket")
    return a.withColumn("bucket", h).join(bad, "bucket", "left_semi").join(b.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


@query(f"WITH other AS ({_OTHER}) SELECT 'source' AS side, count(*) AS n, CAST(sum({H.format(_TEXT)}) AS DOUBLE) AS total FROM orders UNION ALL SELECT 'target', count(*), CAST(sum({H.format(_TEXT)}) AS DOUBLE) FROM other")
def post_data_hash(spark, sf_dir):
    parts = [validate.data_hash(df, ["o_orderkey", "o_orderstatus", "o_orderdate"]).select(F.lit(side).alias("side"), "n", F.col("total").cast("double").alias("total")) for side, df in zip(("source", "target"), _sides(spark, sf_dir), strict=True)]
    return parts[0].unionByName(parts[1])


@query(f"WITH other AS ({_OTHER}), a AS (SELECT o_orderkey // 1000 AS key_range, count(*) AS n, sum({H.format(_TEXT)}) AS total FROM orders GROUP BY 1), b AS (SELECT o_orderkey // 1000 AS key_range, count(*) AS n, sum({H.format(_TEXT)}) AS total FROM other GROUP BY 1) SELECT a.key_range, a.n AS n_source, b.n AS n_target FROM a JOIN b ON a.key_range = b.key_range WHERE a.total <> b.total OR a.n <> b.n")
def range_hash_compare(spark, sf_dir):
    """Key ranges whose rows differ: found three levels down, from ranges 256 times as wide."""
    a, b = _sides(spark, sf_dir)
    last = hashtree.descend(a, b, ["o_orderkey"], leaf=1000, levels=3)[-1]
    return last.where("level = 3 AND n_source > 0 AND n_target > 0").select(F.col("node").alias("key_range"), "n_source", "n_target")


def _level_sql(level: int, width: int) -> str:
    side = lambda t: f"SELECT o_orderkey // {width} AS node, count(*) AS n, sum({H.format(_TEXT)}) AS total FROM {t} GROUP BY 1"
    return f"SELECT {level} AS level, CAST({width} AS BIGINT) AS width, coalesce(a.node, b.node) AS node, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_target FROM ({side('orders')}) a FULL OUTER JOIN ({side('other')}) b ON a.node = b.node WHERE a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total"


@query(f"WITH other AS ({_OTHER}) " + " UNION ALL ".join(_level_sql(k + 1, 50 * 16 ** (3 - k)) for k in range(4)))
def hash_tree_nodes(spark, sf_dir):
    """All nodes of a tree of range hashes that differ, over four levels: below an equal node nothing is read."""
    a, b = _sides(spark, sf_dir)
    return reduce(DataFrame.unionByName, hashtree.descend(a, b, ["o_orderkey"], leaf=50, levels=4))


@query(f"WITH other AS ({_OTHER}) SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 997 = 0 OR (o_orderkey % 2003 = 0 AND o_orderstatus <> 'X')) AS n_merged FROM orders UNION ALL SELECT -1 - o_orderkey, 'only here', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 997 = 0 OR (o_orderkey % 2003 = 0 AND o_orderstatus <> 'X')) FROM orders WHERE o_orderkey % 499 = 0")
def hash_tree_repair(spark, sf_dir):
    """A target that lacks some orders and has others otherwise, after only those were merged; rows that the source
    doesn't have stay."""
    a, b = _sides(spark, sf_dir)
    more = a.where("o_orderkey % 499 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("only here").alias("o_orderstatus"), "o_orderdate")
    table = SnapshotTable(spark, new_root(spark, "orders"), ["o_orderkey"])
    table.commit(b.unionByName(more))
    hashtree.repair(table, a, leaf=256)
    merged = sum(f["rows"] for f in table.files() if f["columns"] is not None)
    return table.read().select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.lit(merged).cast("bigint").alias("n_merged"))


@query(f"WITH other AS ({_OTHER}) SELECT a.o_orderkey, b.o_orderstatus AS held, a.o_orderstatus AS wanted FROM orders a JOIN other b ON a.o_orderkey = b.o_orderkey WHERE md5({_TEXT.replace('o_order', 'a.o_order')}) <> md5({_TEXT.replace('o_order', 'b.o_order')})")
def row_hash_diff(spark, sf_dir):
    """Same key, other content: rows to merge again."""
    a, b = _sides(spark, sf_dir)
    left = a.select("o_orderkey", F.col("o_orderstatus").alias("wanted"), F.md5(_hashed(a).cast("binary")).alias("x"))
    right = b.select("o_orderkey", F.col("o_orderstatus").alias("held"), F.md5(_hashed(b).cast("binary")).alias("y"))
    return left.join(right, "o_orderkey").where("x <> y").select("o_orderkey", "held", "wanted")


def _merged_sql(c: str, text: bool) -> str:
    size = f"CAST(max(length({c})) AS INTEGER)" if text else "CAST(NULL AS INTEGER)"
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {size} AS max_chars, true AS distinct_near, true AS median_near, 2 AS files_anew FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice, o_orderpriority FROM orders)"


@query(" UNION ALL ".join(_merged_sql(c, c == "o_orderpriority") for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")))
def merged_profile(spark, sf_dir):
    """A table's profile from sketches of its files. After two more files only those are read; counts are exact, and
    estimates are near the exact values (5 % of distinct values, 3 % of ranks)."""
    rows = frame(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice", "o_orderpriority")
    table = SnapshotTable(spark, new_root(spark, "orders"), ["o_orderkey"], buckets=4)
    table.commit(rows.where("o_orderkey % 3 = 0"))
    fileprofile.update(table)
    for k in (1, 2):
        table.insert(rows.where(f"o_orderkey % 3 = {k}").coalesce(1))
    anew = {f["seq"] for f in table.files()} - {1}
    found = fileprofile.merged(table)
    distinct = profile.column_profile(rows).select("column_name").join(cat.stats(rows, "orders", exact=True), "column_name").select("column_name", F.col("n_distinct").alias("exact"))
    ranks = rows.agg(*(F.array(F.percentile_approx(c, 0.47, 10000), F.percentile_approx(c, 0.53, 10000)).alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")))
    bounds = ranks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c)[0].cast("double").alias("low"), F.col(c)[1].cast("double").alias("high")) for c in ranks.columns))).alias("b")).select("b.*")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))
    middle = F.col("median").isNull() | F.col("median").between(F.col("low"), F.col("high"))
    return found.join(distinct, "column_name").join(bounds, "column_name", "left").select("column_name", "n_rows", "n_null", "max_chars", near.alias("distinct_near"), middle.alias("median_near"), F.lit(len(anew)).alias("files_anew"))


@query("SELECT x.percent, true AS about, true AS few_files, true AS own_rows FROM (VALUES (5), (20), (60)) x(percent), (SELECT count(*) AS n FROM lineitem) l WHERE l.n > 0")
def sample_blocks(spark, sf_dir):
    """Whole files of a table as samples of 5, 20 and 60 percent: about so many rows, of no more files than it takes,
    each as the table has it."""
    rows = frame(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_shipdate").dropDuplicates(["id"])
    table = SnapshotTable(spark, new_root(spark, "lines"), ["id"], buckets=64, bucket_bytes=1 << 30)
    table.commit(rows.limit(0))
    for k in range(8):  # arrivals of their own files
        table.insert(rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(8)) == k))
    everything, files, out = table.read(), table.files(), []
    n = sum(f["rows"] for f in files)
    least = max(f["rows"] for f in files)
    for percent in (5, 20, 60):
        some = table.sample(percent)
        m, own = some.count(), some.join(everything, some.columns, "left_semi").count()
        opened = len(some.inputFiles())
        out.append((percent, percent / 100 * n <= m <= percent / 100 * n + least, opened <= len(files) * percent / 100 + 2, own == m))
    return spark.createDataFrame(out, "percent int, about boolean, few_files boolean, own_rows boolean")


# -- reconciliation ---------------------------------------------------------------------------
DIFF = """s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0),
    d AS (SELECT coalesce(s.k, t.member_id) AS k, CASE WHEN s.k IS NULL AND t.del_yn = 'N' THEN 'mark' WHEN s.k IS NOT NULL AND t.del_yn = 'Y' THEN 'unmark'
          WHEN s.k IS NULL AND t.del_yn = 'Y' THEN 'already' WHEN t.member_id IS NULL THEN 'source_only' END AS action
          FROM s FULL OUTER JOIN tgt t ON s.k = t.member_id)"""


def _reconciled(spark, sf_dir):
    m = members(spark, sf_dir)
    source = m.source.where("c_custkey % 7 <> 0").select(normalised_key([(F.col("c_custkey"), "bigint")]).alias("k"))
    key = normalised_key([(F.col("member_id"), "bigint")])
    target = m.target.select(key.alias("k"), (F.col("del_yn") == "Y").alias("marked"), F.struct("member_id").alias("key"))
    return m, source, target, key, reconcile.key_diff(source, target)


@query(f"{WITH}, {DIFF} SELECT CAST(k AS VARCHAR) AS k, action FROM d WHERE action IS NOT NULL")
def key_diff(spark, sf_dir):
    return _reconciled(spark, sf_dir)[4].select("k", "action")


@query(f"{WITH}, {DIFF} SELECT t.member_id, CASE d.action WHEN 'mark' THEN 'Y' WHEN 'unmark' THEN 'N' ELSE t.del_yn END AS del_yn FROM tgt t LEFT JOIN d ON d.k = t.member_id")
def mark_deleted(spark, sf_dir):
    m, _, _, _, diff = _reconciled(spark, sf_dir)
    table = m.table()
    reconcile.mark(table, diff, "del_yn")
    return table.read().select("member_id", "del_yn")


@query(f"{WITH}, {DIFF} SELECT action, count(*) AS n FROM d WHERE action IS NOT NULL GROUP BY 1")
def reconcile_mark(spark, sf_dir):
    return _reconciled(spark, sf_dir)[4].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {DIFF}, c AS (SELECT (SELECT count(*) FROM s) AS n_source, (SELECT count(*) FROM tgt WHERE del_yn = 'N') AS n_live, (SELECT count(*) FROM d WHERE action = 'mark') AS n_mark, (SELECT count(*) FROM d WHERE action = 'unmark') AS n_unmark) SELECT *, greatest(10, ceil(n_live * 0.1))::BIGINT AS allowed, n_source = 0 OR n_mark > greatest(10, ceil(n_live * 0.1)) AS blocked FROM c")
def reconcile_cap(spark, sf_dir):
    _, source, target, _, diff = _reconciled(spark, sf_dir)
    return reconcile.cap(diff, source, target)


@query(f"{WITH}, {DIFF} SELECT (SELECT count(*) FROM s) AS n_source, (SELECT count(*) FROM tgt) AS n_target, greatest((SELECT count(*) FROM tgt) - (SELECT count(*) FROM s), 0)::BIGINT AS surplus")
def reconcile_count(spark, sf_dir):
    _, source, target, _, _ = _reconciled(spark, sf_dir)
    return reconcile.surplus(source, target)


# -- after a load -----------------------------------------------------------------------------
@query(f"{WITH}, {AFTER}, {DEFECTS} SELECT member_id FROM ok WHERE member_id NOT IN (SELECT member_id FROM bad)")
def post_missing_keys(spark, sf_dir):
    m, _, bad = loaded(spark, sf_dir)
    return validate.missing_keys(m.mapped, bad, KEY, m.rejects)


@query(f"{WITH} SELECT member_id, member_name FROM m WHERE member_id NOT IN (SELECT member_id FROM rej)")
def exclude_rejects(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.mapped.join(m.rejects.select(*KEY), KEY, "left_anti").select("member_id", "member_name")


_SAMPLE = "smp AS (SELECT * FROM ok ORDER BY md5(CAST(member_id AS VARCHAR) || '|s'), member_id LIMIT 100)"


@query(f"{WITH}, {AFTER}, {DEFECTS}, {_SAMPLE} SELECT s.member_id, CASE WHEN b.member_id IS NULL THEN '(missing)' WHEN s.member_name IS DISTINCT FROM b.member_name THEN 'member_name' WHEN s.member_grade IS DISTINCT FROM b.member_grade THEN 'member_grade' WHEN s.balance IS DISTINCT FROM b.balance THEN 'balance' END AS first_diff FROM smp s LEFT JOIN bad b ON s.member_id = b.member_id")
def post_sample_compare(spark, sf_dir):
    m, _, bad = loaded(spark, sf_dir)
    return validate.compare_rows(sample_n(m.good, KEY, 100), bad, KEY, WRITTEN)


@query(f"{WITH}, {AFTER}, {DEFECTS} SELECT 'member_name' AS column_name, (SELECT count(*) FROM ok WHERE member_name IS NULL) AS n_source, (SELECT count(*) FROM bad WHERE member_name IS NULL) AS n_target UNION ALL SELECT 'balance', (SELECT count(*) FROM ok WHERE balance IS NULL), (SELECT count(*) FROM bad WHERE balance IS NULL)")
def post_null_counts(spark, sf_dir):
    m, _, bad = loaded(spark, sf_dir)
    return validate.null_counts(m.good, bad, ["member_name", "balance"])


@query(f"{WITH}, {AFTER} SELECT (SELECT count(*) FROM m) AS n_source, (SELECT count(*) FROM ok) AS n_written, (SELECT count(*) FROM rej) AS n_rejected, (SELECT count(*) FROM m) = (SELECT count(*) FROM ok) + (SELECT count(*) FROM rej) AS equal")
def post_row_count(spark, sf_dir):
    m = members(spark, sf_dir)
    n = F.count(F.lit(1))
    row = m.mapped.agg(n.alias("n_source")).crossJoin(m.good.agg(n.alias("n_written"))).crossJoin(m.rejects.agg(n.alias("n_rejected")))  # one row each
    return row.withColumn("equal", F.expr("n_source = n_written + n_rejected"))


@query(f"{WITH}, {AFTER}, c AS (SELECT (SELECT count(*) FROM m) AS n_source, (SELECT count(*) FROM merged WHERE del_yn IS NULL OR del_yn <> 'Y') AS n_target) SELECT *, CASE WHEN n_source = n_target THEN 'PASS' ELSE 'WARN' END AS level FROM c")
def post_row_count_incremental(spark, sf_dir):
    m, merged, _ = loaded(spark, sf_dir)
    live = merged.where("del_yn IS NULL OR del_yn <> 'Y'")
    row = m.mapped.agg(F.count(F.lit(1)).alias("n_source")).crossJoin(live.agg(F.count(F.lit(1)).alias("n_target")))
    return row.withColumn("level", F.when(F.col("n_source") == F.col("n_target"), "PASS").otherwise("WARN"))


@query(f"""{WITH}, {AFTER}, {DEFECTS}, {_SAMPLE},
    f(check_name, target, bad_level, n) AS (
    SELECT 'P01_row_count', '*', 'ERROR', abs((SELECT count(*) FROM ok) - (SELECT count(*) FROM bad))
    UNION ALL SELECT 'P02_missing_keys', 'member_id', 'ERROR', (SELECT count(*) FROM ok WHERE member_id NOT IN (SELECT member_id FROM bad WHERE member_id IS NOT NULL))
    UNION ALL SELECT 'P03_duplicate_keys', 'member_id', 'ERROR', (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY member_id HAVING count(*) > 1))
    UNION ALL SELECT 'P04_sample', 'member_name,member_grade,balance', 'ERROR', (SELECT count(*) FROM smp s LEFT JOIN bad b ON s.member_id = b.member_id WHERE b.member_id IS NULL OR s.member_name IS DISTINCT FROM b.member_name OR s.member_grade IS DISTINCT FROM b.member_grade OR s.balance IS DISTINCT FROM b.balance)
    UNION ALL SELECT 'P05_checksum', 'member_name,member_grade,balance', 'ERROR', 1
    UNION ALL SELECT 'P06_null_counts', 'member_name,balance', 'WARN', (SELECT count(*) FROM (SELECT 1 WHERE (SELECT count(*) FROM bad WHERE member_name IS NULL) <> 0 UNION ALL SELECT 1 WHERE (SELECT count(*) FROM bad WHERE balance IS NULL) <> 0)))
    SELECT check_name, target, CASE WHEN n > 0 THEN bad_level ELSE 'PASS' END AS level, n::BIGINT AS n FROM f""")
def post_suite(spark, sf_dir):
    m, _, bad = loaded(spark, sf_dir)
    return validate.post_suite(m.mapped, bad, m.rejects, KEY, WRITTEN, sample_n(m.good, KEY, 100), ["member_name", "balance"])


# -- before a load ----------------------------------------------------------------------------
@query(f"{WITH} SELECT 'C08_not_null' AS check_name, 'member_name' AS target, CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'PASS' END AS level, count(*) AS n FROM m WHERE member_name IS NULL UNION ALL SELECT 'C08_not_null', 'member_id', CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'PASS' END, count(*) FROM m WHERE member_id IS NULL")
def pre_not_null(spark, sf_dir):
    m = members(spark, sf_dir)
    return validate.pre_not_null(m.mapped, ["member_name", "member_id"])


@query("SELECT 'C09_duplicate_keys' AS check_name, 'l_orderkey,l_linenumber' AS target, 'ERROR' AS level, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n UNION ALL SELECT 'C10_existing_keys', 'l_orderkey,l_linenumber', 'WARN', (SELECT count(*) FROM lineitem WHERE l_orderkey % 10 = 0)")
def pre_dup(spark, sf_dir):
    lines = frame(spark, sf_dir, "lineitem")
    return validate.pre_keys(lines, lines.where("l_orderkey % 10 = 0"), ["l_orderkey", "l_linenumber"], insert_only=True)


@query("SELECT 'C11_orphans' AS check_name, 'orders.customer' AS target, CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'PASS' END AS level, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0) UNION ALL SELECT 'C11_orphans', 'customer.nation', CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'PASS' END, count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def pre_fk(spark, sf_dir):
    customer, nation = frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "nation")
    return validate.pre_foreign_keys(spark, [
        ("orders.customer", frame(spark, sf_dir, "orders"), ["o_custkey"], customer.where("c_custkey % 13 <> 0"), ["c_custkey"]),
        ("customer.nation", customer, ["c_nationkey"], nation, ["n_nationkey"]),
    ])


_ORDER_BYTES = "28 * count(*) + sum(octet_length(encode(o_orderstatus))) + sum(octet_length(encode(o_orderpriority)))"


@query(f"SELECT 'C12_volume' AS check_name, 'orders' AS target, CASE WHEN n > 1000000 THEN 'ERROR' WHEN n > 700000 THEN 'WARN' ELSE 'PASS' END AS level, n FROM (SELECT ceil(({_ORDER_BYTES}) * 1.35)::BIGINT AS n FROM orders)")
def pre_volume(spark, sf_dir):
    """Expected bytes, from measured row sizes and a third more, against a capacity of 1 MB."""
    rows = frame(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return validate.pre_volume(profile.volume(rows), "orders", 1_000_000)


@query(f"""{WITH}, f(column_name, max_chars, max_len, int_digits, max_digits) AS (
    SELECT 'member_name', (SELECT max(length(member_name)) FROM m), 30, NULL, NULL UNION ALL SELECT 'member_grade', (SELECT max(length(member_grade)) FROM m), NULL, NULL, NULL
    UNION ALL SELECT 'balance', NULL, NULL, (SELECT max(length(CAST(floor(abs(balance))::BIGINT AS VARCHAR))) FROM m), 4)
    SELECT column_name, max_chars::BIGINT AS max_chars, int_digits::BIGINT AS int_digits, CASE WHEN max_chars > max_len OR int_digits > max_digits THEN 'ERROR' WHEN coalesce(max_len, max_digits) IS NULL THEN 'INFO' ELSE 'PASS' END AS level,
    CASE WHEN max_chars > max_len THEN 'truncation' WHEN int_digits > max_digits THEN 'overflow' WHEN coalesce(max_len, max_digits) IS NULL THEN 'unmeasured' ELSE 'fits' END AS kind FROM f""")
def pre_format(spark, sf_dir):
    """Measured lengths and digits of the mapped columns against the target's, with the verdict."""
    m = members(spark, sf_dir)
    spec = {c.target: c for c in MEMBER.columns}
    prof = profile.column_profile(m.mapped, ["member_name", "member_grade", "balance"])
    limits = spark.createDataFrame([(n, "string" if c.type == "string" else "decimal", c.max_len, c.max_digits) for n, c in spec.items() if n in ("member_name", "member_grade", "balance")], "column_name string, source_type string, target_len int, target_digits int")
    digits = F.char_length(F.floor("max_abs").cast("decimal(38,0)").cast("string")).cast("bigint")
    pairs = prof.withColumn("int_digits", digits).join(F.broadcast(limits), "column_name").withColumn("target_type", F.col("source_type"))
    return cat.compatibility(pairs).select("column_name", "max_chars", "int_digits", "level", "kind")


# -- catalog ----------------------------------------------------------------------------------
_CAT = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}
#: Keys of the given tables, as they are declared: the second of lineitem does not hold on synthetic rows.
KEYS: list[cat.Key] = [
    ("customer", ["c_custkey"], None, None), ("nation", ["n_nationkey"], None, None), ("orders", ["o_orderkey"], None, None), ("lineitem", ["l_orderkey", "l_linenumber"], None, None),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
]
_PK = {"c_custkey": 1, "n_nationkey": 1}
_FK = {"c_nationkey": "nation.n_nationkey"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {k + 1} AS ordinal, {_PK.get(c, 'NULL')} AS pk_position, {repr(_FK[c]) if c in _FK else 'NULL'} AS refers_to, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in _CAT.items() for k, c in enumerate(cs)))
def catalog_columns(spark, sf_dir):
    frames = {t: frame(spark, sf_dir, t) for t in _CAT}
    stats = validate.all_of(*(cat.stats(df, t, exact=True) for t, df in frames.items()))
    columns = cat.with_keys(spark, cat.catalog(spark, frames), KEYS)
    return cat.with_stats(columns, stats).select("table_name", "column_name", "ordinal", "pk_position", "refers_to", "n_rows", "n_null", "n_distinct")


def _held_sql(t, cs, parent, pcs):
    c = ", ".join(cs)
    bad = f"SELECT 1 FROM {t} GROUP BY {c} HAVING count(*) > 1" if parent is None else f"SELECT 1 FROM {t} WHERE {cs[0]} IS NOT NULL AND {cs[0]} NOT IN (SELECT {pcs[0]} FROM {parent})"
    return f"SELECT '{t}' AS table_name, '{'FK' if parent else 'PK'}' AS kind, '{','.join(cs)}' AS columns, {repr(parent) if parent else 'NULL'} AS refers_to, (SELECT count(*) FROM ({bad})) AS n_bad"


@query(" UNION ALL ".join(_held_sql(*k) for k in KEYS))
def catalog_keys(spark, sf_dir):
    """Declared keys held against the rows."""
    return cat.held_keys({t: frame(spark, sf_dir, t) for t in ("customer", "nation", "orders", "lineitem")}, KEYS)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_VIEWS = {"order_totals": "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", "late_lines": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R'"}


@query(" UNION ALL ".join([f"SELECT 'TABLE' AS kind, '{t}' AS name, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, (SELECT count(*) FROM {t}) AS n" for t in _TABLES] + [f"SELECT 'VIEW', '{v}', {2 if v == 'order_totals' else 3}, (SELECT count(*) FROM ({q}))" for v, q in _VIEWS.items()]))
def catalog_union(spark, sf_dir):
    """Tables and views of one catalog, with their numbers of columns and rows."""
    tables(spark, sf_dir, *_TABLES)
    held, seen = {t: spark.table(t) for t in _TABLES}, {v: spark.sql(q) for v, q in _VIEWS.items()}
    columns = cat.catalog(spark, held).unionByName(cat.catalog(spark, seen, "VIEW"))
    counts = validate.all_of(*(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t, df in (held | seen).items()))
    return columns.groupBy("kind", F.col("table_name").alias("name")).agg(F.count(F.lit(1)).alias("n_columns")).join(counts, "name")


#: How the given tables are called in a source and in a target; two have no partner.
_NAMES = [
    ("orders", "SRC_ORDERS", "TB_ORDERS", 1), ("lineitem", "SRC_LINEITEM", "TBL_LINEITEM", 1), ("customer", "T_CUSTOMER", "MEMBER_TB", 2), ("part", "MST_PART", "PART", 1),
    ("supplier", "TBL_SUPPLIER", "TB_SUPPLIER_T", 1), ("nation", "SRC_NATION", "NATION_T", 1), ("region", "SRC_REGION", "TB_AREA", None), ("events", "SRC_EVENTS", "TB_EVENT_LOG", None),
]


@query(" UNION ALL ".join(f"SELECT '{s}' AS source_table, '{t}' AS target_table, {r} AS rank, count(*) AS n_rows FROM {own}" for own, s, t, r in _NAMES if r))
def auto_match_tables(spark, sf_dir):
    """Tables of a source and a target catalog matched by name, with the rows to move."""
    frames = {own: frame(spark, sf_dir, own) for own, *_ in _NAMES}
    source = cat.catalog(spark, {s: frames[own] for own, s, _, _ in _NAMES}).select(F.col("table_name").alias("source_table")).distinct()
    target = cat.catalog(spark, {t: frames[own] for own, _, t, _ in _NAMES}).select(F.col("table_name").alias("target_table")).distinct()
    words = spark.createDataFrame([("CUSTOMER", "MEMBER"), ("EVENTS", "JOURNAL")], "word string, means string")
    counts = validate.all_of(*(frames[own].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(s).alias("source_table"), "n_rows") for own, s, _, _ in _NAMES))
    return cat.match_tables(source, target, words).join(counts, "source_table")


_MAP_SRC = """SELECT o_custkey AS BALANCE, o_orderstatus AS STATE_CD, o_orderpriority AS CUST_NM, CASE WHEN o_totalprice > 100000 THEN 'Y' END AS BIG_FLAG,
    CAST(o_orderdate AS DATE) AS REG_DT, CAST(o_orderdate AS DATE) AS DUE_DT, CAST(o_orderkey AS STRING) AS PHONE, o_orderkey AS NOWHERE FROM orders"""
_MAP_TGT = "SELECT CAST(0 AS BIGINT) AS BALANCE, '' AS STATE_CODE, '' AS CUST_NAME, '' AS BIG_YN, TIMESTAMP '2024-01-01' AS REG_AT, DATE '2024-01-01' AS DUE_DATE, '' AS MOBILE_NO, '' AS ELSEWHERE FROM orders LIMIT 1"
_MAPPED = [
    ("BALANCE", "BALANCE", 1, "BALANCE"), ("STATE_CD", "STATE_CODE", 3, "STATE_CD"), ("CUST_NM", "CUST_NAME", 3, "TRIM(CUST_NM)"), ("BIG_FLAG", "BIG_YN", 3, "CASE WHEN BIG_FLAG IN ('Y', '1') THEN 'Y' ELSE 'N' END"),
    ("REG_DT", "REG_AT", 3, "CAST(REG_DT AS TIMESTAMP)"), ("DUE_DT", "DUE_DATE", 3, "DUE_DT"), ("PHONE", "MOBILE_NO", 2, "regexp_replace(PHONE, '[^0-9]', '')"),
]


@query(f"WITH s AS ({_MAP_SRC}) " + " UNION ALL ".join("SELECT '{0}' AS source_column, '{1}' AS target_column, {2} AS rank, '{3}' AS expression, count(*) AS n_rows, count(*) FILTER ({0} IS NULL) AS n_null FROM s".format(a, b, r, e.replace("'", "''")) for a, b, r, e in _MAPPED))
def auto_map_columns(spark, sf_dir):
    """Columns of two catalogs mapped by name, with what the source holds in them."""
    tables(spark, sf_dir, "orders")
    source, target = spark.sql(_MAP_SRC), spark.sql(_MAP_TGT)
    words = spark.createDataFrame([("PHONE", "MOBILE_NO")], "word string, means string")
    found = cat.map_columns(cat.catalog(spark, {"s": source}), cat.catalog(spark, {"t": target}), words)
    held = cat.stats(source, "s").select(F.col("column_name").alias("source_column"), "n_rows", "n_null")
    return found.join(held, "source_column")


#: A column of a given table, its declared type and a target's; the limits are the target's.
_PAIRS = [
    ("orders", "o_orderpriority", "varchar(15)", "varchar(10)", 10, None), ("orders", "o_orderstatus", "char(1)", "varchar(1)", 1, None), ("orders", "o_totalprice", "decimal(15,2)", "decimal(6,2)", None, 4),
    ("orders", "o_totalprice", "decimal(15,2)", "decimal(13,2)", None, 11), ("orders", "o_totalprice", "decimal(15,2)", "varchar(10)", 10, None), ("orders", "o_orderkey", "bigint", "varchar(30)", 30, None),
    ("orders", "o_orderdate", "timestamp", "date", None, None), ("orders", "o_orderdate", "timestamp", "varchar(20)", 20, None), ("orders", "o_orderdate", "date", "timestamp", None, None),
    ("orders", "o_orderpriority", "string", "decimal(5,0)", None, 5), ("orders", "o_orderpriority", "string", "timestamp", None, None), ("documents", "text", "clob", "varchar(4000)", 4000, None),
    ("documents", "text", "clob", "clob", None, None), ("documents", "text", "clob", "nclob", None, None), ("documents", "text", "varchar(4000)", "clob", None, None), ("documents", "text", "long", "clob", None, None),
    ("documents", "text", "raw", "blob", None, None), ("documents", "text", "long raw", "blob", None, None), ("documents", "text", "blob", "clob", None, None), ("documents", "lang", "nvarchar2(2)", "nclob", None, None),
    ("documents", "source", "varchar(40)", "varchar(400)", 400, None), ("documents", "doc_id", "number(18)", "blob", None, None),
]


def _pair_sql(k, t, c, st, tt, length, digits):
    chars = f"(SELECT max(length({c})) FROM {t})" if c in ("o_orderpriority", "o_orderstatus", "text", "lang", "source") else "NULL"
    whole = f"(SELECT max(length(CAST(CAST(floor(abs({c})) AS BIGINT) AS VARCHAR))) FROM {t})" if c in ("o_totalprice", "o_orderkey", "doc_id") else "NULL"
    fixed = {
        ("decimal(15,2)", "varchar(10)"): "to_text_short", ("bigint", "varchar(30)"): "to_text", ("timestamp", "date"): "loses_fraction", ("timestamp", "varchar(20)"): "format", ("date", "timestamp"): "fits",
        ("string", "decimal(5,0)"): "parse", ("string", "timestamp"): "parse", ("clob", "varchar(4000)"): "lob_truncation", ("clob", "clob"): "fits", ("clob", "nclob"): "charset", ("varchar(4000)", "clob"): "fits",
        ("long", "clob"): "to_lob", ("raw", "blob"): "fits", ("long raw", "blob"): "to_lob", ("blob", "clob"): "unsupported", ("nvarchar2(2)", "nclob"): "fits", ("number(18)", "blob"): "unsupported",
    }.get((st, tt))
    kind = f"'{fixed}'" if fixed else f"CASE WHEN {chars} > {length} THEN 'truncation' ELSE 'fits' END" if length else f"CASE WHEN {whole} > {digits} THEN 'overflow' ELSE 'fits' END"
    return f"SELECT {k} AS pair, {chars}::BIGINT AS max_chars, {whole}::BIGINT AS int_digits, {kind} AS kind"


@query("WITH f AS (" + " UNION ALL ".join(_pair_sql(k, *p) for k, p in enumerate(_PAIRS)) + ") SELECT *, CASE WHEN kind IN ('truncation', 'overflow', 'unsupported') THEN 'ERROR' WHEN kind IN ('fits', 'to_text') THEN 'PASS' ELSE 'WARN' END AS level FROM f")
def type_compat(spark, sf_dir):
    """Declared types against a target's, with lengths and digits measured in one pass over each table."""
    named = spark.createDataFrame([(k, *p) for k, p in enumerate(_PAIRS)], "pair int, table_name string, column_name string, source_type string, target_type string, target_len int, target_digits int")
    measured = validate.all_of(*(profile.column_profile(frame(spark, sf_dir, t), sorted({c for own, c, *_ in _PAIRS if own == t})).withColumn("table_name", F.lit(t)) for t in ("orders", "documents")))
    digits = F.char_length(F.floor("max_abs").cast("decimal(38,0)").cast("string")).cast("bigint")
    pairs = F.broadcast(named).join(measured.withColumn("int_digits", digits), ["table_name", "column_name"])
    return cat.compatibility(pairs).select("pair", "max_chars", "int_digits", "kind", "level")
