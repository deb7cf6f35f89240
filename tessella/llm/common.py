"""Helpers that the text operators share: reading, normalising, scratch tables and distributed offsets."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A key is heavy if it holds at least one row in so many; at most so many keys can be, which bounds what is broadcast.
HEAVY_ONE_IN = 1024
#: Copies of one row that a task makes at most, where others have more.
COPIES = 1 << 16
#: Rows that one bucket of :func:`running_offsets` holds on average in a large table.
BUCKET_ROWS = 4096
#: Bits of the buckets' numbers up to which one task adds up a group's bucket sums.
LEVEL_BITS = 16

_scratch: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []
_own: dict[int, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. A pure ASCII text takes Spark's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); only a local session, as in tests, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(id(spark))
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own[id(spark)] = tempfile.mkdtemp(prefix="tessella-")
    path = f"{root.rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """Like :func:`materialise`, as a table in ``buckets`` buckets by ``key``: what groups or joins it by the key need not shuffle it."""
    spark = df.sparkSession
    path = scratch_path(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    _tables.append((spark, name))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Delete the scratch tables that ``df`` reads, which nothing else may read any more."""
    spark = df.sparkSession
    used = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _scratch if e[0] is spark and any(u.endswith(e[1].rsplit("/", 1)[1]) for u in used)]:
        where = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _scratch.remove(entry)


def release() -> None:
    """Delete every scratch table that this process has written; results that read them must be written first."""
    while _tables:
        spark, name = _tables.pop()
        try:
            spark.sql(f"drop table if exists {name}")
        except Exception:  # the session may have ended
            break
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session may have ended
            return


atexit.register(release)


def row_key(id_col: str, digest: Column) -> Column:
    """A key of a row's id and a digest of its text; null ids have keys too."""
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), digest)


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (column ``_key``, each once), one row for each key, with all their columns.

    Of several rows with one key the one that a hash of its columns puts first stays, so that reruns agree.
    """
    own, number, mark = "__tessella_key", "__tessella_number", "__tessella_mark"
    plain = [F.col(f"`{c}`").cast("string") if "map" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    once = Window.partitionBy(own).orderBy(mark)
    found = docs.withColumn(own, key).withColumn(mark, F.xxhash64(*plain)).join(kept.withColumnRenamed("_key", own), own, "left_semi")
    return found.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)


def heavy_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, one_in: int = HEAVY_ONE_IN) -> DataFrame:
    """``rows`` inner-joined by ``key`` with ``table``, which has each key once and in ``count`` how many rows have it; ``count`` is dropped.

    Keys that hold at least 1/``one_in`` of ``total`` rows are broadcast and meet their rows where these are read; the
    other rows are shuffled, and no key of theirs fills a task.
    """
    heavy = F.col(count) * one_in >= F.lit(total)
    hot, cold = table.where(heavy).drop(count), table.where(~heavy).drop(count)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return many.unionByName(few)


def each_copy(rows: DataFrame, copies: str, most: int, name: str) -> DataFrame:
    """Each row as often as ``copies`` says, with its number ``name`` from 0; ``most`` is the largest of these.

    Where one row stands for more than COPIES, runs of so many are dealt out first, so that no task makes them all.
    """
    last = F.col(copies) - 1
    if most <= COPIES:
        return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    runs = rows.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.withColumn(name, F.explode(F.sequence("_start", F.least(F.col("_start") + COPIES - 1, last)))).drop("_start")


def running_offsets(rows: DataFrame, weight: str, group: list[str], order: list[str], name: str = "offset") -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows before each in its group, in an order that a hash of ``order`` fixes.

    No group meets in one task: a group is cut into buckets by its hash, each bucket's sum is aggregated
    (partially before the shuffle), the bucket sums are added up (in two levels where they are many), and only within a bucket are rows sorted.
    ``rows`` holds each combination of ``group`` and ``order`` once. The result depends on the rows' contents alone.
    """
    n = rows.count()
    bits = max(8, (max(n, 1) // BUCKET_ROWS).bit_length())
    keyed = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits))
    sums = keyed.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = lambda by, order: F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if bits > LEVEL_BITS:
        # Buckets too many for one task: they meet by the first bits of their numbers, whose sums in turn do.
        sums = sums.withColumn("_top", F.shiftrightunsigned("_bucket", bits - (bits + 1) // 2)).withColumn("_own", before([*group, "_top"], "_bucket"))
        tops = sums.groupBy(*group, "_top").agg(F.sum("_sum").alias("_sum"))
        tops = tops.select(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(group)], F.col("_top").alias("_t"), before(group, "_top").alias("_above"))
        same = F.col("_top") == F.col("_t")
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_t{i}"))
        sums = sums.join(tops, same).withColumn("_base", F.col("_own") + F.col("_above"))
    else:
        sums = sums.withColumn("_base", before(group, "_bucket"))
    base = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), "_base")
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(base, on).withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_h", "_bucket", "_b", "_base", "_local", *[f"_g{i}" for i in range(len(group))])
