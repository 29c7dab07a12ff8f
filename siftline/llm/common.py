"""Helpers that several operators share: word splitting in SQL, shared folders, written tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as Catalyst would inline it at each use otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; none for null and for text of white space only."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(
        F.array().cast("array<string>")
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftline-{uuid.uuid4().hex}"


#: Tables of this process that were not dropped yet.
_kept: list[DataFrame] = []


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python workers get at most so many rows at a time in the jobs run here: texts and sets are long."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with batches_of(spark, 1000):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._siftline_path = path
    _kept.append(table)
    return table


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as a table of the shared folder, dealt into buckets by a column, so that grouping by it moves nothing."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"siftline_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(spark, 1000):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    table._siftline_path, table._siftline_name = path, name
    _kept.append(table)
    return table


def dropped(table: DataFrame) -> None:
    """Deletes a table of written() or bucketed() that nothing will read again."""
    spark = table.sparkSession
    _kept[:] = [t for t in _kept if t is not table]
    if hasattr(table, "_siftline_name"):
        spark.sql(f"DROP TABLE IF EXISTS {table._siftline_name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table._siftline_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def handed_over(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the tables that were made for it are dropped."""
    before = set(map(id, _kept))
    out = written(make())
    for table in [t for t in _kept if id(t) not in before and t is not out]:
        dropped(table)
    return out


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, total: int, kept: str) -> DataFrame:
    """big joined to small (one row a key) on keys, with the rows of frequent keys dealt over several tasks.

    counts: keys and n, the rows of big that hold them; total: their sum. A key is frequent from
    max(20,000, total / 100,000) rows on, so that at most 100,000 keys are: that list is broadcast.
    kept: a column of big that tells the rows of a key apart.
    """
    most = max(20_000, total // 100_000)
    often = counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_salts"))
    often = F.broadcast(often)
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(often, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(kept), salts).cast("int")).drop("_salts")
    right = small.join(often, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a unique row number; write it before the number is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame, name: str) -> DataFrame:
    """df with a column that tells its rows apart whenever it is read: file and place of rows of files, else numbers in a written copy."""
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(name))
    except AnalysisException:  # no rows of files
        return written(numbered(df, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
