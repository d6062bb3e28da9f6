"""What the operators share: words, shared folders, joins with small tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every contract here: ASCII only.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: A table with at most so many rows may be broadcast, after they have been counted.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process a temporary folder
    takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Lists that collect the tables written while a scratch() is open, innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables written inside, for sweep() once nothing reads them any more."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables."""
    jvm = spark.sparkContext._jvm
    while paths:
        p = jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim(spark: SparkSession) -> None:
    """Executors' JVMs collect their garbage and give the heap that they don't need back to the system: a heap that one step has
    grown stays otherwise, beside the Python workers of the next. A task for every core, so that none is likely left out."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()  # as many rows as cores


def remember(path: str) -> str:
    """A path that an open scratch() will list."""
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: its lineage is cut, a lost executor costs a read."""
    spark = df.sparkSession
    path = remember(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As written(), in ``n`` buckets by a column: joins on it take the rows as they lie, and only the other side is shuffled. The
    table's name is dropped from the catalog at once; its files stay."""
    spark = df.sparkSession
    path = remember(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.option("path", path).bucketBy(n, key).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_join(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table that is expected to be small: broadcast if its counted rows allow, else a shuffled join,
    whose hot keys adaptive execution splits."""
    return big.join(F.broadcast(small) if small.count() <= rows else small, on, how)


def whole(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all of them in the struct _all: no column that an operator adds can clash with the documents'."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), *names)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(seed: str, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in every engine and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
