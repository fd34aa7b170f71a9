"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts have it: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        base = tempfile.mkdtemp(prefix="nocturne-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


#: Paths handed out, in order; see forget().
_paths: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _paths.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _paths[-1]


def mark() -> int:
    """A place in the order of the paths handed out, for forget()."""
    return len(_paths)


def forget(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Remove what was written since a mark, but for the table ``keep``; for use once all that is still read is in that table."""
    own = getattr(keep, "_nocturne_path", None)
    for path in _paths[since:]:
        if path != own:
            _remove(spark, path)
    _paths[since:] = [own] if own else []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._nocturne_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and no later step reads."""
    path = getattr(df, "_nocturne_path", None)
    if path:
        _remove(df.sparkSession, path)


def ranked(df: DataFrame, order: list[Column], name: str, what: str = "ranks", rest: list[Column] = ()) -> DataFrame:
    """``df``, written, with each row's place in the given order, 0 first; ``order`` and ``rest`` tell all rows apart.

    Rows are dealt by range of ``order``, which the driver samples, and a partition's places follow on the number of rows before
    it: the place doesn't depend on where the ranges are cut.  The numbers of rows are a
    row for each partition, summed in one task and joined as a small table.
    """
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order, *rest).withColumn("_at", F.monotonically_increasing_id()), what + "-places")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(F.broadcast(base), part == F.col("_part")).select(*df.columns, (F.col("_base") + place).alias(name))
    out._nocturne_path = rows._nocturne_path
    return out


def strip_blanks(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def count_words(text: Column) -> Column:
    """Number of words as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; blanks are mapped to one of them first, as a split on a single character is fast."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(out, " "), "")
