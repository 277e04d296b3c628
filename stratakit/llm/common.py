"""Small helpers that the corpus operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: A word, everywhere in this subpackage: a run without ASCII white space. ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, a temporary one serves a local master (tests); a cluster's executors could not
    read it, so there it is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratakit-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are computed once and survive the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Write once as Parquet below the shared folder and read again; the folder, for ``forget``."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stratakit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Write once as Parquet below the shared folder and read again; for stages that hand over whole tables."""
    return stored_at(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``stored_at`` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """``df``, after bounding the bytes of an Arrow batch in its session: long texts then need no more memory than short ones.

    The limit is on bytes, so it drops nothing; a limit that is lower already stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)([bkmg]?)b?", conf.get(key, "64m").lower())
    if held and int(held[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[held[2]] > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def planned_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the input's size, without a job; it scales bucket counts, never results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets_for(df: DataFrame, bytes_each: int, least: int = 16) -> int:
    return max(least, min(1 << 20, math.ceil(planned_bytes(df) / bytes_each)))


def numbered(df: DataFrame, group: list[str], order: list[Column], spread: Column, out: str, buckets: int) -> DataFrame:
    """Number the rows of every group without gaps from 0, with no task that holds a whole group (see ``running``)."""
    return running(df, group, order, spread, F.lit(1), out, buckets)


def running(df: DataFrame, group: list[str], order: list[Column], spread: Column, weight: Column, out: str, buckets: int) -> DataFrame:
    """The sum of ``weight`` over all rows of a group that come before a row, with no task that holds a whole group.

    ``spread`` must be a function of the row that deals rows evenly (a hash); rows are ordered by
    (bucket of ``spread``, ``order``). Two shuffles: sums per bucket, then a window inside a bucket. Sums of the
    buckets before one are taken in two levels, so that many buckets of one group are no single task's either.
    Rows that tie in ``order`` come in any order. Null is a group like any other.
    """
    dealt = df.withColumn("__b", F.pmod(spread, F.lit(buckets)).cast("int")).withColumn("__w", weight.cast("long"))
    wide = max(1, math.isqrt(buckets))
    upper = (F.col("__b") / wide).cast("int")
    sums = dealt.groupBy(*group, "__b").agg(F.sum("__w").alias("__n")).withColumn("__u", upper)
    before = lambda *by: Window.partitionBy(*(by or (F.lit(0),))).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(*group, "__u").agg(F.sum("__n").alias("__m"))
    tops = tops.select(*[F.col(g).alias(f"__t{i}") for i, g in enumerate(group)], F.col("__u").alias("__uu"), F.coalesce(F.sum("__m").over(before(*group).orderBy("__u")), F.lit(0)).alias("__above"))
    starts = sums.withColumn("__low", F.coalesce(F.sum("__n").over(before(*group, "__u").orderBy("__b")), F.lit(0)))
    starts = starts.join(tops, _alike([F.col(g) for g in group], "__t") & (F.col("__u") == F.col("__uu")))
    starts = starts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__bb"), (F.col("__low") + F.col("__above")).alias("__start"))
    rows = dealt.withColumn("__r", F.coalesce(F.sum("__w").over(before(*group, "__b").orderBy(*order)), F.lit(0)))
    joined = rows.join(starts, _alike([rows[g] for g in group], "__g") & (rows["__b"] == starts["__bb"]))
    return joined.withColumn(out, (F.col("__start") + F.col("__r")).cast("long")).select(*df.columns, out)


def _alike(columns: list[Column], prefix: str) -> Column:
    """Every column equals the one of its place, null equal to null."""
    return reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(columns)], F.lit(True))


def sample_rows(df: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """One row for each of at most ``most`` keys, those with the smallest hash; the only rows that models are fitted on.

    Of rows that share a key, the one with the smallest hash of ``columns`` stands, so reruns agree. The first pass
    reads ``key`` alone; ``columns`` are read for the chosen rows only. A null key is never chosen.
    """
    chosen = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most)
    kind = dict(df.dtypes)[key]
    return rows_of_keys(df, key, columns, df.sparkSession.createDataFrame([(r[0],) for r in chosen.collect()], f"__k {kind}"))


def rows_of_keys(df: DataFrame, key: str, columns: list[str], keys: DataFrame) -> DataFrame:
    """(key, columns), one row for each key in ``keys`` (__k, ...), a bounded table; its other columns follow."""
    rows = df.join(F.broadcast(keys), F.col(key) == F.col("__k")).groupBy(*keys.columns)
    one = rows.agg(F.min(F.struct(F.xxhash64(*columns), *columns)).alias("__row"))
    return one.select(F.col("__k").alias(key), *[F.col(f"__row.{c}").alias(c) for c in columns], *keys.columns[1:])


def in_workers(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on each row (a tuple of Python values) gives rows of ``schema``; for the bounded samples of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in work(*row)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], shape)

    empty = df.sparkSession.createDataFrame([], schema)
    names, shape = empty.columns, to_arrow_schema(empty.schema)
    return lean(df).mapInArrow(run, schema)


def with_class(rows: DataFrame, classes: DataFrame, on: list[str], size: str, total: int, take: list[str]) -> DataFrame:
    """``rows`` with the columns ``take`` of their class, null where there is none; null keys have none.

    ``classes`` holds one row for each combination of ``on`` and the class's number of rows, ``size``. A class that
    holds over 1/HOT of all ``total`` rows (there are fewer than HOT of them) is met by broadcast, so that its rows
    stay where they are; the others meet by an ordinary join.
    """
    named = classes.select(*[F.col(c).alias(f"__on{k}") for k, c in enumerate(on)], *[F.col(c).alias(f"__take{k}") for k, c in enumerate(take)], (F.col(size) * HOT > total).alias("__hot"))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__on{k}") for k, c in enumerate(on)])
    places = [f"__take{k}" for k in range(len(take))]
    first = rows.join(F.broadcast(named.where("__hot")), same, "left").drop(*[f"__on{k}" for k in range(len(on))])
    met = first.where("__hot")
    rest = first.where("__hot is null").select(*rows.columns).join(named.where("not __hot"), same, "left")
    columns = [*rows.columns, *[F.col(p).alias(c) for p, c in zip(places, take, strict=True)]]
    return met.select(*columns).union(rest.select(*columns))


def kept_rows(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component in (doc_id, component_id), one for each; null doc_ids stay.

    Of rows that share a doc_id, the one whose text has the smallest hash stays; of equal texts, the one whose other
    columns have; rows that are equal in all are alike. A doc_id with over 1/HOT of all rows is settled before its
    rows travel.
    """
    ids = checkpointed(components.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")))
    total = ids.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(ids.where(F.col("__n") * HOT > total).select(F.col("doc_id").alias("__hot")))  # fewer than HOT
    rest = ids.where(F.col("__n") * HOT <= total).select("doc_id")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(*plain))).alias("__row")
    key = F.col("doc_id").cast("long")
    common = docs.join(hot, key == F.col("__hot"), "left_semi").groupBy(key.alias("__id")).agg(first)
    single = docs.join(hot, key == F.col("__hot"), "left_anti").withColumn("__id", key).join(rest.withColumnRenamed("doc_id", "__id"), "__id", "left_semi").groupBy("__id").agg(first)
    return common.union(single).select(*[F.col(f"__row.{c}").alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


#: A class with over 1/HOT of all rows is hot.
HOT = 1000
