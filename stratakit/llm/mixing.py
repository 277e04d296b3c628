"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakit.llm.common import WORD, buckets_for, checkpointed, numbered, running, stored, with_class


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words; null text: 0."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def ordered_index(df: DataFrame, order: list, out: str) -> DataFrame:
    """Rank from 0 over the whole table by range partitions: no task sees more than its range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    # a row for each partition
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return ranked.join(starts, "__p").withColumn(out, F.col("__start") + F.col("__r") - 1).select(*df.columns, out)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, n): ``share`` of all words dealt by weight, none above ``most`` times its source.

    n is the source's number of rows. Sources take the weights in turn, by code point, null last. Each round fixes the sources that the water
    level lifts over their cap and deals the rest of the words to the others; three sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = ordered_index(totals, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    cap = F.col("source_size") * F.lit(float(most))
    sources = checkpointed(ranked.select("source", "source_size", "n", weight.alias("weight"), cap.alias("cap")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        n, full, open_weight = sources.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == held or not open_weight:
            break
        held, level = n, (share * total - (full or 0.0)) / open_weight
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    if not open_weight:
        target = F.col("cap")
    return sources.select("source", "source_size", target.alias("target"), "n")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 1000) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part, taken): how often the mix takes each row of ``docs``.

    A source's target is met by whole repetitions of all its documents and one more of a seeded part: in the
    order of md5(seed, doc_id), documents are taken whole until the target is reached; the document at the border
    gives its first ``part`` words. taken = copies * size + part, so each source's sum is its rounded target.
    Running sums are taken inside key ranges of a source and, in two levels, over the ranges' sums (``running``), so
    a hot source is no hot task. Rows with one doc_id, or none, lie in one range. Null text has size 0; null sources form one source; a null doc_id is ordered as an empty string;
    repeated rows are taken one by one. Other columns are not read.
    """
    sizes = checkpointed(word_counts(docs))
    key = F.md5(F.concat(F.lit(f"mix-{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    buckets = max(1, min(1 << 28, -(-sizes.count() // bucket_rows)))
    # buckets in the order of the key: its first seven digits, scaled
    place = F.floor(F.conv(F.substring("__k", 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 28)).cast("long")
    placed = running(sizes.withColumn("__k", key), ["source"], [F.col("__k"), F.col("size")], place, F.col("size"), "__before", buckets)
    # a null source has a key too
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    targets = checkpointed(source_targets(sizes, weights, share, most)).withColumn("__s", named)
    total = targets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = with_class(placed.withColumn("__s", named), targets, ["__s"], "n", total, ["source_size", "target"])
    words = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = words - F.col("copies") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    rows = rows.withColumn("copies", copies).withColumn("part", part)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each whole repetition is a row, in any order.

    The document at a source's border counts as taken if at least half of it is. Documents of size 0 are
    no loss to any source and stay once. Columns of ``docs`` are kept.
    """
    plan = mixed(docs, **options)
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0))
    # rows that share a doc_id, source and size are alike to the plan: they share the repetitions they get
    key = lambda size: F.concat_ws(":", size, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")))
    times = checkpointed(plan.groupBy(key(F.col("size")).alias("__key")).agg(F.sum(whole).alias("__t"), F.count(F.lit(1)).alias("__n")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    total = times.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    rows = with_class(docs.withColumn("__key", key(size)), times.where("__t > 0"), ["__key"], "__n", total, ["__t", "__n"]).where("__t > 0")
    if not times.where("__n > 1 and __t % __n > 0").isEmpty():
        # some of the alike rows are taken once more: those are numbered, stored first so that ids stand still
        rows = stored(rows.withColumn("__id", F.monotonically_increasing_id()))
        odd = F.expr("__n > 1 and __t % __n > 0")
        some = numbered(rows.where(odd), ["__key"], [F.col("__id")], F.xxhash64("__id"), "__r", buckets_for(rows, 16 << 20))
        rows = rows.where(~odd).withColumn("__r", F.lit(0).cast("long")).unionByName(some)
        own = F.expr("__t div __n + if(__r < __t % __n, 1, 0)")
    else:
        own = F.expr("__t div __n")
    again = rows.withColumn("__own", own.cast("int")).where("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own"))))
    return again.select(*docs.columns)


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, 2.0 * source_size AS cap,
         row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS i,
         (1.5 * (SELECT sum(source_size) FROM totals)
            - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals
), water AS (
  SELECT arg_min(level, i) AS level FROM filled WHERE level * weight <= cap AND cap > 0
), targets AS (
  SELECT source, source_size, CAST(least(cap, weight * coalesce((SELECT level FROM water), 0)) AS DOUBLE) AS target FROM filled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix-17-' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
            + greatest(0, least(size, words - (words // source_size) * source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
