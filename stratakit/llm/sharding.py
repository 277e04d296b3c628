"""Balanced label propagation: linked documents move into their neighbours' shard, sizes stay even."""

from __future__ import annotations

import logging
from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from stratakit.llm.common import checkpointed, numbered, running, stored, with_class


def reserved(large: list[tuple], room: list[int]) -> tuple[list[tuple], list[tuple], list]:
    """(link, c, votes) of the links larger than half a shard -> (link, shard, n) of wholes and of what is over; links met.

    There are at most two of them for a shard. A link larger than a shard fills the empty shards that hold most of its
    rows as long as one can be filled. Then, the largest first, each link and each rest of a link takes the shard that
    holds most of its rows among those with room for all of it. If there is none, a rest takes the largest rooms, and
    a link that would fit an empty shard is left to the rounds. ``room`` is brought down by all that is placed.
    """
    quota, empty, rests, whole, over, met = min(room), {j for j, n in enumerate(room) if n}, [], [], [], []
    for link, c, votes in sorted(large, key=lambda x: (-x[1], x[0])):
        held, cut = dict(votes), c > quota
        while cut and (some := [j for j in empty if room[j] <= c]):
            j = max(some, key=lambda j: (room[j] == c, held.get(j, 0), -j))
            whole.append((link, j, room[j]))
            c, room[j] = c - room[j], 0
            empty.remove(j)
        if cut:
            met.append(link)
        if c:
            rests.append((link, c, held, cut))
    for link, c, held, cut in sorted(rests, key=lambda x: (-x[1], x[0])):
        if not cut and max(room) >= c:
            met.append(link)
        elif not cut:
            continue
        while c:
            j = max(range(len(room)), key=lambda j: (min(room[j], c), held.get(j, 0), -j))
            (over if cut else whole).append((link, j, min(room[j], c)))
            c, room[j] = c - min(room[j], c), room[j] - min(room[j], c)
    return whole, over, met


def propagate(links: DataFrame, shards: int, rows: int, buckets: int = 64) -> DataFrame:
    """(link, c, votes) -> (link, shard, n): how many rows of a link each shard holds.

    c is a link's number of rows, votes its rows by shard, an array of (shard, n); ``rows`` the number of all rows,
    whose even share is a shard's quota. Links larger than a shard fill shards and reserve room for what is over, and
    those larger than half a shard come next (``reserved``). In each round every other link asks for the shard that holds most of its rows among those with room
    for all of it (ties: by a hash); if none of them has, for one that has, drawn by a hash in proportion to room. A
    shard takes links in the order of a hash while its room lasts; the others ask again. The first that asks is always
    taken, so rounds go on until each link is placed or larger than any room. Then reserved room is given back and
    rounds go on: what is over of the largest links makes room for whole links. What fits nowhere as a whole even then
    is split over the room that is left, and logged. A link is one row here, however many rows it has.
    """
    room = [rows // shards + (j < rows % shards) for j in range(shards)]
    links = checkpointed(links)
    large = links.where(F.col("c") * 2 > rows // shards).collect()
    whole, over, met = reserved([(bytes(r["link"]) if isinstance(r["link"], bytearray) else r["link"], r["c"], [tuple(v) for v in r["votes"]]) for r in large], room)
    left, placed, turn, held = links.where(~F.col("link").isin(met)), [], 0, bool(over)
    while not left.isEmpty():
        turn += 1
        order = sorted(range(shards), key=lambda j: -room[j])
        rooms, sums, tie = F.array(*[F.lit(n) for n in room]), F.array(*[F.lit(n) for n in accumulate(room[j] for j in order)]), F.xxhash64("link", F.lit(turn))
        able = F.size(F.filter(rooms, lambda n: n >= F.col("c")))  # the first ones of ``order``
        drawn = F.pmod(tie, F.element_at(sums, F.greatest(able, F.lit(1))))
        other = F.when(able > 0, F.element_at(F.array(*[F.lit(j) for j in order]), F.size(F.filter(sums, lambda n: n <= drawn)) + 1))
        near = F.filter("votes", lambda v: F.element_at(rooms, v["shard"] + 1) >= F.col("c"))
        best = F.array_max(F.transform(near, lambda v: F.struct(v["n"].alias("n"), F.xxhash64("link", v["shard"]).alias("tie"), v["shard"].alias("shard"))))["shard"]
        asked = left.withColumn("goal", F.coalesce(best, other).cast("int"))
        asked = running(asked, ["goal"], [tie], tie, F.col("c"), "__at", buckets)
        asked = checkpointed(asked.withColumn("__ok", F.coalesce(F.col("__at") + F.col("c") <= F.element_at(rooms, F.col("goal") + 1), F.lit(False))))
        taken = asked.where("__ok").groupBy("goal").agg(F.sum("c")).collect()  # at most a number for each shard
        for j, n in taken:
            room[j] -= n
        if taken:
            placed.append(asked.where("__ok").select("link", F.col("goal").alias("shard"), F.col("c").alias("n")))
        left = asked.where("not __ok").select("link", "c", "votes")
        if not taken and not held:
            break
        if not taken:
            held = False
            for _, j, n in over:
                room[j] += n
    if not left.isEmpty():
        # rows at, at + 1, ... of the rest fill the room of the shards one after the other
        tie, lo, pieces = F.xxhash64("link"), 0, []
        rest = running(left, [], [tie], tie, F.col("c"), "__at", buckets)
        for j, n in enumerate(room):
            both = F.least(F.col("__at") + F.col("c"), F.lit(lo + n)) - F.greatest(F.col("__at"), F.lit(lo))
            pieces.append(F.struct(F.lit(j).alias("shard"), both.cast("long").alias("n")))
            lo += n
        rest = checkpointed(rest.select("link", F.explode(F.array(*pieces)).alias("p")).select("link", "p.shard", "p.n").where("n > 0"))
        spread = dict(tuple(r) for r in rest.groupBy("shard").agg(F.sum("n")).collect())
        room = [n - spread.get(j, 0) for j, n in enumerate(room)]
        logging.getLogger(__name__).info("%d rows are in links that fit into no shard as a whole", sum(spread.values()))
        placed.append(rest)
    if over and not held:  # their room was given back: each keeps what is left of it and fills the largest rooms
        again = []
        for link, j, n in over:
            again.append((link, j, min(n, room[j])))
            room[j] -= again[-1][2]
        for (link, _, n), (_, _, kept) in zip(over, list(again), strict=True):
            while n > kept:
                j = max(range(shards), key=lambda j: room[j])
                again.append((link, j, min(room[j], n - kept)))
                kept, room[j] = kept + again[-1][2], room[j] - again[-1][2]
        over = again
    first = Counter()
    for link, j, n in whole + over:
        first[link, j] += n
    shape = StructType([StructField("link", links.schema["link"].dataType), StructField("shard", IntegerType()), StructField("n", LongType())])
    return reduce(DataFrame.union, placed, links.sparkSession.createDataFrame([(link, j, n) for (link, j), n in first.items() if n], shape))


def cut_edges(placed: DataFrame) -> DataFrame:
    """(link, shard) rows -> one row, cut: pairs of rows with one link, counted, whose shards differ."""
    held = placed.where("link is not null").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by_link = held.groupBy("link").agg(F.sum("n").alias("c"), F.sum(pairs(F.col("n"))).alias("kept"))
    return by_link.agg(F.coalesce(F.sum(pairs(F.col("c")) - F.col("kept")), F.lit(0)).cast("long").alias("cut"))


def placed_rows(rows: DataFrame, shards: int, bucket_rows: int = 20_000) -> DataFrame:
    """(id, link, ...) -> the same rows with ``shard``; counts of the shards differ by one at most.

    ``id`` is different for each row, and a hash of it gives the shard where the row starts; rows with the same
    ``link`` are neighbours, null has none. Links of one row are none. A link larger than a shard fills whole shards,
    and what is over of it stays together unless whole links need its room (``propagate``).
    """
    total = rows.count()
    buckets = max(16, -(-total // bucket_rows))
    start = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    votes = rows.where("link is not null").groupBy("link", start).agg(F.count(F.lit(1)).alias("n"))
    links = votes.groupBy("link").agg(F.sum("n").alias("c"), F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("votes"))  # a vote for each shard
    held = propagate(links.where("c > 1"), shards, total, buckets)
    used = [0] * shards
    for j, n in held.groupBy("shard").agg(F.sum("n")).collect():
        used[j] = n
    pieces = held.groupBy("link").agg(F.sum("n").alias("c"), F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("pieces"))  # one for each shard
    named = stored(with_class(rows, checkpointed(pieces), ["link"], "c", total, ["pieces"]))
    whole = named.where("size(pieces) = 1").withColumn("shard", F.col("pieces")[0]["shard"])
    split = numbered(named.where("size(pieces) > 1"), ["link"], [F.col("id")], F.xxhash64("id"), "__n", buckets)
    # the first pieces[0].n rows of a link, then the next pieces[1].n, and so on
    split = split.withColumn("shard", F.expr("aggregate(pieces, named_struct('left', __n, 'shard', -1), (a, p) -> named_struct('left', a.left - p.n, 'shard', if(a.shard < 0 and a.left < p.n, p.shard, a.shard))).shard"))
    free = numbered(named.where("pieces is null"), [], [F.col("id")], F.xxhash64("id"), "__n", buckets)
    shard, lo = F.lit(0), 0
    for j in range(shards):
        shard = F.when(F.col("__n") >= lo, F.lit(j)).otherwise(shard)
        lo += total // shards + (j < total % shards) - used[j]
    columns = [*rows.columns, F.col("shard").cast("int").alias("shard")]
    return whole.select(*columns).union(split.select(*columns)).union(free.withColumn("shard", shard).select(*columns))


def shard_documents(docs: DataFrame, shards: int = 16, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, link, shard, slot): all rows of ``docs`` in shards whose counts differ by one at most.

    Neighbours are documents with equal texts (link: SHA-256). size is the UTF-8 length plus one; null text has size
    1, no neighbours and a null checksum. slot numbers a shard's rows from 0, copies next to each other within a
    bucket. Null doc_ids and repeated rows are rows like any other. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.col("text"), 256)).alias("link"),
        F.monotonically_increasing_id().alias("id"),
    )
    placed = stored(placed_rows(stored(rows), shards, bucket_rows))  # stored once, so that ids stand still
    spread = F.xxhash64(F.coalesce("link", F.col("id").cast("string").cast("binary")))
    # a hash of its own: rows without links went to shards in the order of the plain one
    slots = numbered(placed, ["shard"], [spread, F.col("id")], F.xxhash64("id", F.lit("slot")), "slot", max(16, -(-placed.count() // (shards * bucket_rows))))
    return slots.select("doc_id", "size", "text_crc32", "link", "shard", "slot")
