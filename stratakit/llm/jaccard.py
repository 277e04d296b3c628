"""Near-dedup by SimHash in vantage-point trees; MinHash bands add what differs in more bits, exact shingle sets verify all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import checkpointed, kept_rows, lean, with_class
from stratakit.llm.components import Forest, connected_components
from stratakit.llm.licenses import bands_for
from stratakit.llm.simhash import majority, near_keys

SEED = 43
ROWS, SURE = 6, 0.9999  # of a band; probability that two texts at the least similarity meet in one
BLOCK = 512  # shingles that are permuted at once


def plain(text: bytes | None) -> list[bytes]:
    """Words in small letters."""
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of runs of ``shingle`` words; a shorter text is one shingle. No word: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    pairs = zip(starts[:n].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))


class Sketch:
    """MinHash band keys of a shingle set."""

    def __init__(self, least: float, rows: int = ROWS, sure: float = SURE):
        self.rows, self.bands = rows, bands_for(least, rows, sure)
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 63, self.bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.bands * rows, dtype=np.uint64)
        self.salt = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)

    def keys(self, h: np.ndarray) -> list[int]:
        if not len(h):
            return []
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(h), BLOCK):
            v = h[k:k + BLOCK, None] * self.a + self.b
            np.minimum(least, v.min(axis=0), out=least)
        least = least.reshape(self.bands, self.rows)
        key = self.salt.copy()
        for r in range(self.rows):
            key = (key ^ least[:, r] ^ (least[:, r] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        return key.view(np.int64).tolist()


def linked(sets: list[np.ndarray], least: float, forest: Forest) -> None:
    """Unite in ``forest`` whatever is connected by pairs of a Jaccard similarity of ``least`` or more; exact.

    Two such sets share one of the few rarest shingles of each (the prefix that a lower overlap would miss), so
    only sets that do are compared, and only while they are not united yet.
    """
    some = [k for k, x in enumerate(sets) if len(x)]
    if len(some) < 2:
        return
    sizes = np.array([len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranked, at = {}, 0
    for k in some:
        ranked[k] = np.sort(order[inverse[at:at + sizes[k]]])
        at += sizes[k]
    prefix = {k: ranked[k][:sizes[k] - math.ceil(least * sizes[k] - 1e-9) + 1] for k in some}
    shingles = np.concatenate([prefix[k] for k in some])
    owners = np.repeat(some, [len(prefix[k]) for k in some])
    by = np.argsort(shingles, kind="stable")
    owners, starts = owners[by], np.concatenate(([0], np.cumsum(np.bincount(shingles, minlength=len(counts)))))
    left = len(np.unique(forest.roots(np.array(some))))
    for k in some:
        if left == 1:
            return
        met = np.unique(np.concatenate([owners[starts[s]:starts[s + 1]] for s in prefix[k]]))
        met = met[(met > k) & (sizes[met] >= least * sizes[k] - 1e-9) & (sizes[k] >= least * sizes[met] - 1e-9)]
        for j in met[forest.roots(met) != forest.roots(np.array([k]))[0]].tolist() if len(met) else ():
            pair = forest.roots(np.array([k, j]))
            if pair[0] == pair[1]:
                continue
            both = len(np.intersect1d(ranked[k], ranked[j], assume_unique=True))
            if both >= least * (sizes[k] + sizes[j] - both) - 1e-9:
                forest.unite(np.array([k]), np.array([j]))
                left -= 1


def _verified(group: pa.Table, least: float, shingle: int) -> pa.Table:
    """A spanning forest of the true links in one group of candidates."""
    node = group.column("node").to_numpy()
    sets = [shingle_set(plain(x.as_py()), shingle) for x in group.column("text")]
    order = np.argsort(node, kind="stable")
    node, sets = node[order], [sets[k] for k in order]
    forest = Forest(len(node))
    linked(sets, least, forest)
    root = forest.roots(np.arange(len(node)))
    keep = node[root] != node
    return pa.table({"a": pa.array(node[keep], pa.int64()), "b": pa.array(node[root[keep]], pa.int64())})


LOT = 512  # texts of one side of a block


def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, node) twice -> (key, l, r, node): each left node meets each right node of its key in one block.

    A side is dealt to lots of about LOT nodes, so a block holds two lots, however large a key is.
    """
    sizes = left.select("key", F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select("key", F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lots = lambda n: F.ceil(F.col(n) / F.lit(LOT)).cast("int")
    counts = checkpointed(sizes.where("a > 0 and b > 0").select("key", lots("a").alias("nl"), lots("b").alias("nr"), (F.col("a") + F.col("b")).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda side: with_class(side.select("key", "node"), counts, ["key"], "n", total, ["nl", "nr"]).where("nl is not null")
    return sized(left).select("key", own("nl").alias("l"), every("nr").alias("r"), "node").union(sized(right).select("key", every("nl").alias("l"), own("nr").alias("r"), "node"))


def candidate_links(banded: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """(node, key), (node, text) -> (a, b): edges that connect exactly the true links among nodes that share a key.

    The nodes of a key meet its smallest node, the lead, in blocks with all other followers of that lead; inside a
    block every pair is compared. Followers of one lead that fill several blocks have not all met: those that the
    lead's component does not hold yet meet all the others, block by block. So every pair that shares a key is
    compared, or connected already.
    """
    def verified(met: DataFrame) -> DataFrame:
        return met.join(texts, "node").groupBy("key", "l", "r").applyInArrow(lambda t: _verified(t, least, shingle), "a long, b long")

    leads = banded.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = with_class(banded, leads, ["key"], "n", banded.count(), ["lead"]).where("lead is not null and node <> lead").select(F.col("lead").alias("key"), "node").distinct()
    followers = checkpointed(met)
    found = checkpointed(verified(blocks(followers.select("key", F.col("key").alias("node")).distinct(), followers)))
    hot = checkpointed(followers.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LOT))
    if hot.isEmpty():
        return found
    total, component = followers.count(), connected_components(found)
    homes = hot.join(component.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("home", F.coalesce("component", "key"))
    crowd = checkpointed(with_class(followers, homes, ["key"], "n", total, ["home"]).where("home is not null"))
    owned = crowd.join(component, "node", "left").where(F.coalesce("component", "node") != F.col("home"))
    return found.union(checkpointed(verified(blocks(checkpointed(owned.select("key", "node")), crowd.select("key", "node")))))


def jaccard_components(docs: DataFrame, least: float = 0.8, shingle: int = 5, bits: int = 4) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable by links.

    Texts link if the Jaccard similarity of their sets of ``shingle`` words in small letters is ``least`` or more.
    Candidates are all pairs whose SimHash fingerprints (of the same sets) differ in ``bits`` bits or fewer, as
    vantage-point trees find them; and, since most pairs at ``least`` differ in more bits than such trees can prune,
    those that meet in a MinHash band: a pair at ``least`` does with a probability of SURE, a closer one almost
    surely. Verification is exact (on 64-bit shingle hashes). Texts of equal words form a class, represented by its smallest doc_id; only
    classes are searched. Texts without a word are one class and link with nothing else. A doc_id with two texts
    joins their classes. Null doc_id: the row gets its class's component (null if the class has no doc_id at all).
    Columns of ``docs`` other than doc_id and text are not read.
    """
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = Sketch(least)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys = [], [], []
            for x in batch.column(1):
                words = plain(x.as_py())
                h = shingle_set(words, shingle)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                prints.append(majority(h))
                keys.append(sketch.keys(h))
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), signed, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "fp", "keys"])

    sketches = checkpointed(rows.mapInArrow(sketched, "doc_id long, digest binary, fp long, keys array<long>"))
    total = sketches.count()
    named = sketches.where("doc_id is not null")
    classes = checkpointed(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    # any row of the class has its keys; the one that stands for it is read
    own = named.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi").where("size(keys) > 0").select(F.col("doc_id").alias("node"), "fp", "keys")
    points = checkpointed(own.select("node", "fp").distinct())
    banded = checkpointed(own.select("node", F.explode("keys").alias("key")).union(near_keys(points, bits)))
    found = candidate_links(banded, rows.withColumnRenamed("doc_id", "node"), least, shingle)
    shared = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    several = named.join(shared, "doc_id", "left_semi").select("digest", F.col("doc_id").alias("a"))
    joins = several.join(classes, "digest").select("a", F.col("node").alias("b"))
    component = connected_components(found.union(joins))
    whole = checkpointed(classes.join(component, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id")))
    return with_class(sketches.select("doc_id", "digest"), whole, ["digest"], "n", total, ["component_id"]).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, least: float = 0.8, shingle: int = 5, bits: int = 4) -> DataFrame:
    """SimHash near-dedup, completed by MinHash bands and verified by Jaccard similarity (``jaccard_components``).

    The rows of ``docs``, one for each component: the one with the smallest doc_id. Rows without doc_id stay.

    Of rows that share that doc_id, the one whose text has the smallest hash stays (see ``kept_rows``).
    """
    return kept_rows(docs, jaccard_components(docs.select("doc_id", "text"), least, shingle, bits))
