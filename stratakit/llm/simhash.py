"""SimHash near-dedup: exact Hamming components by vantage-point trees."""

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

SEED = 42
LEAF = 192  # points that are compared without a further split
BLOCK = 2048  # queries compared at once


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64. No word: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    pairs = zip(starts[:n].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; no hash: zero."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):  # a very long text needs no more memory than a short one
        ones += np.unpackbits(h[k:k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
        signed = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long. Null text: 0."""
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


class Plane:
    """An inner node: fingerprints within ``radius`` of ``point`` on one side, the others beyond it."""

    def __init__(self, point: np.uint64, radius: int, near, far):
        self.point, self.radius, self.near, self.far = point, radius, near, far


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point whose distances spread most, and the radius that halves ``points``. None: all are alike."""
    best = None
    for v in points[rng.choice(len(points), min(8, len(points)), replace=False)]:
        d = np.bitwise_count(points[:4096] ^ v)
        spread = float(d.std())
        if best is None or spread > best[0]:
            best = (spread, v)
    d = np.bitwise_count(points ^ best[1]).astype(np.int16)
    # the balanced radius at which the fewest points lie within a few bits of the border
    counts = np.bincount(d, minlength=65)
    inside = np.cumsum(counts)
    ok = [r for r in range(64) if 0.3 * len(d) <= inside[r] <= 0.7 * len(d)] or [r for r in range(64) if 0 < inside[r] < len(d)]
    if not ok:
        return None
    radius = min(ok, key=lambda r: (int(counts[max(0, r - 3):r + 5].sum()), abs(2 * int(inside[r]) - len(d))))
    return best[1], radius, d


def grow(sample: np.ndarray, shards: int, rng: np.random.Generator):
    """The upper tree, from a bounded sample; its leaves are shard numbers. -> (tree, number of shards)"""
    count = 0

    def build(points: np.ndarray, want: int):
        nonlocal count
        cut = _split(points, rng) if want > 1 and len(points) > 16 else None
        if cut is None:
            count += 1
            return count - 1
        v, r, d = cut
        near = max(1, round(want * float((d <= r).mean())))
        return Plane(v, r, build(points[d <= r], near), build(points[d > r], max(1, want - near)))

    return build(sample, shards), count


def route(tree, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home?) for the shard where each point lives and every shard within ``bits`` of it."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            out.append((at, node, home))
            continue
        d = np.bitwise_count(points[at] ^ node.point).astype(np.int16)
        # triangle bound: a point at distance d has no neighbour on the other side if |d - radius| is over ``bits``
        for child, keep, own in ((node.near, d <= node.radius + bits, d <= node.radius), (node.far, d > node.radius - bits, d > node.radius)):
            todo.append((child, at[keep], (home & own)[keep]))
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in out]), np.concatenate([x[2] for x in out])


def close_pairs(home: np.ndarray, asked: np.ndarray, bits: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into home, into asked) at ``bits`` or fewer differing bits: a VP tree over ``home`` searched by blocks.

    The tree is walked once for all queries; a branch keeps the queries that the triangle bound lets in.
    """
    rng = np.random.default_rng(seed)
    todo = [(np.arange(len(home)), np.arange(len(asked)))]
    while todo:
        t, q = todo.pop()
        if not len(t) or not len(q):
            continue
        cut = _split(home[t], rng) if len(t) > LEAF else None
        if cut is None:
            for k in range(0, len(q), BLOCK):
                part = q[k:k + BLOCK]
                for j in range(0, len(t), LEAF):
                    i, c = np.nonzero(np.bitwise_count(asked[part][:, None] ^ home[t[j:j + LEAF]][None, :]) <= bits)
                    if len(i):
                        yield t[j + c], part[i]
            continue
        v, r, d = cut
        dq = np.bitwise_count(asked[q] ^ v).astype(np.int16)
        todo += [(t[d <= r], q[dq <= r + bits]), (t[d > r], q[dq > r - bits])]


def _shard_edges(shard: pa.Table, bits: int) -> pa.Table:
    """A spanning forest of the links found in one shard: at most a row per point, however many links there are."""
    node, fp, home = (shard.column(k).to_numpy() for k in ("node", "fp", "home"))
    order = np.argsort(node, kind="stable")
    node, code, home = node[order], fp[order].view(np.uint64), home[order].astype(bool)
    forest, at_home = Forest(len(node)), np.flatnonzero(home)
    for i, j in close_pairs(code[at_home], code, bits):
        forest.unite(at_home[i], j)
    root = forest.roots(np.arange(len(node)))
    keep = root != np.arange(len(node))
    return pa.table({"a": pa.array(node[keep], pa.int64()), "b": pa.array(node[root[keep]], pa.int64())})


CROWD = 64  # neighbours beyond which a point shares a key with the points around it


def _shard_keys(shard: pa.Table, bits: int) -> pa.Table:
    """(node, key): every pair of one home and one asked point at ``bits`` or fewer differing bits shares a key.

    A key is a home point's node: it and its neighbours with larger nodes. Points with over CROWD neighbours are
    covered by few of them instead: one takes all within ``bits`` of it along, and what is within twice that, so has
    all their neighbours, gets its key. So a dense group needs no row for each pair.
    """
    node, fp, home = (shard.column(k).to_numpy() for k in ("node", "fp", "home"))
    code, at_home = fp.view(np.uint64), np.flatnonzero(home.astype(bool))
    degree, some = np.zeros(len(at_home), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in close_pairs(code[at_home], code, bits):
        other = at_home[i] != j
        i, j = i[other], j[other]
        np.add.at(degree, i, 1)
        few = (degree[i] <= CROWD) & (node[j] > node[at_home[i]])
        some.append((i[few], j[few]))
    i, j = (np.concatenate(x) for x in zip(*some, strict=True))
    few = degree[i] <= CROWD
    i, j = at_home[i[few]], j[few]
    centre = np.unique(i)
    rows = [(node[centre], node[centre]), (node[j], node[i])]
    crowd = np.flatnonzero(degree > CROWD)
    crowd, left = at_home[crowd[np.argsort(-degree[crowd], kind="stable")]], np.zeros(len(node), bool)
    left[crowd] = True
    for c in crowd.tolist():
        if left[c]:
            d = np.bitwise_count(code ^ code[c])
            left[d <= bits] = False
            met = node[d <= 2 * bits]
            rows.append((met, np.full(len(met), node[c])))
    out = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return pa.table({"node": pa.array(out[0], pa.int64()), "key": pa.array(out[1], pa.int64())})


def in_shards(classes: DataFrame, bits: int, sample: int = 8192, shard_rows: int = 40_000) -> DataFrame:
    """(node, fp), fingerprints distinct -> (node, fp, shard, home): each in its own shard and in all that its ball overlaps.

    The upper VP tree is fitted on ``sample`` fingerprints (bounded, and only its balance depends on them);
    every fingerprint is indexed in one shard and asked in all shards that its ball overlaps.
    """
    n = classes.count()
    drawn = [r[0] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()]
    tree, count = grow(np.array(drawn, np.int64).view(np.uint64), max(1, math.ceil(n / shard_rows)), np.random.default_rng(SEED))

    def deal(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy()
            at, shard, home = route(tree, fp.view(np.uint64), bits)
            node = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(fp[at]), pa.array(shard, pa.int32()), pa.array(home)], ["node", "fp", "shard", "home"])

    return classes.select("node", "fp").mapInArrow(deal, "node long, fp long, shard int, home boolean")


def near_edges(classes: DataFrame, bits: int, sample: int = 8192, shard_rows: int = 40_000) -> DataFrame:
    """(node, fp), fingerprints distinct -> (a, b): edges that connect exactly the fingerprints linked by ``bits``."""
    return in_shards(classes, bits, sample, shard_rows).groupBy("shard").applyInArrow(lambda t: _shard_edges(t, bits), "a long, b long")


def near_keys(points: DataFrame, bits: int, sample: int = 8192, shard_rows: int = 40_000) -> DataFrame:
    """(node, fp) -> (node, key): every two nodes whose fingerprints differ in ``bits`` bits or fewer share a key; exact.

    Others may share one too (``_shard_keys``), so keys give candidates. A fingerprint of many nodes is one point.
    """
    total = points.count()
    if not total:
        return points.select("node", F.lit(0).cast("long").alias("key")).limit(0)
    prints = checkpointed(points.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")))
    found = in_shards(prints.select(F.col("lead").alias("node"), "fp"), bits, sample, shard_rows).groupBy("shard").applyInArrow(lambda t: _shard_keys(t, bits), "node long, key long")
    found = found.union(prints.where("n > 1").select("lead", "lead")).groupBy("node").agg(F.collect_set("key").alias("keys"))
    named = checkpointed(prints.join(found, F.col("lead") == F.col("node")).select("fp", "n", "keys"))
    met = with_class(points.select("node", "fp"), named, ["fp"], "n", total, ["keys"])
    return met.select("node", F.explode("keys").alias("key")).select("node", F.xxhash64(F.lit("simhash"), "key").alias("key"))


def simhash_components(docs: DataFrame, bits: int = 4, shingle: int = 4, shard_rows: int = 40_000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable by links.

    Documents with one fingerprint form a class, represented by its smallest doc_id; only classes are searched,
    so thousands of copies cost one point. Null or empty text has fingerprint zero and links like any other.
    Null doc_id: the row gets its class's component (null if the class has no doc_id at all). Repeated rows are
    returned as often as they came. Columns of ``docs`` other than doc_id and text are not read.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).where("node is not null").select("node", "fp", "n"))
    if classes.isEmpty():
        return prints.withColumn("component_id", F.lit(None).cast("long"))
    # a doc_id that occurs with two texts stands for two classes, which it joins: its rows share it as a node
    shared = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    several = prints.join(shared, "doc_id", "left_semi").select("fp", F.col("doc_id").alias("a"))
    joins = several.join(classes, "fp").select("a", F.col("node").alias("b"))
    found = near_edges(classes.select("node", "fp"), bits, shard_rows=shard_rows).union(joins)
    component = connected_components(found)
    named = checkpointed(classes.join(component, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")))
    return with_class(prints, named, ["fp"], "n", prints.count(), ["component_id"]).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs``, one for each component: the one with the smallest doc_id. Rows without doc_id stay.

    Of rows that share that doc_id, the one whose text has the smallest hash stays (see ``kept_rows``).
    """
    return kept_rows(docs, simhash_components(docs.select("doc_id", "text"), bits, shingle).select("doc_id", "component_id"))
