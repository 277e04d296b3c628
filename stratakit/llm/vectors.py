"""Embedding near-dedup: hierarchical navigable small-world graphs per shard, exact cosine, components."""

from __future__ import annotations

import io
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import buckets_for, checkpointed, lean, numbered, stored, with_class
from stratakit.llm.components import Forest, connected_components

STEP = 4  # nodes of a beam that are expanded at once
BLOCK = 256  # queries that walk together


class HNSW:
    """A navigable small-world graph over unit vectors; ``degree`` links a node above the ground, twice that on it."""

    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 48, seed: int = 3):
        self.x, self.degree, self.n = np.ascontiguousarray(x, np.float32), degree, len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(self.n) + 1e-12) / np.log(degree)).astype(int), 8)
        self.order = rng.permutation(self.n)
        top = int(self.level.max(initial=0))
        self.links = [np.full((self.n, degree * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        self.entry = None
        done = 0
        while done < self.n:
            lot = self.order[done:done + max(1, min(BLOCK, done))]
            self._insert(lot, beam)
            done += len(lot)

    def search(self, q: np.ndarray, beam: int, ground: int = 0, wanted: int | None = None):
        """(ids, similarities) by falling similarity, ``beam`` for each query; unused places hold -1."""
        at = np.full((len(q), 1), self.entry[0])
        for layer in range(self.entry[1], ground, -1):
            at = self._walk(q, at, layer, 4)[0][:, :1]
        return self._walk(q, at, ground, beam)

    def _walk(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int):
        links, rows = self.links[layer], len(q)
        seen = np.zeros((rows, self.n), bool)
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -np.inf, np.float32)
        open_ = np.zeros((rows, beam), bool)
        k = min(start.shape[1], beam)
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.where(start[:, :k] >= 0, np.matmul(self.x[start[:, :k]], q[:, :, None])[..., 0], -np.inf)
        open_[:, :k] = start[:, :k] >= 0
        np.put_along_axis(seen, np.maximum(start[:, :k], 0), True, 1)
        live = np.arange(rows)
        while len(live):
            live = live[open_[live].any(1)]
            if not len(live):
                break
            s = np.where(open_[live], sims[live], -np.inf)
            t = min(STEP, beam)
            pick = np.argpartition(-s, t - 1, axis=1)[:, :t]
            good = np.take_along_axis(s, pick, 1) > -np.inf
            near = np.where(good[..., None], links[np.where(good, np.take_along_axis(ids[live], pick, 1), 0)], -1).reshape(len(live), -1)
            expanded = open_[live]
            np.put_along_axis(expanded, pick, False, 1)
            near = np.sort(near, axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            safe = np.maximum(near, 0)
            fresh &= ~seen[live[:, None], safe]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[live[r]])
            all_s = np.concatenate((sims[live], sim), 1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), 1), best, 1)
            open_[live] = np.take_along_axis(np.concatenate((expanded, fresh), 1), best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims

    def _select(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates by falling similarity, those nearer to the node than to one chosen before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        rows, c = cand.shape
        v = self.x[np.maximum(cand, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros((rows, c), bool)
        count = np.zeros(rows, int)
        for j in range(c):
            ok = (sims[:, j] > -np.inf) & (count < most) & ~(chosen[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
            chosen[:, j] = ok
            count += ok
        rank = np.argsort(np.where(chosen, 0, np.where(sims > -np.inf, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(sims, rank, 1) > -np.inf, np.take_along_axis(cand, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _insert(self, lot: np.ndarray, beam: int) -> None:
        if self.entry is None:
            self.entry = (int(lot[0]), int(self.level[lot[0]]))
            return
        q, levels = self.x[lot], self.level[lot]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        at = np.full((len(lot), 1), self.entry[0])
        for layer in range(max(self.entry[1], int(levels.max())), -1, -1):
            if layer <= self.entry[1]:
                ids, sims = self._walk(q, at, layer, beam if layer == 0 or (levels >= layer).any() else 4)
                at = ids[:, :4]
            else:
                ids, sims = np.full((len(lot), 1), -1), np.full((len(lot), 1), -np.inf, np.float32)
            new = np.flatnonzero(levels >= layer)
            if not len(new):
                continue
            # nodes of this lot do not see each other in the graph yet
            few = min(8, len(new))
            mates = among[np.ix_(new, new)]
            pick = np.argpartition(-mates, few - 1, axis=1)[:, :few]
            cand = np.concatenate((ids[new], lot[new][pick]), 1)
            sim = np.concatenate((sims[new], np.take_along_axis(mates, pick, 1)), 1)
            chosen = self._select(cand, sim, self.degree)
            links = self.links[layer]
            links[lot[new], :self.degree] = chosen
            self._link_back(links, lot[new], chosen)
        high = int(levels.argmax())
        if levels[high] > self.entry[1]:
            self.entry = (int(lot[high]), int(levels[high]))

    def _link_back(self, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
        frm, to = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        frm, to = frm[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.lexsort((frm, to))
        frm, to = frm[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        size = np.diff(np.append(first, len(to)))
        wide = min(int(size.max(initial=1)), 3 * links.shape[1])
        cand = np.full((len(first), links.shape[1] + wide), -1, np.int64)
        cand[:, :links.shape[1]] = links[to[first]]
        place = np.arange(len(to)) - np.repeat(first, size)
        ok = place < wide
        cand[np.repeat(np.arange(len(first)), size)[ok], links.shape[1] + place[ok]] = frm[ok]
        # a node may hold a newcomer already: one of the two goes
        cand = -np.sort(-cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        for k in range(0, len(first), 1024):
            part, own = cand[k:k + 1024], self.x[to[first][k:k + 1024]]
            part = -np.sort(-part, axis=1)
            part = part[:, :max(1, int((part >= 0).sum(1).max()))]
            if part.shape[1] <= links.shape[1]:
                links[to[first][k:k + 1024]] = np.pad(part, ((0, 0), (0, links.shape[1] - part.shape[1])), constant_values=-1)
                continue
            sims = np.where(part >= 0, np.matmul(self.x[np.maximum(part, 0)], own[:, :, None])[..., 0], -np.inf)
            links[to[first][k:k + 1024]] = self._select(part, sims, links.shape[1])


def linked(graph: HNSW, x: np.ndarray, asked: np.ndarray, least: float, beam: int):
    """Yield (query numbers, home numbers) of pairs found with cosine >= ``least`` in double precision.

    A beam that ends above the threshold may hide more links: it is widened until it ends below. Widened to 1/WIDE of
    the graph it would cost more than all of it, so then all nodes are compared.
    """
    single = asked.astype(np.float32)
    for k in range(0, len(asked), BLOCK):
        at, wide = np.arange(k, min(k + BLOCK, len(asked))), beam
        while len(at):
            if wide >= graph.n or wide > beam and wide * WIDE >= graph.n:
                for i in range(0, graph.n, SCAN):
                    r, h = np.nonzero(single[at] @ graph.x[i:i + SCAN].T >= least - 1e-4)
                    yield from _sure(at[r], h + i, x, asked, least)
                break
            ids, sims = graph.search(single[at], wide)
            more = sims[:, -1] >= least - 1e-4
            r, c = np.nonzero((sims >= least - 1e-4) & (ids >= 0) & ~more[:, None])
            yield from _sure(at[r], ids[r, c], x, asked, least)
            at, wide = at[more], 8 * wide


def _sure(q: np.ndarray, h: np.ndarray, x: np.ndarray, asked: np.ndarray, least: float):
    for i in range(0, len(q), 1 << 15):
        sure = np.einsum("ij,ij->i", asked[q[i:i + (1 << 15)]], x[h[i:i + (1 << 15)]]) >= least
        yield q[i:i + (1 << 15)][sure], h[i:i + (1 << 15)][sure]


WIDE = 16
SCAN = 8192  # nodes compared at once
SPARSE = 2  # links of a query, besides itself, that are still few


def audit_sample(x: np.ndarray, asked: np.ndarray, own: bool, least: float, most: int = 64, looked: int = 4096, seed: int = 9) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(queries, their true links) of at most ``most`` queries with few links and of as many with more.

    Brute force over at most ``looked`` queries, drawn by chance. ``own``: the queries are the graph's nodes, whose
    links to themselves are none.
    """
    groups: list[tuple[list[int], list[np.ndarray]]] = [([], []), ([], [])]
    order = np.random.default_rng(seed).permutation(len(asked))[:looked]
    for k in range(0, len(order), 256):
        pick = order[k:k + 256]
        true = asked[pick] @ x.T >= least + 1e-12  # not what only rounding decides
        if own:
            true[np.arange(len(pick)), pick] = False
        for q, n in zip(np.flatnonzero(true.any(1)).tolist(), true.sum(1)[true.any(1)].tolist(), strict=True):
            queries, links = groups[int(n > SPARSE)]
            if len(queries) < most:
                queries.append(int(pick[q]))
                links.append(np.flatnonzero(true[q]))
        if all(len(g[0]) == most for g in groups):
            break
    return [(np.array(queries), links) for queries, links in groups if queries]


def audit(graph: HNSW, x: np.ndarray, asked: np.ndarray, least: float, beam: int, sample: list[tuple[np.ndarray, list[np.ndarray]]]) -> float:
    """Mean share of a query's true links that the graph finds; of queries with few links and with more, the lesser."""
    worst = 1.0
    for queries, links in sample:
        got = np.zeros((len(queries), len(x)), bool)
        for q, h in linked(graph, x, asked[queries], least, beam):
            got[q, h] = True
        worst = min(worst, float(np.mean([got[q, h].mean() for q, h in enumerate(links)])))
    return worst


def audited(graph: HNSW, x: np.ndarray, asked: np.ndarray, own: bool, least: float, recall: float) -> tuple[int, int, int, float]:
    """(beam, queries, links, recall): the beam is doubled until the sample's recall is ``recall``, or all is scanned."""
    sample, beam = audit_sample(x, asked, own, least), 16
    got = audit(graph, x, asked, least, beam, sample)
    while got < recall and beam < graph.n:
        beam *= 2
        got = audit(graph, x, asked, least, beam, sample)
    return beam, sum(len(q) for q, _ in sample), sum(len(h) for _, links in sample for h in links), got


class Shard:
    """The nodes of one shard, unit vectors in double precision, and their graph."""

    def __init__(self, node: np.ndarray, code: np.ndarray, size: np.ndarray, x: np.ndarray, graph: HNSW):
        self.node, self.code, self.size, self.x, self.graph = node, code, size, x, graph

    @classmethod
    def of(cls, rows: pa.Table) -> Shard:
        node, code, size = (rows.column(k).to_numpy() for k in ("node", "code", "size"))
        order = np.lexsort((code, node))
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the square
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return cls(node[order], code[order], size[order], v, HNSW(v))

    def pack(self) -> bytes:
        g = self.graph
        out = io.BytesIO()
        np.savez(out, node=self.node, code=self.code, size=self.size, x=self.x, entry=np.array(g.entry), **{f"links{k}": x for k, x in enumerate(g.links)})
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        held = np.load(io.BytesIO(blob))
        graph = HNSW.__new__(HNSW)
        graph.x = held["x"].astype(np.float32)
        graph.n, graph.entry = len(graph.x), tuple(held["entry"].tolist())
        graph.links = [held[f"links{k}"] for k in range(graph.entry[1] + 1)]
        return cls(held["node"], held["code"], held["size"], held["x"], graph)


FOUND = "node long, code long, n long, a long, b long, beam int, queries int, links long, recall double"
EMPTY = pa.table({"node": pa.array([], pa.int64()), "code": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "beam": pa.array([], pa.int32()), "queries": pa.array([], pa.int32()), "links": pa.array([], pa.int64()), "recall": pa.array([], pa.float64())})


def found_rows(node: np.ndarray, code: np.ndarray, count: np.ndarray, forest: Forest, audits: list[tuple[int, int, int, float]]) -> pa.Table:
    """A count for each node with links, edges that connect what is linked, and a row for each audit."""
    root, some = forest.roots(np.arange(len(node))), np.flatnonzero(count)
    keep = np.flatnonzero(root != np.arange(len(node)))
    columns = {"node": node[some], "code": code[some], "n": count[some], "a": node[keep], "b": node[root[keep]]}
    kinds = {f.name: f.type for f in EMPTY.schema}
    counts = pa.table({k: pa.array(columns[k], kinds[k]) for k in ("node", "code", "n")})
    edges = pa.table({k: pa.array(columns[k], kinds[k]) for k in ("a", "b")})
    notes = pa.table({k: pa.array([a[i] for a in audits], kinds[k]) for i, k in enumerate(("beam", "queries", "links", "recall"))})
    return pa.concat_tables([EMPTY, counts, edges, notes], promote_options="default")


def _inside(rows: pa.Table, least: float, recall: float, alone: bool) -> pa.Table:
    """Build one shard's graph and ask it for its own nodes' links; the shard is packed if others will ask it."""
    shard = Shard.of(rows)
    x, n = shard.x, len(shard.node)
    note = audited(shard.graph, x, x, True, least, recall)
    met, forest = np.zeros((n, n), bool), Forest(n)
    for q, h in linked(shard.graph, x, x, least, note[0]):
        met[q, h] = True
        forest.unite(q, h)
    met |= met.T
    np.fill_diagonal(met, False)
    out = found_rows(shard.node, shard.code, weighed(met, shard.size), forest, [note])
    blob = [None] * out.num_rows + ([] if alone else [shard.pack()])
    out = out if alone else pa.concat_tables([out, pa.table({"node": pa.nulls(1, pa.int64())})], promote_options="default")
    return out.append_column("blob", pa.array(blob, pa.large_binary()).cast(pa.binary()))


def weighed(met: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows behind the nodes that each node met."""
    count = np.zeros(len(met), np.int64)
    for k in range(0, len(met), 512):
        count[k:k + 512] = met[k:k + 512] @ size
    return count


def _between(pair: pa.Table, least: float, recall: float) -> pa.Table:
    """Links between two shards: each one's nodes ask the other's graph, and what either finds counts for both."""
    if pair.num_rows < 2:
        return EMPTY
    a, b = (Shard.unpack(x.as_py()) for x in pair.column("blob"))
    met, forest = np.zeros((len(a.node), len(b.node)), bool), Forest(len(a.node) + len(b.node))
    notes = []
    for one, other, way in ((a, b, met), (b, a, met.T)):
        notes.append(audited(other.graph, other.x, one.x, False, least, recall))
        for q, h in linked(other.graph, other.x, one.x, least, notes[-1][0]):
            way[q, h] = True
    for k in range(0, len(a.node), 512):
        q, h = np.nonzero(met[k:k + 512])
        forest.unite(q + k, h + len(a.node))
    return found_rows(np.concatenate((a.node, b.node)), np.concatenate((a.code, b.code)), np.concatenate((weighed(met, b.size), weighed(met.T, a.size))), forest, notes)


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_links(classes: DataFrame, least: float, recall: float, shard_rows: int) -> DataFrame:
    """(label, v, node, code, size), vectors of a label distinct -> rows of FOUND: counts by (node, code), edges, audits.

    A shard has about ``shard_rows`` nodes, fewer where they would take more than SHARD_BYTES. Its graph is built
    once and stored in the shared folder; then each pair of shards of a label meets in a task of its own, which holds
    these two and no more. A label with S shards is work for S * (S + 1) / 2 tasks.
    """
    dims = classes.withColumn("dim", F.size("v"))
    rows_each = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = dims.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.first(rows_each)).cast("int").alias("shards"))
    dealt = dims.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node", "code"), F.col("shards")).cast("int"))
    # one key for all three, else the join's partitioning by label would bring a label's shards into one task
    group = F.concat_ws(":", F.col("dim"), F.col("shards"), F.col("label").cast("string"))
    dealt = dealt.select(group.alias("label"), "shards", "shard", F.concat_ws(":", "shard", group).alias("key"), "node", "code", "size", "v")

    def built(t: pa.Table) -> pa.Table:
        label, shards, shard = (t.column(k)[0].as_py() for k in ("label", "shards", "shard"))
        out = _inside(t, least, recall, shards == 1)
        for name, value, kind in (("label", label, pa.string()), ("shards", shards, pa.int32()), ("shard", shard, pa.int32())):
            out = out.append_column(name, pa.array([value] * out.num_rows, kind))
        return out

    inside = stored(dealt.groupBy("key").applyInArrow(built, FOUND + ", blob binary, label string, shards int, shard int"))
    packed = inside.where("blob is not null")
    meets = packed.select("label", "shard", "blob", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).where("other <> shard")
    # one row for each of the two shards, smaller number first or not: counts and links do not depend on it
    pair = F.concat_ws(":", F.least("shard", "other"), F.greatest("shard", "other"), "label")
    between = lean(meets).select(pair.alias("pair"), "blob").groupBy("pair").applyInArrow(lambda t: _between(t, least, recall), FOUND)
    names = [f.name for f in EMPTY.schema]
    return inside.where("blob is null").select(*names).union(stored(between).select(*names))


#: Doubles of a shard's vectors take no more than this.
SHARD_BYTES = 32 << 20


def embedding_components(rows: DataFrame, least: float = 0.98, recall: float = 0.995, shard_rows: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id) for each row: vectors link if labels are equal and cosine >= ``least``.

    Equal vectors of a label are one node of the graphs, however many there are; each adds to the counts. A label is
    cut into shards, each with a graph; every node is asked in all shards of its label (``vector_links``). Beams
    widen until a sample's recall against brute force reaches ``recall``; cosines are verified in double precision,
    and a link found from one side counts for both. The audits' size and outcome are logged.

    n_links counts rows, component_id is the smallest vec_id reachable. Rows that repeat a vec_id are vectors of their
    own, each with its own n_links, but their vec_id is one node of the components, so they share the smallest. A row
    with a null vec_id links and is counted like any other; its component_id is null if no vec_id is reachable. Vectors
    with a null label or unusable values link with nothing and have their own vec_id as component; vectors of another
    length than theirs link with nothing else. A cosine at the threshold links. Other columns are not read; an empty
    table gives none.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    own = stored(own.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull()))
    good = own.where("ok").select("vec_id", "label", "v")
    # two classes may have one vec_id as their smallest: code tells them apart where links are counted
    classes = checkpointed(good.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("size")).withColumn("code", F.xxhash64("label", "v")))
    total, top, unnamed = classes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("last"), F.lit(0)), F.count_if(F.col("node").isNull())).first()
    if unnamed:  # classes without any vec_id get numbers above all of them
        fresh = classes.where("node is null").drop("node")
        fresh = numbered(fresh, [], [F.col("code")], F.col("code"), "node", buckets_for(fresh, 4 << 20)).withColumn("node", F.col("node") + F.lit(top + 1))
        classes = checkpointed(classes.where("node is not null").unionByName(fresh))
    found = vector_links(classes.select("label", "v", "node", "code", "size"), least, recall, shard_rows)
    _report(found)
    # a vec_id with several rows joins their classes
    repeated = good.where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    joins = with_class(good.join(repeated, "vec_id", "left_semi").select("vec_id", "label", "v"), classes, ["label", "v"], "size", total, ["node"])
    component = connected_components(found.where("a is not null").select("a", "b").union(joins.select(F.col("node").alias("a"), F.col("vec_id").alias("b"))))
    others = found.where("node is not null").groupBy("node", "code").agg(F.sum("n").alias("others"))
    named = classes.join(others, ["node", "code"], "left").join(component, "node", "left").withColumn("id", F.coalesce("component", "node"))
    n_links = (F.coalesce("others", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links")
    named = checkpointed(named.select("label", "v", "size", n_links, F.when(F.col("id") <= top, F.col("id")).alias("component_id")))
    known = with_class(good, named, ["label", "v"], "size", total, ["n_links", "component_id"]).select("vec_id", "n_links", "component_id")
    return known.union(own.where("not ok").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))


def _report(found: DataFrame) -> None:
    graphs, queries, links, recall, beam = found.where("beam is not null").agg(F.count(F.lit(1)), F.sum("queries"), F.sum("links"), F.min("recall"), F.max("beam")).first()
    if graphs:
        logging.getLogger(__name__).info("%d audits asked %d queries with %d links: least recall %.4f, widest beam %d", graphs, queries, links, recall, beam)


SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), components AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM linked GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id
"""
