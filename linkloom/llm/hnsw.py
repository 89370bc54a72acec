"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards, every shard builds its graph, and every vector is
searched in every shard. Searches and insertions run for many vectors at a time
as array operations. A search that fills its beam with links widens it; a block
in which a search audited by brute force falls short of the recall widens it for all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import components, mix
from linkloom.session import materialized

THRESHOLD = 0.9
DEGREE = 12  # links of a node on upper layers; twice as many on the lowest
BUILD_BEAM, BEAM = 64, 64
STEP = 4  # nodes of a beam that are expanded at a time
TOP = 1024  # layers of at most so many nodes are searched by brute force
ENTRIES = 16  # nodes that a search enters a layer by
BLOCK = 512  # vectors searched at a time
AUDITED = 32  # searches of a block that are checked by brute force
RECALL = 0.99
WIDEST = 256  # beams beyond it cost more than comparing all leaders
DENSE = 32  # queries near more than this part of a shard are compared with all of it
CELLS = 1 << 22  # numbers of an array of candidates
#: Vectors within this cosine of a leader are found through it, so that tight groups are no islands of a graph.
RADIUS = 0.95
#: Vectors of a shard at most, and shards at least where each gets so many vectors.
SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 100_000, 8, 64


def _leaders(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that lead, and the leader of each vector: the nearest earlier one within ``RADIUS``, else itself."""
    leaders, lead = np.zeros(0, np.int64), np.arange(len(vectors))
    for begin in range(0, len(vectors), 2 * BLOCK):
        block = np.arange(begin, min(begin + 2 * BLOCK, len(vectors)))
        best, score = np.zeros(len(block), np.int64), np.full(len(block), -2.0, np.float32)
        for k in range(0, len(leaders), CELLS // (2 * BLOCK)):  # so many leaders that their cosines fit
            near = vectors[block] @ vectors[leaders[k : k + CELLS // (2 * BLOCK)]].T
            top = near.argmax(1)
            value = near[np.arange(len(block)), top]
            better = value > score
            best[better], score[better] = leaders[k + top[better]], value[better]
        led = score >= RADIUS
        lead[block[led]] = best[led]
        block = block[~led]
        close = vectors[block] @ vectors[block].T >= RADIUS
        free = np.ones(len(block), bool)
        for k in range(len(block)):
            if free[k]:
                mine = close[k] & free
                lead[block[mine]] = block[k]
                free &= ~mine
        leaders = np.concatenate([leaders, block[lead[block] == block]])
    return leaders, lead


class Graph:
    """Layered graph over the leaders of a shard's unit vectors.

    Layer 0 has all leaders, each next one about a twelfth of them. Whatever is
    within an angle of a query has a leader within that angle plus that of
    ``RADIUS``, so nothing is lost by searching leaders.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.ids, self.exact = ids, vectors
        single = vectors.astype(np.float32)
        leaders, lead = _leaders(single)
        self.vectors = single[leaders]
        at = np.searchsorted(leaders, lead)
        self.member = np.argsort(at, kind="stable")
        self.size = np.bincount(at, minlength=len(leaders))
        self.start = np.cumsum(self.size) - self.size
        u = (mix(ids[leaders].astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
        height = np.floor(-np.log(u + 1e-18) / np.log(DEGREE)).astype(int)
        order = np.argsort(-height, kind="stable")  # the nodes of upper layers come first in each layer
        sizes = [len(order)]
        while sizes[-1] > TOP and (height >= len(sizes)).any():
            sizes.append(int((height >= len(sizes)).sum()))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and neighbours (-1: none), lowest layer first
        for level in range(len(sizes) - 1, -1, -1):
            self.layers.insert(0, self._connect(order[: sizes[level]], DEGREE * (1 if level else 2)))

    def _connect(self, nodes: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """One layer, built by inserting blocks of nodes into the graph so far; searches enter through the layers above."""
        links = np.full((len(self.vectors), degree), -1, np.int32)
        above = len(self.layers[0][0]) if self.layers else 0
        done = 0
        while done < len(nodes) and (self.layers or len(nodes) > TOP):
            block = nodes[done : done + min(max(done, TOP), 2 * BLOCK)]
            near = self.vectors[block] @ self.vectors[block].T
            np.fill_diagonal(near, -2)
            own = np.argsort(-near, axis=1)[:, : 2 * degree]
            found, score = block[own], np.take_along_axis(near, own, 1)
            if done:
                entry = np.broadcast_to(nodes[np.linspace(0, done - 1, min(done, 32)).astype(int)], (len(block), min(done, 32)))
                if done >= above > 0:
                    entry = np.hstack([self.search(self.vectors[block], 16)[0][:, :16], entry[:, ::8]])
                    entry = np.where(entry >= 0, entry, entry[:, :1])
                more, more_score = self._beam(self.vectors[block], entry, links, BUILD_BEAM)
                found, score = np.hstack([found, more]), np.hstack([score, more_score])
            chosen = self._diverse(self.vectors[block], found, score, degree)
            links[block] = chosen
            self._back(links, block, chosen, degree)
            done += len(block)
        return nodes, links

    def _diverse(self, query: np.ndarray, found: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours nearest first, passing over those nearer to a chosen one than to the query; then the nearest left."""
        order = np.argsort(-score, axis=1)[:, : 3 * degree]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        vectors = self.vectors[found]
        between = np.einsum("qid,qjd->qij", vectors, vectors)
        taken = np.zeros(found.shape, bool)
        room = np.full(len(found), degree)
        blocked = np.full(found.shape, -2.0, np.float32)
        for k in range(found.shape[1]):
            ok = (found[:, k] >= 0) & (score[:, k] > -1.5) & (room > 0) & (blocked[:, k] < score[:, k])
            taken[:, k] = ok
            room -= ok
            blocked = np.where(ok[:, None], np.maximum(blocked, between[:, k]), blocked)
        rank = np.where(taken, 0, 1) + np.where((found < 0) | (score <= -1.5), 2, 0)
        order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        out = np.full((len(found), degree), -1, np.int32)
        picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(found, order, 1), -1)
        out[:, : picked.shape[1]] = picked
        return out

    def _back(self, links: np.ndarray, block: np.ndarray, chosen: np.ndarray, degree: int) -> None:
        """Links back from the chosen neighbours, which keep their most diverse ones."""
        source, target = np.repeat(block, chosen.shape[1]), chosen.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        start = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        size = np.diff(np.append(start, len(target)))
        for part in range(0, len(start), 4 * BLOCK):
            rows = slice(part, part + 4 * BLOCK)
            wide = int(min(size[rows].max(), 4 * degree))
            at = start[rows, None] + np.arange(wide)
            fresh = np.where(np.arange(wide) < size[rows, None], source[np.minimum(at, len(source) - 1)], -1)
            node = target[start[rows]]
            found = np.hstack([links[node], fresh])
            found = np.where(found == node[:, None], -1, found)
            score = np.where(found >= 0, np.einsum("qd,qkd->qk", self.vectors[node], self.vectors[found]), -2)
            links[node] = self._diverse(self.vectors[node], found, score.astype(np.float32), degree)

    def _beam(self, query: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes for each query that a beam search from the entries finds, best first; -1 where there are fewer."""
        q = len(query)
        lines = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.vectors) + 1), bool)  # the last column takes the missing neighbours
        seen[lines, entry] = True
        nodes = np.sort(np.array(entry, np.int32), axis=1)
        score = np.einsum("qd,qkd->qk", query, self.vectors[nodes])
        score[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -2
        nodes = np.where(score > -1.5, nodes, -1)
        nodes, score, spent = self._best(nodes, score, np.zeros(nodes.shape, bool), beam)
        active = np.arange(q)
        while len(active):
            waiting = np.where(spent[active] | (nodes[active] < 0), -3, score[active])
            pick = np.argsort(-waiting, axis=1)[:, :STEP]
            useful = np.take_along_axis(waiting, pick, 1) > -2.5
            active, pick, useful = (x[useful.any(1)] for x in (active, pick, useful))
            if not len(active):
                break
            spent[active[:, None], pick] = True
            wave = np.where(useful[:, :, None], links[nodes[active[:, None], pick]], -1).reshape(len(active), -1)
            wave = np.sort(wave, axis=1)
            wave[:, 1:][wave[:, 1:] == wave[:, :-1]] = -1
            wave = np.where(seen[active[:, None], wave], -1, wave)
            seen[active[:, None], wave] = True
            fresh = np.where(wave >= 0, np.einsum("qd,qkd->qk", query[active], self.vectors[wave]), -2)
            merged = self._best(
                np.hstack([nodes[active], wave]), np.hstack([score[active], fresh]),
                np.hstack([spent[active], np.zeros(wave.shape, bool)]), beam,
            )
            nodes[active], score[active], spent[active] = merged
        return nodes, score

    @staticmethod
    def _best(nodes, score, spent, beam):
        if nodes.shape[1] < beam:
            more = ((0, 0), (0, beam - nodes.shape[1]))
            nodes, score, spent = np.pad(nodes, more, constant_values=-1), np.pad(score, more, constant_values=-2), np.pad(spent, more)
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        return (np.take_along_axis(x, order, 1) for x in (nodes, np.asarray(score, np.float32), spent))

    def search(self, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of each query by descent through the layers there are, and their cosines."""
        nodes = self.layers[-1][0]
        near = query @ self.vectors[nodes].T
        order = np.argsort(-near, axis=1)[:, :beam]
        found, score = nodes[order], np.take_along_axis(near, order, 1)
        for level in range(len(self.layers) - 2, -1, -1):
            entry = np.where(found >= 0, found, found[:, :1])[:, :ENTRIES]
            found, score = self._beam(query, entry, self.layers[level][1], beam if level == 0 else max(ENTRIES, beam // 2))
        return found, score

    def links(self, query: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows ``(query number, vector)`` of all pairs with a cosine of at least the threshold, in bounded chunks.

        The beam doubles for queries whose beam is full of leaders within reach,
        and for the whole block while any audited query recalls less than
        ``RECALL`` of its own links. Beyond ``WIDEST`` all leaders are compared.
        Queries near a large part of the shard are compared with all of it, by
        matrix products of a few queries at a time.
        """
        reach = np.cos(min(np.arccos(min(threshold, 1)) + np.arccos(RADIUS), np.pi)) - 1e-4
        for begin in range(0, len(query), BLOCK):
            part = query[begin : begin + BLOCK]
            fast = part.astype(np.float32)
            left, beam = np.arange(len(part)), BEAM
            audited = np.linspace(0, len(part) - 1, min(AUDITED, len(part))).astype(int)
            true = (part[audited] @ self.exact.T >= threshold).sum(1)
            while len(left):
                every = beam > WIDEST or beam >= len(self.vectors) or len(self.layers) == 1
                line, leader, full, many = self._within(fast[left], reach) if every else self._near(fast[left], beam, reach)
                sure = list(self._verified(part[left], line, leader, threshold))
                hits = np.zeros(len(part), np.int64)
                for line, _ in sure:
                    hits += np.bincount(left[line], minlength=len(part))
                judged = np.isin(audited, left[~full & ~many])
                if not every and (hits[audited] < RECALL * true)[judged].any():
                    beam *= 2
                    continue
                for line, node in sure:
                    yield begin + left[line], node
                few = max(1, CELLS // len(self.exact))
                for k in range(0, int(many.sum()), few):
                    these = left[many][k : k + few]
                    line, node = np.nonzero(part[these] @ self.exact.T >= threshold)
                    yield begin + these[line], node
                left = left[full & ~many]
                beam *= 2

    def _near(self, fast: np.ndarray, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaders within reach that a search finds, as ``(query, leader)``; queries with a full beam, and near much of the shard.

        Neither of these have rows.
        """
        found, score = self.search(fast, beam)
        near = (found >= 0) & (score >= reach)
        full, many = near[:, -1], np.where(near, self.size[found], 0).sum(1) > len(self.exact) // DENSE
        line, column = np.nonzero(near & ~(full | many)[:, None])
        return line, found[line, column], full, many

    def _within(self, fast: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``_near``, of all leaders, for a few queries at a time; no beam is full."""
        lines, leaders, many = [], [], np.zeros(len(fast), bool)
        few = max(1, CELLS // len(self.vectors))
        for k in range(0, len(fast), few):
            near = fast[k : k + few] @ self.vectors.T >= reach
            many[k : k + few] = [self.size[row].sum() > len(self.exact) // DENSE for row in near]
            line, leader = np.nonzero(near & ~many[k : k + few, None])
            lines.append(k + line)
            leaders.append(leader)
        return np.concatenate(lines), np.concatenate(leaders), np.zeros(len(fast), bool), many

    def _verified(self, part: np.ndarray, line: np.ndarray, leader: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows ``(query, vector)`` that reach the threshold, of the vectors that hang on the leaders."""
        ends = np.cumsum(self.size[leader])
        total, step = int(ends[-1]) if len(ends) else 0, max(1, CELLS // part.shape[1])
        for k in range(0, total, step):
            row = np.arange(k, min(k + step, total))
            at = np.searchsorted(ends, row, side="right")
            node = self.member[self.start[leader[at]] + row - (ends[at] - self.size[leader[at]])]
            sure = np.einsum("kd,kd->k", part[line[at]], self.exact[node]) >= threshold
            yield line[at][sure], node[sure]


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and these as unit vectors in double precision.

    Null and zero vectors, those with null or non-finite components, and those
    whose size differs from the most common size of the column do not.
    """
    sizes = np.array([-1 if s is None else s for s in column.value_lengths().to_pylist()], np.int64)
    if not len(sizes) or sizes.max() < 1:
        return np.zeros(len(sizes), bool), np.zeros((0, 1))
    width = np.bincount(sizes[sizes > 0]).argmax()
    good = sizes == width
    rows = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    peak = np.abs(rows).max(1)
    fine = np.isfinite(peak) & (peak > 0)
    good[good] = fine
    rows = rows[fine] / peak[fine, None]
    return good, rows / np.linalg.norm(rows, axis=1)[:, None]


class _Forest:
    """Which of ``size`` nodes are joined so far; nodes that are have the same label."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def joining(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the edges that join two parts not yet joined."""
        apart = np.flatnonzero(self.label[a] != self.label[b])
        if not len(apart):
            return apart
        names, at = np.unique(np.concatenate([self.label[a[apart]], self.label[b[apart]]]), return_inverse=True)
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kept = []
        for k, (x, y) in enumerate(zip(at[: len(apart)].tolist(), at[len(apart) :].tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
        now = np.arange(len(self.label))
        now[names] = names[[root(k) for k in range(len(names))]]
        self.label = now[self.label]
        return apart[kept]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    Equal vectors are one class, of which one is searched; a link between
    classes counts for all members. Vectors that do not count (see
    ``unit_rows``) link with nothing, and vectors of another dimension not with
    each other. Null ids link with nothing either and have a null component.
    Rows that repeat an id and vector are copies of each other; several vectors
    under one id have links of their own and one component. Other columns are ignored.

    Every dimension has shards of its own. Shuffled are each shard's graph once
    per block of searches and each vector once per shard of its dimension. Of a
    block's links only their numbers per vector and a spanning forest leave the task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists("v", lambda x: x != 0)
    digest = F.sha2(F.to_binary(F.to_json("v"), F.lit("utf-8")), 256)
    rows = rows.withColumn("same", F.when(usable, digest))
    known = rows.filter("same IS NOT NULL")
    classes = materialized(known.groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    # A class is named by its smallest id; where several vectors share that, all but one get a number above all ids.
    owner = classes.groupBy("first").agg(F.min("same").alias("owner"))
    spare = F.lit(1 << 62) + F.monotonically_increasing_id()
    named = materialized(
        classes.join(owner, "first")
        .select("same", "first", "copies", F.when(F.col("same") == F.col("owner"), F.col("first")).otherwise(spare).alias("class"))
    )
    searched = known.join(named.select("same", F.col("first").alias("id"), "class", "copies"), ["same", "id"])
    searched = materialized(
        searched.groupBy("class", "copies").agg(F.first("v").alias("v")).withColumn("width", F.size("v"))
    )
    sizes = searched.groupBy("width").count().collect()  # a row per dimension
    dealt = [
        (r["width"], max(1, min(LEAST_SHARDS, r["count"] // LEAST_ROWS), -(-r["count"] // shard_rows)), -(-r["count"] // shard_rows))
        for r in sizes
    ]
    plan = F.broadcast(spark.createDataFrame(dealt or [(0, 1, 1)], "width int, shards int, chunks int"))
    planned = searched.join(plan, "width")

    def build(group: pa.Table) -> pa.Table:
        good, unit = unit_rows(group.column("v").combine_chunks())
        ids = group.column("class").to_numpy()[good]
        order = np.argsort(ids)
        body = pickle.dumps((Graph(unit[order], ids[order]), group.column("copies").to_numpy()[good][order]))
        return pa.table({
            "width": group.column("width")[:1], "shard": group.column("shard")[:1], "chunks": group.column("chunks")[:1],
            "graph": pa.array([body], pa.binary()),
        })

    own_shard = F.pmod(F.xxhash64("class"), F.col("shards")).cast("int")
    graphs = planned.withColumn("shard", own_shard).groupBy("width", "shard").applyInArrow(
        build, "width int, shard int, chunks int, graph binary"
    )
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = planned.select(
        "width", numbers("shards").alias("shard"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(None).cast("binary").alias("graph"), F.col("class").alias("id"), "v",
    )
    given = graphs.select(
        "width", "shard", numbers("chunks").alias("chunk"), "graph",
        F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<double>").alias("v"),
    )
    tasks = max(1, sum(shards * chunks for _, shards, chunks in dealt))
    work = given.unionByName(asked).repartition(tasks, "width", "shard", "chunk")
    work = work.sortWithinPartitions("width", "shard", "chunk", F.col("id").asc_nulls_first())

    def search(batches):
        held = graph = copies = None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("width", "shard", "chunk")])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for first, last in zip([0, *edges], [*edges, len(keys)], strict=True):
                part, key = batch.slice(first, last - first), keys[first].tolist()
                if key != held:
                    held, graph = key, None  # a shard without vectors has no graph
                if part.num_rows and part.column("graph")[0].is_valid:
                    graph, copies = pickle.loads(part.column("graph")[0].as_py())
                    part = part.slice(1)
                if part.num_rows and graph is not None:
                    yield from _found(graph, copies, part, threshold)

    found = materialized(work.mapInArrow(search, "a bigint, b bigint, n bigint"))
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    # The classes of an id's vectors are joined.
    member = materialized(known.select("id", "same").distinct().join(named, "same"))
    several = member.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("last")).filter("b <> last")
    joined = member.join(several.select("id", "b"), "id").filter("class <> b").select(F.col("class").alias("a"), "b")
    near = components(found.filter("b IS NOT NULL").select("a", "b").unionByName(joined))
    result = member.join(counts.withColumnRenamed("a", "class"), "class", "left").join(near.withColumnRenamed("node", "class"), "class", "left")
    result = result.select(
        F.col("id").alias("_key"), F.col("same").alias("_same"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "first").alias("component"),
    )
    own = F.col("_id")
    out = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec_id).cast("bigint").alias("_id"), F.col(embedding).cast("array<double>").alias("v"))
    out = out.withColumn("_vector", F.when(F.col("_id").isNotNull() & F.col("v").isNotNull(), digest)).drop("v")
    out = out.join(result, (own == F.col("_key")) & (F.col("_vector") == F.col("_same")), "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", own).alias("component_id"),
        F.coalesce(F.coalesce("component", own) == own, F.lit(True)).alias("kept"),
    )


def _found(graph: Graph, copies: np.ndarray, part: pa.RecordBatch, threshold: float):
    """Rows of one batch of searches: ``(a, null, links of a here)`` and the edges ``(a, b, null)`` of a forest."""
    _, unit = unit_rows(part.column("v"))
    ids = part.column("id").to_numpy()
    names = np.union1d(ids, graph.ids)
    a_at, b_at = np.searchsorted(names, ids), np.searchsorted(names, graph.ids)
    forest, links = _Forest(len(names)), np.zeros(len(ids), np.int64)
    for line, node in graph.links(unit, threshold):
        other = ids[line] != graph.ids[node]
        line, node = line[other], node[other]
        links += np.bincount(line, copies[node], len(ids)).astype(np.int64)
        keep = forest.joining(a_at[line], b_at[node])
        if len(keep):
            yield pa.record_batch({
                "a": pa.array(ids[line[keep]]), "b": pa.array(graph.ids[node[keep]], pa.int64()),
                "n": pa.nulls(len(keep), pa.int64()),
            })
    some = np.flatnonzero(links)
    yield pa.record_batch({
        "a": pa.array(ids[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(links[some], pa.int64()),
    })
