"""Exact top-k inner products by dual-tree search: cover trees over queries and data, pruned pair by pair."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, staged, table

#: Rows from which the shared top level of the trees is chosen, and its number of cells. Both are fixed.
SAMPLE, CELLS = 2048, 32

#: Rows of one data tree and of one query group; a cell with more rows has several.
BLOCK, GROUP = 4096, 512

#: Children of a node and rows of a leaf at most; a leaf of equal rows may be larger.
FAN, LEAF = 8, 32

_LONGEST = (1 << 63) - 1


def farthest_first(points: np.ndarray, first: int, most: int, until: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres picked farthest first until all points lie within ``until`` of one or there are ``most``.

    Returns the centres, and for each point its nearest centre and the distance. The centres lie at least as far from
    each other as the farthest point from its centre: cover tree levels are made of such centres.
    """
    near = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    centres, owner = [first], np.zeros(len(points), dtype=np.int64)
    while len(centres) < most and near.max() > until:
        far = int(near.argmax())
        dist = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = dist < near
        owner[closer], near = len(centres), np.minimum(dist, near)
        centres.append(far)
    return centres, owner, near


@dataclass
class CoverTree:
    """A cover tree. Rows lie in leaf order; node ``i`` holds rows ``lo[i]`` to ``hi[i]`` within ``radius[i]`` of its
    centre, which is one of them, and its children are nodes ``child[i]`` to ``child[i] + children[i]``."""

    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> CoverTree:
        points = rows.astype(np.float64)
        # Nodes level by level; each level's nodes are dealt the rows of their parents.
        nodes = [[0, 0.0, np.arange(len(ids)), -1, 0]]
        at = 0
        while at < len(nodes):
            node = nodes[at]
            members = node[2]
            own = points[members]
            first = int(np.flatnonzero(members == node[0])[0])
            dist = np.sqrt(((own - own[first]) ** 2).sum(axis=1))
            node[1] = float(dist.max())
            if len(members) > LEAF and node[1] > 0:
                centres, owner, _ = farthest_first(own, first, FAN, node[1] / 2)
                node[3], node[4] = len(nodes), len(centres)
                nodes += [[int(members[c]), 0.0, members[owner == i], -1, 0] for i, c in enumerate(centres)]
            at += 1
        lo, hi = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        order: list[np.ndarray] = []
        done, todo = 0, [(0, False)]
        while todo:
            i, closing = todo.pop()
            if closing:
                hi[i] = done
                continue
            lo[i] = done
            if nodes[i][4]:
                todo.append((i, True))
                todo += [(c, False) for c in range(nodes[i][3], nodes[i][3] + nodes[i][4])]
            else:
                order.append(nodes[i][2])
                done += len(nodes[i][2])
                hi[i] = done
        place = np.concatenate(order)
        return cls(
            ids[place], rows[place], points[[n[0] for n in nodes]], np.array([n[1] for n in nodes]), lo, hi,
            np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]),
        )


def _even(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one, filled up with zeros."""
    width = max(left.shape[1], right.shape[1])
    return np.pad(left, ((0, 0), (0, width - left.shape[1]))), np.pad(right, ((0, 0), (0, width - right.shape[1])))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; beyond the range of a long they are held at its ends."""
    left, right = _even(left, right)
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (left, right)]
    if top[0] * top[1] * left.shape[1] < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return np.clip(left.astype(object) @ right.astype(object).T, -_LONGEST - 1, _LONGEST).astype(np.int64)


def bounds(centre: np.ndarray, radius: float, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No product of a row within ``radius`` of ``centre`` and one within ``radii`` of ``centres`` is larger than this."""
    (centre,), centres = _even(centre[None], centres)
    own, other = float(np.sqrt(centre @ centre)), np.sqrt((centres * centres).sum(axis=1))
    # The last terms are far above the rounding of the others.
    return centres @ centre + radius * other + radii * own + radius * radii + 1e-9 * (own + radius) * (other + radii) + 1e-6


@dataclass
class QueryGroup:
    """A tree of queries and the best candidates of each so far, best first; ``filled`` tells how many there are."""

    tree: CoverTree
    scores: np.ndarray
    found: np.ndarray
    filled: np.ndarray

    @classmethod
    def of(cls, tree: CoverTree, k: int) -> QueryGroup:
        shape = (len(tree.ids), k)
        return cls(tree, np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(len(tree.ids), np.int64))

    def worst(self, node: int) -> float:
        """The lowest kth score of the node's queries."""
        lo, hi = self.tree.lo[node], self.tree.hi[node]
        if (self.filled[lo:hi] < self.scores.shape[1]).any():
            return -np.inf
        return float(self.scores[lo:hi, -1].min())

    def offer(self, node: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """Hold the node's queries against all of ``rows``."""
        lo, hi, k = self.tree.lo[node], self.tree.hi[node], self.scores.shape[1]
        scores = products(self.tree.rows[lo:hi], rows)
        for i, own in zip(range(lo, hi), scores):
            n = self.filled[i]
            fit = ids != self.tree.ids[i]
            if n == k:
                fit &= own >= self.scores[i, -1]
            if not fit.any():
                continue
            score, name = np.concatenate([self.scores[i, :n], own[fit]]), np.concatenate([self.found[i, :n], ids[fit]])
            best = _best(score, name, k)
            self.filled[i] = len(best)
            self.scores[i, : len(best)], self.found[i, : len(best)] = score[best], name[best]

    def search(self, data: CoverTree) -> None:
        """Go down both trees together; a pair whose bound is below the queries' worst kth score is left out."""
        todo = [(0, np.array([0]))]
        while todo:
            q, nodes = todo.pop()
            tree = self.tree
            limit = bounds(tree.centre[q], tree.radius[q], data.centre[nodes], data.radius[nodes])
            stays = limit >= self.worst(q)
            nodes, limit = nodes[stays], limit[stays]
            if not len(nodes):
                continue
            leaves = data.children[nodes] == 0
            if leaves.all() and not tree.children[q]:
                order = np.argsort(-limit)
                for part in (order[:4], order[4:]):
                    part = part[limit[part] >= self.worst(q)]
                    if len(part):
                        rows = np.concatenate([np.arange(data.lo[n], data.hi[n]) for n in nodes[part]])
                        self.offer(q, data.ids[rows], data.rows[rows])
                continue
            deeper = np.concatenate([nodes[leaves], *(
                np.arange(data.child[n], data.child[n] + data.children[n]) for n in nodes[~leaves]
            )])
            if tree.children[q]:
                todo += [(c, deeper) for c in range(tree.child[q], tree.child[q] + tree.children[q])]
            else:
                todo.append((q, deeper))


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest scores, best first; of equal ones the smaller names."""
    order = np.argsort(names, kind="stable")
    # Bitwise complement turns the order of integers around without overflow.
    return order[np.argsort(~scores[order], kind="stable")][:k]


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id`` and the integer vector ``v`` of the rows that take part, one for each id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * scale))
    return rows.where(finite).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer rows of a list column; shorter ones are filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows with the highest inner product for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components become ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own; ties go to the smaller id. Queries with fewer candidates get all. Rows with a null id, a
    null vector or one with a null or non-finite component take no part; of several rows with one id the smallest
    vector counts; vectors of different lengths are compared as if the shorter ended in zeros.

    Queries and data share the top level, cells around centres picked farthest first from a bounded sample. Below it
    every block of rows and every group of queries has a cover tree. A group is first searched in a block of its own
    cell. The kth scores found there rule out whole cells, then blocks, then nodes by their covering radii.
    """
    context = vectors.sparkSession.sparkContext
    rows = staged(usable(vectors, vec_id, vector, scale), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    points = _matrix(sample.column("v").combine_chunks()).astype(np.float64)
    centres = points[farthest_first(points, 0, CELLS, 0.0)[0]] if len(points) else np.zeros((1, 0))
    shared = context.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, there = _even(_matrix(batch.column(1)).astype(np.float64), shared.value)
            # The nearest centre: the rows' own norms make no difference.
            cell = ((there**2).sum(axis=1) - 2 * own @ there.T).argmin(axis=1)
            reach = np.sqrt(((own - there[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(reach)], ["vec_id", "v", "cell", "reach"]
            )

    celled = staged(in_tasks(rows, dealt, "vec_id long, v array<long>, cell int, reach double"), "cells")
    is_query = F.col("vec_id") % every == 0
    # As many rows as there are cells.
    sizes = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max("reach").alias("reach")
    ).orderBy("cell").collect()
    pieces = {r["cell"]: (-(-r["n"] // BLOCK), max(1, -(-r["q"] // GROUP))) for r in sizes}
    balls = context.broadcast([(r["cell"], r["reach"], pieces[r["cell"]][0]) for r in sizes])

    def trees(part: DataFrame, which: int) -> DataFrame:
        number = F.coalesce(*[F.when(F.col("cell") == c, F.lit(p[which])) for c, p in pieces.items()], F.lit(1))
        part = part.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "vec_id"), number).cast("int"))

        def grown(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            tree = CoverTree.build(rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks()))
            return pa.table({"cell": [key[0].as_py()], "piece": [key[1].as_py()], "tree": [pickle.dumps(tree)]}, schema=pa.schema(
                [("cell", pa.int32()), ("piece", pa.int32()), ("tree", pa.binary())]
            ))

        return part.groupBy("cell", "piece").applyInArrow(grown, "cell int, piece int, tree binary")

    blocks = staged(trees(celled, 0), "blocks")
    groups = trees(celled.where(is_query), 1)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order block, groups, block, groups: a group is searched in the block before it."""
        block = None
        for batch in batches:
            for cell, kind, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if kind == 0:
                    block = pickle.loads(blob)
                    continue
                group = pickle.loads(blob)
                group = group if isinstance(group, QueryGroup) else QueryGroup.of(group, k)
                before = group.found.copy(), group.filled.copy()
                group.search(block)
                changed = kind == 1 or (before[0] != group.found).any() or (before[1] != group.filled).any()
                if changed:
                    columns = [pa.array([cell], pa.int32()), pa.array([pickle.dumps(group)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "found"])

    def met(pairs: DataFrame, kind: int) -> DataFrame:
        """``pairs`` of a group (``tree``) with the block it is to be searched in (``cell``, ``piece``)."""
        both = blocks.select("cell", "piece", F.lit(0).alias("kind"), "tree").unionByName(
            pairs.select("cell", "piece", F.lit(kind).alias("kind"), "tree")
        )
        ordered = both.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind")
        return in_tasks(ordered.select("cell", "piece", "kind", "tree"), searched, "cell int, found binary")

    seeded = staged(met(groups.select("cell", F.lit(0).alias("piece"), "tree"), 1), "seeded")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group once for every other block of the cells that its kth scores do not rule out."""
        cells = np.array([c for c, _, _ in balls.value], dtype=np.int64)
        radii = np.array([r for _, r, _ in balls.value])
        for batch in batches:
            for home, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = pickle.loads(blob)
                limit = bounds(group.tree.centre[0], group.tree.radius[0], shared.value[cells], radii)
                for (cell, _, count), stays in zip(balls.value, limit >= group.worst(0)):
                    places = [(cell, piece) for piece in range(count) if stays and (cell, piece) != (home, 0)]
                    for cell, piece in places:
                        columns = [pa.array([cell], pa.int32()), pa.array([piece], pa.int32()), pa.array([blob], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "piece", "tree"])

    further = met(in_tasks(seeded, elsewhere, "cell int, piece int, tree binary"), 2)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                group = pickle.loads(blob)
                there = np.arange(group.scores.shape[1]) < group.filled[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(group.tree.ids, group.filled)), pa.array(group.found[there]), pa.array(group.scores[there])],
                    ["query_id", "vec_id", "score"],
                )

    found = in_tasks(seeded.unionByName(further), listed, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k_search(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))
