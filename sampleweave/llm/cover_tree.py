"""Exact top-k by inner product: dual-tree search over cover trees.

Components become integers, floor(scale * x). Queries are taken in blocks of about BLOCK, one after the other: a block is
collected, indexed by a cover tree and broadcast, a pass over the table answers it, and its answers are written before the
next block is fetched, so the driver holds one block at any time. A task builds a
cover tree over each SHARD rows that it reads and walks both trees together: a pair of nodes whose greatest possible
inner product, from the centres and the covering radii, is below the worst kth score of the node's queries is pruned.
Pairs of leaves that are left are matrix products, in single precision where that is exact. kth scores start from a
bounded sample of rows and carry over from shard to shard. A task sends what is still in its
lists, at most k rows for a query; a window per query, limited before its shuffle, merges them.

A node keeps at most FAN children; rows go to the nearest, in reach or not, and radii are measured, so the bounds hold.
Rows of equal vectors stand as one point with its smallest k + 1 ids, which is all that can count.

Cases: a null vec_id, and a vector that is null or holds null or non-finite components, takes no part; an empty vector
scores 0 with all; shorter vectors are filled with zeros; rows that share a vec_id count as one with its best score,
and a repeated query is asked once, by its smallest vector; ties go to the smaller vec_id; fewer rows than k give fewer
ranks; columns other than vec_id and embedding are not read. Scores must stay below 2**53 in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.llm.shared import new_path, own_columns, written

BLOCK = 32768
SHARD = 32768
SAMPLE = 16384
LEAF = 1024
FAN = 48
PICK = 2048
DEPTH = 16
GROUP = 1024
PRODUCT = 1024


@dataclass
class Node:
    """Points (places) within radius of a centre."""

    centre: np.ndarray
    norm: float
    radius: float
    places: np.ndarray
    children: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.centres = np.array([c.centre for c in self.children])
        self.norms, self.radii = np.array([c.norm for c in self.children]), np.array([c.radius for c in self.children])

    def nodes(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.nodes()


def most_square(points: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", points, points, dtype=np.float64).max(initial=0.0))


def as_exact(points: np.ndarray, largest: float) -> np.ndarray:
    """In single precision, twice as fast, where no sum of products exceeds largest < 2**24: all of its integers are exact."""
    return points.astype(np.float32 if largest < 1 << 24 else np.float64, copy=False)


def cover_tree(points: np.ndarray) -> Node:
    """The root over all points. A node's children are centres more than half its radius apart, picked among at most PICK of its
    points and the farthest, each with the points that are nearest to it. A node of LEAF points, or at DEPTH, is a leaf."""
    most = most_square(points)
    points = as_exact(points, 4 * most)
    square = np.einsum("ij,ij->i", points, points)
    blur = 4 * np.sqrt(most * np.finfo(np.float64).eps)  # of a distance, where squares exceed what is exact

    def distance(places: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, square[places][:, None] + square[centres] - 2 * (points[places] @ points[centres].T)))

    def made(places: np.ndarray, centre: int, d: np.ndarray, depth: int) -> Node:
        children, farthest = [], int(d.argmax())
        if len(places) > LEAF and depth < DEPTH and d[farthest] > 0:
            centres, scale, fan = [centre, int(places[farthest])], d[farthest] / 2, min(FAN, max(2, 2 * len(places) // LEAF))
            some = places[:: -(-len(places) // PICK)]
            best = distance(some, np.array(centres)).min(axis=1)
            while len(centres) < fan and best.max() > scale:
                centres.append(int(some[best.argmax()]))
                best = np.minimum(best, distance(some, np.array(centres[-1:]))[:, 0])
            nearest, away = np.empty(len(places), np.int64), np.empty(len(places))
            for at in range(0, len(places), PICK):
                all_of = distance(places[at : at + PICK], np.array(centres))
                nearest[at : at + PICK], away[at : at + PICK] = all_of.argmin(axis=1), all_of.min(axis=1)
            parts = [(c, nearest == i) for i, c in enumerate(centres) if (nearest == i).any()]
            if len(parts) > 1:
                children = [made(places[own], c, away[own], depth + 1) for c, own in parts]
        return Node(points[centre].astype(np.float64), float(np.sqrt(square[centre])), float(d[farthest]) * (1 + 1e-6) + blur, places, children)

    every, first = np.arange(len(points)), int(square.argmin())
    return made(every, first, distance(every, np.array([first]))[:, 0], 0)


class Best:
    """For each query of a block its best scores so far with their ids, and the score below which nothing counts."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = np.asarray(ids), k, least.astype(np.float64)
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.scores[q, -1], self.found[q, -1]
        counts = (ids != self.ids[q]) & (scores >= self.least[q]) & ((scores > last) | (ids < last_id) | np.isneginf(last))
        if counts.any():
            self.waiting.append((q[counts], scores[counts], ids[counts]))

    def held_back(self) -> int:
        return sum(len(q) for q, _, _ in self.waiting)

    def settle(self) -> None:
        """What was offered goes into the lists: of a row's id the best score, by score, then id."""
        if not self.waiting:
            return
        q, scores, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting = []
        asked, at = np.unique(q, return_inverse=True)
        old = np.nonzero(self.scores[asked] > -np.inf)
        at = np.concatenate([at.reshape(-1), old[0]])
        scores, ids = np.concatenate([scores, self.scores[asked][old]]), np.concatenate([ids, self.found[asked][old]])
        order = np.lexsort((-scores, ids, at))
        at, scores, ids = at[order], scores[order], ids[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]
        at, scores, ids = at[new], scores[new], ids[new]
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        best, found = np.full((len(asked), self.k), -np.inf), np.zeros((len(asked), self.k), np.int64)
        best[at[kept], rank[kept]], found[at[kept], rank[kept]] = scores[kept], ids[kept]
        self.scores[asked], self.found[asked] = best, found
        self.least[asked] = np.maximum(self.least[asked], best[:, -1])


def bounds(node: Node, family: Node) -> np.ndarray:
    """No inner product of a point of node and one of a child of family is higher."""
    reach = (node.norm + node.radius) * (family.norms + family.radii)
    return family.centres @ node.centre + node.radius * family.norms + family.radii * node.norm + node.radius * family.radii + 1e-3 + 1e-12 * reach


def few_true(mask: np.ndarray) -> np.ndarray:
    """The places of a flat mask that are true, read by eight as few are."""
    whole = len(mask) // 8 * 8
    near = (np.flatnonzero(mask[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([near[mask[near]], whole + np.flatnonzero(mask[whole:])])


def near_leaves(query_root: Node, point_root: Node, least: np.ndarray) -> list[tuple[Node, list[tuple[float, Node]]]]:
    """Both trees walked together: each leaf of queries with the leaves of points that can still count, and their bounds."""
    worst = {id(q): float(least[q.places].min()) for q in query_root.nodes()}
    near: dict[int, tuple[Node, list[tuple[float, Node]]]] = {}
    stack = [(query_root, point_root, np.inf)]
    while stack:
        q, p, bound = stack.pop()
        if not q.children and not p.children:
            near.setdefault(id(q), (q, []))[1].append((bound, p))
        elif q.children and (not p.children or q.radius > p.radius):
            stack += [(c, p, b) for c, b in zip(q.children, bounds(p, q).tolist(), strict=True) if b >= worst[id(c)]]
        else:
            stack += [(q, c, b) for c, b in zip(p.children, bounds(q, p).tolist(), strict=True) if b >= worst[id(q)]]
    return list(near.values())


def search(queries: np.ndarray, query_root: Node, points: np.ndarray, ids: list[list[int]], best: Best) -> int:
    """Offers every point that can still count to its queries; how many inner products were computed.

    A leaf of queries goes through its leaves of points from the highest bound on, PRODUCT points to a matrix product, until
    no bound reaches its worst kth score.
    """
    largest = np.sqrt(most_square(queries) * most_square(points))
    queries, points = as_exact(queries, largest), as_exact(points, largest)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, starts = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes
    room = np.empty(GROUP * PRODUCT, queries.dtype)
    work = 0

    def multiplied(group: np.ndarray, asked: np.ndarray, places: np.ndarray) -> int:
        scores = np.matmul(asked, points[places].T, out=room[: len(group) * len(places)].reshape(len(group), len(places)))
        hit = np.flatnonzero(scores.max(axis=1) >= best.least[group].astype(scores.dtype))
        few = max(1, (1 << 18) // len(places))
        for at in range(0, len(hit), few):
            rows = hit[at : at + few]
            of = scores[rows]
            a, b = np.divmod(few_true((of >= best.least[group[rows]].astype(of.dtype)[:, None]).reshape(-1)), len(places))
            n = sizes[places[b]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            best.offer(np.repeat(group[rows[a]], n), np.repeat(of[a, b].astype(np.float64), n), flat[np.repeat(starts[places[b]], n) + nth])
            if best.held_back() > 8 * len(group):
                best.settle()
        return scores.size

    for q, near in near_leaves(query_root, cover_tree(points), best.least):
        near.sort(key=lambda x: -x[0])
        places = np.concatenate([p.places for _, p in near])
        bound = np.repeat([b for b, _ in near], [len(p.places) for _, p in near])
        for first in range(0, len(q.places), GROUP):
            group, done, step = q.places[first : first + GROUP], 0, PRODUCT
            asked = queries[group]
            while done < len(places):
                worst = best.least[group].min()
                if bound[done] < worst:
                    break
                # without a kth score everything counts: a few points first
                step = max(2 * best.k, PRODUCT // 64) if np.isneginf(worst) else min(PRODUCT, 2 * step)
                now = places[done : done + step][bound[done : done + step] >= worst]
                work += multiplied(group, asked, now)
                if np.isneginf(worst):
                    best.settle()
                done += step
            best.settle()
    return work


def quantised(column: pa.Array, scale: int, size: int) -> np.ndarray:
    """Rows of integers, held as doubles."""
    out = np.zeros((len(column), size))
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0  # no negative zeros
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out[np.arange(size)[None, :] < lengths[:, None]] = flat
    return out


def condensed(points: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[list[int]]]:
    """Different points, each with its smallest ids. Equal ones meet by a key of their integers and are compared in full."""
    mix = np.random.default_rng(5).integers(1, 1 << 62, points.shape[1], np.int64) | 1
    key = points.astype(np.int64) @ mix
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    same = np.r_[False, key[1:] == key[:-1]]
    at = np.flatnonzero(same)
    same[at] = (points[order[at]] == points[order[at - 1]]).all(axis=1)
    kept = ~(same & np.r_[False, ids[1:] == ids[:-1]])
    starts = np.flatnonzero(~same[kept])
    flat, order = ids[kept].tolist(), order[kept]
    ends = np.r_[starts[1:], len(flat)]
    return points[order[starts]], [flat[a : min(b, a + most)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own_columns(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k highest integer inner products among all other rows."""
    rows = usable(vectors)
    asked = written(usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "queries")
    n, size = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    total, longest = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    if not n or not total:
        return spark.createDataFrame([], empty)
    size = max(size, longest, 1)
    share = int(min(1.0, 1.2 * SAMPLE / total) * (1 << 20))
    seen = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < share).limit(SAMPLE).toArrow()
    sample, sample_ids = quantised(seen["embedding"].combine_chunks(), scale, size), seen["vec_id"].to_numpy()
    blocks = -(-n // BLOCK)
    answers = new_path(spark, "answers")
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id", F.lit(4)), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            found = answered(rows, block, sample, sample_ids, k, scale, size).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            best.write.mode("append").parquet(answers)
    return spark.read.schema(empty).parquet(answers)


def answered(rows: DataFrame, block: pa.Table, sample: np.ndarray, sample_ids: np.ndarray, k: int, scale: int, size: int) -> DataFrame:
    """One block's candidates from every task: query_id, vec_id, score."""
    queries, ids = quantised(block["embedding"].combine_chunks(), scale, size), block["query_id"].to_numpy()
    least = np.full(len(ids), -np.inf)
    sample_ids, once = np.unique(sample_ids, return_index=True)
    most = most_square(queries)
    if len(once) > k:  # each id once, so the kth of the sample bounds the kth of all
        largest = np.sqrt(most * most_square(sample))
        asked, seen = as_exact(queries, largest), as_exact(sample[once], largest)
        for at in range(0, len(ids), 512):
            scores = asked[at : at + 512] @ seen.T
            scores[ids[at : at + 512][:, None] == sample_ids[None, :]] = -np.inf
            least[at : at + 512] = np.partition(scores, -k, axis=1)[:, -k]

    queries = as_exact(queries, most)
    root = cover_tree(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, k, least)
        held, held_ids, waiting = [], [], 0

        def flush() -> None:
            points, own = condensed(np.concatenate(held), np.concatenate(held_ids), k + 1)
            search(queries, root, points, own, best)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                held.append(quantised(batch.column(1), scale, size))
                held_ids.append(batch.column(0).to_numpy())
                waiting += batch.num_rows
                if waiting >= SHARD:
                    flush()
                    held, held_ids, waiting = [], [], 0
        if waiting:
            flush()
        q, rank = np.nonzero((best.scores > -np.inf) & (best.scores >= best.least[:, None]))
        columns = ids[q], best.found[q, rank], best.scores[q, rank].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")
