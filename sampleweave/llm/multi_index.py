"""Near-duplicate embeddings over an inverted multi-index, with exact verification.

Rows with equal labels and vectors form a class with a count. Unit vectors are cut in halves; a codebook of each half,
fitted on a bounded sample, makes a grid of cells, and every class is posted in its cell. A class then visits cells in
order of the sum of its halves' squared distances to the codewords (a heap walks the two sorted lists), until that sum
exceeds the least by a slack fitted to TARGET recall at the similarity limit itself, on vectors that the codebooks were not
fitted on, where there are enough. Visitors meet the cell's own
classes; a pair counts if its cosine in double precision reaches the limit. What a cell gives is each class's number of
links and a spanning forest of them, never its pairs. A pair that finds itself from both ends counts at one of them.

A cell with more than MOST classes or visitors is dealt to blocks of each, and each pair of blocks of classes, and of a
block of classes and one of visitors, is a group of its own.

Cases: a null label or vec_id, and a vector that is null, zero, or holds null or non-finite components, links with
nothing (component_id is the row's own vec_id); vectors of different lengths compare as if filled with zeros; repeated
rows count as different vectors; an empty table gives no row; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.shared import components, own_columns, written
from sampleweave.llm.simhash import joined, settled

SAMPLE = 4096  #: most vectors on which codebooks and slack are fitted
HOMES = 64  #: classes of a cell, about
CODES = 256  #: most codewords of a half
TARGET = 0.98  #: share of pairs at the limit that the visits shall find
MOST = 4096  #: classes of a block


@dataclass
class Index:
    """Two codebooks and the slack of visits."""

    left: np.ndarray
    right: np.ndarray
    slack: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return squared(unit[:, :half], self.left), squared(unit[:, half:], self.right)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, unit: np.ndarray) -> list[list[int]]:
        """For each vector its cells, nearest first."""
        a, b = self.distances(unit)
        i, j = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, i, 1).tolist(), np.take_along_axis(b, j, 1).tolist()
        width = len(self.right)
        return [[p * width + q for p, q in traversed(x, y, u, v, self.slack)] for x, y, u, v in zip(a, b, i.tolist(), j.tolist(), strict=True)]


def traversed(a: list[float], b: list[float], i: list[int], j: list[int], slack: float) -> Iterator[tuple[int, int]]:
    """The multi-sequence walk over two ascending lists: pairs in order of their sum, until it exceeds the least by slack."""
    most = a[0] + b[0] + slack
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        total, x, y = heapq.heappop(heap)
        if total > most:
            return
        yield i[x], j[y]
        for nx, ny in ((x + 1, y), (x, y + 1)):
            if nx < len(a) and ny < len(b) and (nx, ny) not in seen:
                seen.add((nx, ny))
                heapq.heappush(heap, (a[nx] + b[ny], nx, ny))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T)


def codebook(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means by a few rounds from random rows."""
    codes = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(12):
        nearest = squared(x, codes).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, nearest, x)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


def fitted(unit: np.ndarray, k: int, limit: float, target: float = TARGET) -> Index:
    """Codebooks of a sample, and the slack with which visits from a vector find target of partners turned away from it to the limit."""
    draw = np.random.default_rng(0)
    half = unit.shape[1] // 2
    fit, unit = (unit[::2], unit[1::2]) if len(unit) >= max(64, 8 * k) else (unit, unit)
    index = Index(codebook(fit[:, :half], k, draw), codebook(fit[:, half:], k, draw), 0.0)
    other = draw.normal(size=unit.shape)
    other -= (other * unit).sum(axis=1, keepdims=True) * unit
    other /= np.maximum(1e-12, np.linalg.norm(other, axis=1, keepdims=True))
    partner = limit * unit + np.sqrt(1 - limit * limit) * other

    def need(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The slack with which x visits the home of y."""
        home, (a, b) = index.homes(y), index.distances(x)
        return np.take_along_axis(a, home[:, None] // len(index.right), 1)[:, 0] + np.take_along_axis(b, home[:, None] % len(index.right), 1)[:, 0] - a.min(axis=1) - b.min(axis=1)

    # a pair is lost only if neither end visits the other's cell
    index.slack = float(np.quantile(np.minimum(need(unit, partner), need(partner, unit)), target)) + 1e-9
    return index


def unit_rows(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def usable(label, vec_id, vector) -> F.Column:
    """Whether a vector takes part. Its norm in double precision must be a positive number, too."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return label.isNotNull() & vec_id.isNotNull() & vector.isNotNull() & F.coalesce(finite & (length > 0) & (length < float("inf")), F.lit(False))


def cell_links(unit: np.ndarray, label: np.ndarray, count: np.ndarray, home: np.ndarray, own: np.ndarray, visits: list, limit: float, among: bool) -> tuple[np.ndarray, np.ndarray]:
    """Within one group: links of each row by their counts, and a forest over rows. own: at home here (the others visit); among: whether the homes meet each other here."""
    links, parent = np.zeros(len(unit), np.int64), np.arange(len(unit))
    width = 1 + max(int(home.max(initial=0)), max((max(v, default=0) for v in visits), default=0))
    visited = np.array([k * width + cell for k, v in enumerate(visits) if own[k] for cell in v], np.int64)
    homes = np.flatnonzero(own)
    for at in range(0, len(unit), 1024):
        some = np.arange(at, min(at + 1024, len(unit)))
        near = (unit[some] @ unit[homes].T >= limit) & (label[some][:, None] == label[homes][None, :])
        i, j = np.nonzero(near)
        i, j = some[i], homes[j]
        once = np.where(own[i], (i < j) & among, True)
        i, j = i[once], j[once]
        if len(i):
            # both ends visit each other: the one with the smaller home counts it
            back = ~own[i] & (home[i] > home[j])
            back[back] = np.isin(j[back] * width + home[i[back]], visited)
            i, j = i[~back], j[~back]
            np.add.at(links, i, count[j])
            np.add.at(links, j, count[i])
            parent = joined(parent, np.maximum(i, j), np.minimum(i, j))
    return links, settled(parent)


def near_duplicates(vectors: DataFrame, limit: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = own_columns(vectors, "vec_id", "embedding", F.col("label").cast("string").alias("label"))
    fit = usable(F.col("label"), F.col("vec_id"), F.col("embedding"))
    rows = rows.withColumn("fit", fit)
    some = rows.filter("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(some, "classes")
    total, size, labels = classes.agg(F.count("*"), F.max(F.size("embedding")), F.approx_count_distinct("label")).first()
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size += size % 2
    share = int(min(1.0, 1.2 * SAMPLE / total) * (1 << 20))
    sample = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share).select("rep", "embedding").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect() or classes.select("rep", "embedding").limit(1).collect()
    index = fitted(unit_rows([r["embedding"] for r in sample], size), int(np.clip(round(np.sqrt(total / max(1, labels) / HOMES)), 1, min(CODES, len(sample)))), limit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                unit = unit_rows(batch.column(1).slice(at, 2048).to_pylist(), size)
                home, visits = index.homes(unit), index.visits(unit)
                cells = [[h, *(c for c in v if c != h)] for h, v in zip(home.tolist(), visits, strict=True)]
                take = pa.array(np.repeat(np.arange(at, at + len(cells)), [len(c) for c in cells]))
                first = np.concatenate([np.arange(len(c)) == 0 for c in cells])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(cells)), pa.array(first.astype(np.int64))], ["label", "cell", "home"])

    sizes = classes.select("label", "embedding").mapInArrow(place, "label string, cell long, home long").groupBy("label", "cell").agg(F.sum("home").alias("homes"), F.sum(1 - F.col("home")).alias("visitors"))
    # at most a row for each MOST classes or visits
    blocks = {(r["label"], r["cell"]): (-(-r["homes"] // MOST), -(-r["visitors"] // MOST)) for r in sizes.filter((F.col("homes") > MOST) | (F.col("visitors") > MOST)).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                label, vectors, reps, counts = (batch.column(i).to_pylist() for i in range(4))
                unit = unit_rows(vectors, size)
                home = index.homes(unit).tolist()
                visits = index.visits(unit)
                out: list[tuple[int, int, int, int, bool]] = []
                for k in range(len(reps)):
                    for cell in dict.fromkeys([home[k], *visits[k]]):
                        n, v = blocks.get((label[k], cell), (1, 0))
                        key = reps[k] * 0x9E3779B1 % (1 << 32)
                        if cell == home[k]:
                            mine = key % max(1, n)
                            out += [(k, cell, mine, c, False) for c in range(mine + 1, n)] + [(k, cell, c, mine, True) for c in range(mine + 1)] + [(k, cell, n + c, mine, True) for c in range(v)]
                        elif v:
                            out += [(k, cell, n + key % v, c, False) for c in range(n)]
                        else:
                            out.append((k, cell, 0, 0, False))
                take = pa.array([x[0] for x in out])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)), pa.array([x[4] for x in out], pa.bool_()),
                    batch.column(2).take(take), batch.column(3).take(take), pa.array([unit[x[0]].tobytes() for x in out], pa.binary()),
                    pa.array([home[x[0]] for x in out], pa.int64()), pa.array([visits[x[0]] for x in out], pa.list_(pa.int64())),
                ], ["label", "cell", "i", "j", "own", "rep", "n", "unit", "home", "visits"])

    def search(group: pa.Table) -> pa.Table:
        unit = np.frombuffer(b"".join(group["unit"].to_pylist())).reshape(group.num_rows, -1)
        rep, count, home = (group[c].to_numpy() for c in ("rep", "n", "home"))
        own = group["own"].to_numpy(zero_copy_only=False).astype(bool)
        links, parent = cell_links(unit, np.zeros(len(rep), np.int64), count, home, own, [set(v) for v in group["visits"].to_pylist()], limit, group["i"][0] == group["j"][0])
        some = np.flatnonzero(links)
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"a": pa.array([*rep[some], *rep[tied]], pa.int64()), "b": pa.array([*[None] * len(some), *rep[parent[tied]]], pa.int64()), "links": pa.array([*links[some], *[0] * len(tied)], pa.int64())})

    routed = classes.select("label", "embedding", "rep", "n").mapInArrow(route, "label string, cell long, i long, j long, own boolean, rep long, n long, unit binary, home long, visits array<long>")
    found = written(routed.groupBy("label", "cell", "i", "j").applyInArrow(search, "a long, b long, links long"), "links")
    tied = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    known = classes.join(counts, F.col("rep") == F.col("a"), "left").join(tied, F.col("rep") == F.col("node"), "left")
    known = written(known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    linked = rows.filter("fit").join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
