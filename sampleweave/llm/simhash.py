"""SimHash near-duplicates: fingerprints of word shingles, linked over vantage-point trees.

near_duplicates links fingerprints of 64 bits exactly, at a few differing bits: texts that are nearly the same. similar
links texts by a similarity (0.8 of their shingles, say), which leaves more bits apart than any tree can search: it makes
a fingerprint of 3,072 bits, searches each of its 96 parts by a tree of its own at one differing bit, and decides pairs
whose first 1,024 bits are near enough by the shingles that they share.

The different fingerprints are partitioned by a vantage-point tree whose top is fitted on a bounded sample: a node sends
those within a distance of its vantage point to one side, the others to the other. Each fingerprint has one home shard;
where the triangle bound leaves it possible that one on the far side is near enough, a copy visits the shards there, as a
query only. Every shard builds its own tree over its home fingerprints and searches it for homes and visitors, so each
pair within the radius is found. A shard gives the trees (stars) of what it linked, never all pairs. Shards grow with the
table up to LARGEST, for copies grow with the depth of the top; a shard with too many homes or visitors is dealt to
chunks, and each pair of chunks is a group of its own.

Cases of near_duplicates: a null or empty text, or one without words, has fingerprint zero and links like any other;
repeated rows share a fingerprint; a null doc_id gets the component of its fingerprint but lends it no id (null if no row
of it has one), and does not connect different fingerprints; an empty table gives no row; columns other than doc_id and
text are not read. Cases of similar: the same; rows that share a doc_id count as different texts where their texts differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleweave.llm.shared import at_work, components, discard, own_columns, written

SEED = 42
SAMPLE = 1 << 16  #: most fingerprints on which the top of the tree is fitted
SHARD = 1 << 14  #: fingerprints of a shard, about, in tables of up to SHARDS such shards
SHARDS = 256  #: shards that a larger table gets before its shards grow
LARGEST = 1 << 20  #: fingerprints of a shard, about, in the largest tables
MOST = 1 << 16  #: homes or visitors of a chunk, in shards of the smallest size; larger shards have larger chunks
LEAF = 96  #: fingerprints below which a shard's own tree ends
RUN = 1 << 17  #: shingles whose bits are counted at once
WORDS = 48  #: 64-bit words of a long fingerprint; it has twice as many parts
CHECKED = 16  #: words that say whether two long fingerprints are near
PART_SAMPLE = 1 << 14  #: most long fingerprints on which the tops of the parts' trees are fitted
PART_SHARD = 1 << 15  #: rows of a part's shard, about, in tables of up to SHARDS such shards
BLOCK = 1 << 14  #: texts of a block that are compared in one task (a text of over SHINGLES shingles counts for several)
SHINGLES = 256
MEMBERS = 1 << 19  #: most members of loose components that are sent to every executor in place of a shuffle of texts
PAIRS = 1 << 19  #: pairs of rows whose fingerprints are compared at once
STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 of each shingle: ASCII letters lower-cased, words between ASCII white space, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, digest = min(words_per_shingle, len(words)), xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words_per_shingle).astype("<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[at : at + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id, fingerprint (a signed long of the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made = np.array([fingerprint(x, words_per_shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "fingerprint"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


@dataclass
class Node:
    """An inner node: its vantage point and the radius of its near side; or a leaf with its number or its fingerprints."""

    point: np.uint64 = np.uint64(0)
    radius: int = -1
    near: Node | None = None
    far: Node | None = None
    leaf: int = -1
    held: np.ndarray | None = None


def best_split(prints: np.ndarray, reach: int, draw: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius: of a few points, the radius in the middle of its distances with the fewest fingerprints near the border."""
    best = None
    for point in draw.choice(prints, min(6, len(prints)), replace=False):
        count = np.bincount(np.bitwise_count(prints ^ point), minlength=65 + reach)
        within = np.cumsum(count)
        for radius in range(64):
            near = within[radius]
            if not 0.2 <= near / len(prints) <= 0.8:
                continue
            border = within[radius] - (within[radius - reach] if radius >= reach else 0)
            cost = border + abs(near - len(prints) / 2) / 4
            if best is None or cost < best[0]:
                best = (cost, point, radius)
    return best and (best[1], best[2])


def grown(prints: np.ndarray, smallest: int, reach: int, draw: np.random.Generator, leaves: list[Node], keep: bool) -> Node:
    """A tree over fingerprints, down to leaves of about smallest. keep: leaves hold the places of their fingerprints."""

    def grow(places: np.ndarray, depth: int) -> Node:
        own = prints[places]
        split = best_split(own, reach, draw) if len(own) > smallest and depth < 40 else None
        if split is None:
            leaves.append(Node(leaf=len(leaves), held=places if keep else None))
            return leaves[-1]
        near = np.bitwise_count(own ^ split[0]) <= split[1]
        return Node(split[0], split[1], grow(places[near], depth + 1), grow(places[~near], depth + 1))

    return grow(np.arange(len(prints)), 0)


def routed(tree: Node, prints: np.ndarray, reach: int, homes: bool = True) -> Iterator[tuple[Node, np.ndarray, bool]]:
    """For each leaf the places of the fingerprints that are at home there and of those that visit it.

    Of two within reach of each other on both sides of a border, the near one visits the far side; so only it must.
    A visitor goes to every side that the triangle bound leaves open.
    """
    stack = [(tree, np.arange(len(prints)), homes)]
    while stack:
        node, places, home = stack.pop()
        if not len(places):
            continue
        if node.near is None:
            yield node, places, home
            continue
        d = np.bitwise_count(prints[places] ^ node.point).astype(np.int64)
        if home:
            near = d <= node.radius
            stack += [(node.near, places[near], True), (node.far, places[~near], True), (node.far, places[near & (d + reach > node.radius)], False)]
        else:
            stack += [(node.near, places[d - reach <= node.radius], False), (node.far, places[d + reach > node.radius], False)]


def linked(homes: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over homes and visitors (places, homes first) that connect what links of a home with either connect."""
    everyone = np.concatenate([homes, visitors])
    label = np.arange(len(everyone))
    leaves: list[Node] = []
    tree = grown(homes, LEAF, reach, np.random.default_rng(0), leaves, keep=True)
    for node, places, _ in routed(tree, everyone, reach, homes=False):
        for at in range(0, len(places), 2048):
            some = places[at : at + 2048]
            i, j = np.nonzero(np.bitwise_count(everyone[some][:, None] ^ homes[node.held][None, :]) <= reach)
            i, j = some[i], node.held[j]
            apart = i != j
            label = joined(label, i[apart], j[apart])
    label = settled(label)
    found = np.flatnonzero(label != np.arange(len(label)))
    return found, label[found]


def settled(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each points to a smaller or the same place) after the links i-j; roots are hung below smaller roots until no link joins two."""
    while len(i):
        label = settled(label)
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    return label


def shard_size(total: int, smallest: int) -> int:
    """Fingerprints of a shard: smallest up to SHARDS shards, then growing with the table up to LARGEST."""
    return max(smallest, min(LARGEST, total // SHARDS))


def dealt(places: np.ndarray, key: np.ndarray, home: bool, homes: int, visitors: int) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """The groups (i, j) of a shard that rows go to, and whether as homes: every pair of chunks of homes meets, and every chunk of homes with every chunk of visitors."""
    if homes <= 1 and visitors <= 1:
        yield 0, 0, places, home
        return
    chunk = key[places] % np.uint64(homes if home else visitors)
    for c in range(homes if home else visitors):
        who = places[chunk == c]
        if not len(who):
            continue
        if home:
            for other in range(homes):
                yield min(c, other), max(c, other), who, other >= c
            for v in range(visitors):
                yield c, homes + v, who, True
        else:
            for h in range(homes):
                yield h, homes + c, who, False


@dataclass
class Shards:
    """Trees whose leaves are shards, numbered through from first, and the chunks of each shard's homes and visitors."""

    trees: list[Node]
    first: list[int]
    reach: int
    chunks: np.ndarray

    @classmethod
    def counted(cls, trees: list[Node], first: list[int], reach: int, rows: DataFrame, values_of, most: int) -> Shards:
        """Counts the homes and visitors of every shard: a task sends one row for each shard. rows: one column, of which values_of makes a row of values, one for each tree."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((first[-1], 2), np.int64)
            for batch in batches:
                values = values_of(batch.column(0))
                for p, tree in enumerate(trees):
                    for node, places, home in routed(tree, values[:, p], reach):
                        sums[first[p] + node.leaf, 0 if home else 1] += len(places)
            found = np.flatnonzero(sums.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found, 0]), pa.array(sums[found, 1])], ["shard", "homes", "visitors"])

        total = rows.mapInArrow(count, "shard long, homes long, visitors long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
        chunks = np.zeros((first[-1], 2), np.int64)
        for r in total.collect():  # a row for each shard
            chunks[r["shard"]] = max(1, -(-r["homes"] // most)), -(-r["visitors"] // most)
        return cls(trees, first, reach, chunks)

    def deal(self, p: int, values: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, bool]]:
        """shard, i, j, places and whether at home, of values of tree p."""
        for node, places, home in routed(self.trees[p], values, self.reach):
            shard = self.first[p] + node.leaf
            for i, j, who, mine in dealt(places, key, home, *self.chunks[shard].tolist()):
                yield shard, i, j, who, mine


PACKED = pa.schema([("shard", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("home", pa.bool_()), ("nodes", pa.binary()), ("values", pa.binary()), ("prints", pa.binary())])
PACKED_COLUMNS = "shard int, i int, j int, home boolean, nodes binary, values binary, prints binary"


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """What a batch sends to groups, a row for each group: many fingerprints travel as one."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(PACKED.types)], schema=PACKED)


def unpacked(rows: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: values, nodes, fingerprints' words and whether at home."""
    nodes, values, prints = (b"".join(rows[c].to_pylist()) for c in ("nodes", "values", "prints"))
    sizes = [len(x) // 8 for x in rows["nodes"].to_pylist()]
    home = np.repeat(rows["home"].to_numpy(zero_copy_only=False).astype(bool), sizes)
    return np.frombuffer(values, kind).astype(np.uint64), np.frombuffer(nodes, "<i8"), np.frombuffer(prints, "<u8").reshape(-1, CHECKED), home


def links(prints: DataFrame, reach: int) -> DataFrame:
    """Edges (a, b) between representatives that connect all fingerprints within reach of each other. prints: fingerprint (all different), rep."""
    total = prints.count()
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 20))
    chosen = prints.select("fingerprint").filter(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 20)) < share).limit(SAMPLE).collect()
    sample = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))
    leaves: list[Node] = []
    size = shard_size(total, SHARD)
    tree = grown(sample, max(8, len(sample) * size // max(1, total)), reach, np.random.default_rng(0), leaves, keep=False)

    def values_of(column: pa.Array) -> np.ndarray:
        return column.to_numpy().view(np.uint64)[:, None]

    shards = Shards.counted([tree], [0, len(leaves)], reach, prints.select("fingerprint"), values_of, MOST * size // SHARD)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rep = values_of(batch.column(0))[:, 0], batch.column(1).to_numpy()
            key = own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            yield packed([(shard, i, j, home, rep[who].tobytes(), own[who].tobytes(), b"") for shard, i, j, who, home in shards.deal(0, own, key)])

    def search(rows: pa.Table) -> pa.Table:
        own, rep, _, home = unpacked(rows, "<u8")
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        n = int(home.sum())
        i, j = linked(own[order][:n], own[order][n:], reach) if n else (np.empty(0, np.int64),) * 2
        rep = rep[order]
        return pa.table({"a": pa.array(rep[i], pa.int64()), "b": pa.array(rep[j], pa.int64())})

    return prints.select("fingerprint", "rep").mapInArrow(route, PACKED_COLUMNS).groupBy("shard", "i", "j").applyInArrow(search, "a long, b long")


def mixed_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of words x 64 bits of different hashes: each is spread over them by mixing it with every word's number."""
    if not len(hashes):
        return np.zeros(words, np.int64)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # so that a byte can count
        mixed = hashes[at : at + 255, None] + STEPS[None, :words]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def long_fingerprint(text: str | None, words_per_shingle: int) -> np.ndarray:
    """The SimHash of WORDS x 64 bits over the different shingles of a text, each once."""
    return mixed_bits(np.unique(shingle_hashes(text, words_per_shingle)), WORDS)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: a hash of the text tells rows that share a doc_id apart."""
    return own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def long_fingerprints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id, text_hash, shingles (how many different ones), fingerprint (an array of WORDS longs), node (the fingerprint's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(x, words_per_shingle)) for x in batch.column(2).to_pylist()]
                made = np.concatenate([mixed_bits(x, WORDS) for x in sets])
                prints = pa.ListArray.from_arrays(np.arange(0, len(made) + 1, WORDS, dtype=np.int32), pa.array(made))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), prints], ["doc_id", "text_hash", "shingles", "fingerprint"])

    made = keyed(docs).mapInArrow(run, "doc_id long, text_hash long, shingles long, fingerprint array<long>")
    return made.withColumn("node", F.xxhash64("fingerprint"))


def parts_of(column: pa.Array) -> np.ndarray:
    """The 32-bit parts of fingerprints, a row each."""
    return column.flatten().to_numpy().view(np.uint32).reshape(len(column), 2 * WORDS).astype(np.uint64)


def least_neighbours(values: np.ndarray, reps: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """For each row the smallest rep among rows within reach of it (its own too): homes meet all rows, visitors the homes.

    Rows of equal values stand as one, so a value that many rows share costs as much as any other.
    """
    distinct, of = np.unique(values, return_inverse=True)
    none = np.iinfo(np.int64).max
    all_least, home_least = np.full(len(distinct), none), np.full(len(distinct), none)
    np.minimum.at(all_least, of, reps)
    np.minimum.at(home_least, of[home], reps[home])
    homes = np.flatnonzero(home_least < none)
    of_homes, of_all = home_least.copy(), all_least.copy()  # by value: the least among near homes, and among all near rows
    leaves: list[Node] = []
    tree = grown(distinct[homes], LEAF, reach, np.random.default_rng(0), leaves, keep=True)
    for node, places, _ in routed(tree, distinct, reach, homes=False):
        held = homes[node.held]
        for at in range(0, len(places), 2048):
            some = places[at : at + 2048]
            near = np.bitwise_count(distinct[some][:, None] ^ distinct[held][None, :]) <= reach
            of_homes[some] = np.minimum(of_homes[some], np.where(near, home_least[held][None, :], none).min(axis=1))
            of_all[held] = np.minimum(of_all[held], np.where(near, all_least[some][:, None], none).min(axis=0))
    return np.where(home, of_all[of], of_homes[of])


def met(values: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """Of each row, whether another row lies within reach of it: homes meet all rows, visitors the homes."""
    distinct, of = np.unique(values, return_inverse=True)
    rows, home_rows = np.bincount(of, minlength=len(distinct)), np.bincount(of[home], minlength=len(distinct))
    homes = np.flatnonzero(home_rows)
    of_homes, of_all = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    leaves: list[Node] = []
    tree = grown(distinct[homes], LEAF, reach, np.random.default_rng(0), leaves, keep=True)
    for node, places, _ in routed(tree, distinct, reach, homes=False):
        held = homes[node.held]
        for at in range(0, len(places), 2048):
            some = places[at : at + 2048]
            near = np.bitwise_count(distinct[some][:, None] ^ distinct[held][None, :]) <= reach
            of_homes[some] += np.where(near, home_rows[held][None, :], 0).sum(axis=1)
            of_all[held] += np.where(near, rows[some][:, None], 0).sum(axis=0)
    return np.where(home, of_all[of] > 1, of_homes[of] > 0)


def near_forest(values: np.ndarray, prints: np.ndarray, home: np.ndarray, reach: int, bits: int) -> np.ndarray:
    """For each row the first row that pairs connect it with: pairs of a home and any row within reach by value and within bits by whole fingerprint.

    Rows meet their first neighbour at once, which joins most copies; then all pairs of rows follow that are not joined yet.
    No pair is left out but those whose rows are connected already.
    """
    label = np.arange(len(values))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        apart = np.zeros(len(i), np.int64)
        for w in range(prints.shape[1]):
            apart += np.bitwise_count(prints[i, w] ^ prints[j, w])
        label = settled(joined(label, i[apart <= bits], j[apart <= bits]))

    least = least_neighbours(values, label.copy(), home, reach)
    some = np.flatnonzero(least < label)
    join(some, least[some])
    distinct, of = np.unique(values, return_inverse=True)
    order, count = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(distinct))
    start = np.cumsum(count) - count
    has_home = np.bincount(of[home], minlength=len(distinct)) > 0
    homes = np.flatnonzero(has_home)
    leaves: list[Node] = []
    tree = grown(distinct[homes], LEAF, reach, np.random.default_rng(0), leaves, keep=True)
    for node, places, _ in routed(tree, distinct, reach, homes=False):
        held = homes[node.held]
        low, high = np.minimum.reduceat(label[order], start), np.maximum.reduceat(label[order], start)
        for at in range(0, len(places), 2048):
            some = places[at : at + 2048]
            u, v = np.nonzero(np.bitwise_count(distinct[some][:, None] ^ distinct[held][None, :]) <= reach)
            u, v = some[u], held[v]
            open_ = ((u <= v) | ~has_home[u]) & (np.minimum(low[u], low[v]) != np.maximum(high[u], high[v]))
            u, v = u[open_], v[open_]
            i = order[np.repeat(start[u] - (np.cumsum(count[u]) - count[u]), count[u]) + np.arange(count[u].sum())]
            v = np.repeat(v, count[u])
            cut = np.cumsum(count[v]) // PAIRS
            for c in np.unique(cut):
                a, b = i[cut == c], v[cut == c]
                low_now, high_now = np.minimum.reduceat(label[order], start), np.maximum.reduceat(label[order], start)
                still = (low_now[b] != label[a]) | (high_now[b] != label[a])
                a, b = a[still], b[still]
                j = order[np.repeat(start[b] - (np.cumsum(count[b]) - count[b]), count[b]) + np.arange(count[b].sum())]
                a = np.repeat(a, count[b])
                fresh = (label[a] != label[j]) & (home[a] | home[j])
                join(a[fresh], j[fresh])
    return label


def part_links(prints: DataFrame, bits: int, reach: int = 1) -> DataFrame:
    """Edges (a, b) that connect all nodes that are within reach in some part and within bits by what is CHECKED. prints: node, fingerprint (all different).

    A first search, of parts alone, says which nodes meet any other in a part; only those carry their fingerprints to
    the shards of that part, where a second search goes through their pairs. A shard gives a forest of what it linked.
    """
    total = prints.count()
    share = int(min(1.0, PART_SAMPLE / max(1, total)) * (1 << 20))
    chosen = prints.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share).select("node", "fingerprint").limit(PART_SAMPLE).toArrow().sort_by("node")
    sample = parts_of(chosen["fingerprint"].combine_chunks()) if chosen.num_rows else np.zeros((1, 2 * WORDS), np.uint64)
    trees, first, size = [], [0], shard_size(total, PART_SHARD)
    for p in range(2 * WORDS):
        leaves: list[Node] = []
        trees.append(grown(np.unique(sample[:, p]), max(8, len(sample) * size // max(1, total)), reach, np.random.default_rng(p), leaves, keep=False))
        first.append(first[-1] + len(leaves))
    shards = Shards.counted(trees, first, reach, prints.select("fingerprint"), parts_of, MOST * size // PART_SHARD)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, parts = batch.column(0).to_numpy(), parts_of(batch.column(1))
            for p in range(2 * WORDS):
                own = parts[:, p].astype("<u4")
                rows = [(shard, i, j, home, node[who].tobytes(), own[who].tobytes(), b"") for shard, i, j, who, home in shards.deal(p, parts[:, p], node.view(np.uint64))]
                if rows:
                    yield packed(rows)

    def meet(rows: pa.Table) -> pa.Table:
        values, node, _, home = unpacked(rows, "<u4")
        some = np.unique(node[met(values, home, reach)]) if home.any() else np.empty(0, np.int64)
        p = np.searchsorted(first, rows["shard"][0].as_py(), "right") - 1
        return pa.table({"p": pa.array(np.full(len(some), p, np.int32)), "node": pa.array(some, pa.int64())})

    def route_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, node, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), parts_of(batch.column(2))
            words = parts.astype("<u4")[:, : 2 * CHECKED]
            for p in np.unique(of).tolist():
                at = np.flatnonzero(of == p)
                own = parts[at, p].astype("<u4")
                yield packed([(shard, i, j, home, node[at[who]].tobytes(), own[who].tobytes(), words[at[who]].tobytes()) for shard, i, j, who, home in shards.deal(p, parts[at, p], node[at].view(np.uint64))])

    def search(rows: pa.Table) -> pa.Table:
        values, node, prints, home = unpacked(rows, "<u4")
        label = near_forest(values, prints, home, reach, bits) if home.any() else np.arange(len(node))
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(node[some], pa.int64()), "b": pa.array(node[label[some]], pa.int64())})

    group = ["shard", "i", "j"]
    routed_rows = prints.select("node", "fingerprint").mapInArrow(route, PACKED_COLUMNS)
    meeting = written(routed_rows.groupBy(*group).applyInArrow(meet, "p int, node long").distinct(), "meeting")
    carried = meeting.join(prints.select("node", "fingerprint"), "node").select("p", "node", "fingerprint")
    return carried.mapInArrow(route_part, PACKED_COLUMNS).groupBy(*group).applyInArrow(search, "a long, b long").distinct()


def bits_apart(similarity: float) -> int:
    """Differing bits, of those CHECKED, of texts that share so much of all their shingles (in sets of equal size)."""
    return round(64 * CHECKED * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def loose_bits(similarity: float) -> int:
    """Differing bits that texts of the similarity exceed once in some thousands: four deviations above bits_apart."""
    p = bits_apart(similarity) / (64 * CHECKED)
    return math.ceil(64 * CHECKED * p + 4 * math.sqrt(64 * CHECKED * p * (1 - p)))


def exact_forest(prints: np.ndarray, sets: list[np.ndarray], block: np.ndarray, bits: int, similarity: float) -> np.ndarray:
    """For each text the first one that pairs at the similarity connect it with. Pairs within bits, but for those connected already, are decided by their sets of shingles.

    block: 0 or 1; if both occur, only pairs across are compared. A text marks its shingles in a table of all of them, so
    the shares with all its candidates are one look-up of the candidates' shingles.
    """
    label, across = np.arange(len(sets)), len(set(block.tolist())) > 1
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int8)
    for at in range(0, len(sets), 64):
        rows = np.arange(at, min(at + 64, len(sets)))
        apart = np.zeros((len(rows), len(sets)), np.int16)
        for w in range(prints.shape[1]):
            apart += np.bitwise_count(prints[rows, w][:, None] ^ prints[:, w][None, :])
        for x, bits_of in zip(rows.tolist(), apart, strict=True):
            fits = (bits_of <= bits) & (label != label[x]) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]))
            some = np.flatnonzero(fits & (block != block[x]) if across else fits)
            some = some[some > x]
            if not len(some):
                continue
            own = number[end[x] - size[x] : end[x]]
            mark[own] = 1
            sums = np.concatenate([[0], np.cumsum(mark[number[np.repeat(end[some] - np.cumsum(size[some]), size[some]) + np.arange(size[some].sum())]], dtype=np.int64)])
            mark[own] = 0
            shared = np.diff(sums[np.concatenate([[0], np.cumsum(size[some])])])
            near = some[shared >= similarity * (size[x] + size[some] - shared) - 1e-9]
            if len(near):
                met_ = np.unique([label[x], *label[near]])
                label[np.isin(label, met_)] = met_[0]
    return label


def exact_links(docs: DataFrame, reps: DataFrame, loose: DataFrame, words_per_shingle: int, bits: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all nodes of a loose component whose texts share so much of their shingles.

    reps: node, doc_id, text_hash, shingles. The shingles of a component come together once. A component of more than
    BLOCK texts is dealt to blocks, and each pair of blocks is a group of its own; small components share groups.
    """
    members = written(loose.join(reps, "node").withColumn("weight", F.greatest(F.lit(1.0), F.col("shingles") / SHINGLES)), "members")
    large = members.groupBy("component").agg(F.sum("weight").alias("n")).filter(F.col("n") > BLOCK).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = written(members.join(F.broadcast(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "members")
    count, size = members.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    held = F.broadcast(members) if count <= MEMBERS else members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(x, words_per_shingle)) for x in batch.column(3).to_pylist()]
                prints, hashes = ([x.tobytes() for x in made] for made in ([mixed_bits(x, CHECKED) for x in sets], sets))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(prints, pa.binary()), pa.array(hashes, pa.binary())], ["node", "component", "blocks", "fingerprint", "hashes"])

    def search(rows: pa.Table) -> pa.Table:
        node, component, block = (rows[c].to_numpy() for c in ("node", "component", "block"))
        prints = np.frombuffer(b"".join(rows["fingerprint"].to_pylist()), "<u8").reshape(-1, CHECKED)
        sets = [np.frombuffer(x, "<i8") for x in rows["hashes"].to_pylist()]
        order = np.argsort(component, kind="stable")
        a, b = [], []
        for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            label = exact_forest(prints[own], [sets[k] for k in own], (block[own] != block[own].min()).astype(int), bits, similarity)
            some = np.flatnonzero(label != np.arange(len(own)))
            a.append(node[own[some]])
            b.append(node[own[label[some]]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    texts = keyed(docs).join(held, ["doc_id", "text_hash"]).select("node", "component", "blocks", "text")
    rows = texts.mapInArrow(run, "node long, component long, blocks int, fingerprint binary, hashes binary")
    # pairs of different blocks only, or of one: a row goes to the group of its block with each block
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(max(12, int(4 * size / BLOCK)))))
    rows = rows.select((F.col("blocks") > 1).alias("large"), group.alias("bin"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", F.col("own").alias("block"), "fingerprint", "hashes")
    return rows.groupBy("large", "bin", "i", "j").applyInArrow(search, "a long, b long")


def repeated(made: DataFrame) -> DataFrame:
    """doc_id, text_hash of rows that repeat one."""
    return written(made.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "repeated")


def similar(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, "" for null), component_id, kept, a row for each row of docs.

    component_id is the smallest doc_id that links of texts of at least the similarity reach. kept is true for the row of
    a component with the smallest (doc_id, text_hash), for all rows that repeat it, and for rows without a component.

    Fingerprints only lead to candidates: pairs that meet in a part and are within a looser limit of bits make loose
    components; within those, pairs within that limit are decided by their sets of different shingles, exactly. Texts
    of one fingerprint count as equal: at 3,072 bits in common they share all but a few of some thousand shingles.
    A part leads to a pair with a chance that grows with its similarity; over all parts 0.96 of the pairs at exactly 0.8
    are found by themselves and nearly all above 0.85. Links through others join the rest of a group.
    """
    made = written(long_fingerprints(docs, words_per_shingle), "fingerprints")
    reps = made.filter("doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "shingles")).alias("r"))
    reps = written(reps.select("node", "r.doc_id", "r.text_hash", "r.shingles"), "classes")
    bits = loose_bits(similarity)
    distinct = written(made.select("node", "fingerprint").distinct(), "distinct")
    pairs = written(part_links(distinct, bits), "pairs")
    loose = components(pairs)
    discard(distinct, pairs)
    texts = docs if repeated(made.filter("doc_id is not null")).isEmpty() else keyed(docs).dropDuplicates(["doc_id", "text_hash"])
    linked_ = written(exact_links(texts, reps, loose, words_per_shingle, bits, similarity), "links")
    found = components(linked_)
    classes = reps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = classes.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    known = written(classes.join(best, "component").select("node", F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("best_hash")), "known")
    discard(linked_, reps)
    kept = F.col("component_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("best_hash")))
    return made.select("doc_id", "text_hash", "node").join(known, "node", "left").select("doc_id", "text_hash", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, reach: int = 3) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that links of at most reach differing bits reach.

    Three of 64 bits stand for texts that are nearly the same: of pairs at a similarity of 0.95 in five-word shingles about
    one in six is that near, at 0.9 one in eleven (check_s). For a similarity such as 0.8 call similar. A caller whose
    contract fixes other values passes them.
    """
    made = written(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = written(made.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct.filter("rep is not null"), reach))
    known = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return made.join(written(known, "known"), "fingerprint").select("doc_id", "fingerprint", "component_id")
