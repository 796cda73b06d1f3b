"""SimHash against brute force: fingerprints, links over trees and shards, components, and the query."""

import random

import numpy as np
import pytest
import xxhash

from sampleweave.llm import shared, simhash


def brute_fingerprint(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, edges):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \n\t ", "One", "one two", "A B C d É\x85x", "the cat\x0bsat on the mat " * 50, "\x1fa b\x1c c d"])
def test_fingerprints(text):
    assert simhash.fingerprint(text, 3) == brute_fingerprint(text, 3)


def near(draw, n):
    """Fingerprints in clusters, some of them a few bits apart."""
    out = set()
    while len(out) < n:
        p = draw.getrandbits(64)
        out.add(p)
        for _ in range(draw.randint(0, 5)):
            for _ in range(draw.randint(1, 3)):
                p ^= 1 << draw.randrange(64)
            out.add(p)
    return sorted(out)


def brute_links(prints, reach):
    return [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if (a ^ b).bit_count() <= reach]


def test_tree_and_borders():
    prints = near(random.Random(5), 1500)
    homes, visitors = np.array(prints[::2], np.uint64), np.array(prints[1::2], np.uint64)
    i, j = simhash.linked(homes, visitors, 2)
    order = prints[::2] + prints[1::2]
    n = len(homes)
    want = brute_components(range(len(order)), [(a, b) for a, b in brute_links(order, 2) if min(a, b) < n])
    assert brute_components(range(len(order)), zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("shard, most", [(60, 1 << 15), (60, 25), (10**6, 40)])
def test_links(spark, monkeypatch, shard, most):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "SAMPLE", 300)
    prints = near(random.Random(6), 900)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fingerprint long, rep long")
    edges = [(r["a"], r["b"]) for r in simhash.links(frame, 2).collect()]
    assert brute_components(range(len(prints)), edges) == brute_components(range(len(prints)), brute_links(prints, 2))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)] + [(500, i) for i in range(99, 140)], [(5, 3), (3, 5), (9, 8)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])


def test_query(spark, tmp_path):
    from sampleweave.llm.queries import op7_simhash

    draw = random.Random(7)
    base = [" ".join(draw.choice(["red", "Green", "blue", "sea", "sky", "x%d" % draw.randint(0, 99)]) for _ in range(160)) for _ in range(30)]
    texts = [t for b in base for t in (b, b.upper(), b + " end", b.replace("sea", "Sea", 1))] + ["", None, "one", "one two"]
    rows = [(1000 - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, base[0], "x", 1), (None, "lone words here", "x", 1), (1000, base[0], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, rep int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r)[:3] for r in op7_simhash(spark, str(tmp_path)).collect()), key=str)
    prints = [brute_fingerprint(t, 3) for _, t, *_ in rows]
    known = {}
    for (doc, *_), p in zip(rows, prints):
        known[p] = min(x for x in (known.get(p), doc, 10**9) if x is not None)
    reps = [p for p in known if known[p] < 10**9]
    edges = [(known[a], known[b]) for i, a in enumerate(reps) for b in reps[:i] if (a ^ b).bit_count() <= 2]
    comp = brute_components([known[p] for p in reps], edges)
    want = [(doc, f"{p:016x}", comp.get(known[p])) for (doc, *_), p in zip(rows, prints)]
    assert got == sorted(want, key=str)
    assert len({c for *_, c in got}) < len(got) / 2
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_neighbours():
    draw = np.random.default_rng(9)
    values = draw.integers(0, 1 << 12, 400).astype(np.uint64)
    reps, home = draw.permutation(400).astype(np.int64), draw.random(400) < 0.6
    got = simhash.least_neighbours(values, reps, home, 1)
    for i in range(400):
        near = [r for v, r, h in zip(values, reps, home) if (int(v) ^ int(values[i])).bit_count() <= 1 and (h or home[i])]
        assert got[i] == min([*near, *([reps[i]] if home[i] else [])], default=np.iinfo(np.int64).max)


def test_met_and_forest():
    """All pairs within reach by value and near by whole fingerprint count, whatever other rows share the value."""
    draw = np.random.default_rng(12)
    prints = np.repeat(draw.integers(0, 1 << 63, (60, simhash.CHECKED)).astype(np.uint64), 8, axis=0)
    for row in prints:
        for bit in draw.integers(0, 1024, draw.integers(0, 60)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    values, home = draw.integers(0, 1 << 9, len(prints)).astype(np.uint64), draw.random(len(prints)) < 0.6
    near = (np.bitwise_count(values[:, None] ^ values) <= 1) & (home[:, None] | home) & ~np.eye(len(prints), dtype=bool)
    assert (simhash.met(values, home, 1) == near.any(axis=1)).all()
    near &= np.bitwise_count(prints[:, None] ^ prints).sum(axis=2) <= 60
    want = brute_components(range(len(prints)), zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    for pairs in (1 << 19, 7):
        simhash.PAIRS, before = pairs, simhash.PAIRS
        got = simhash.near_forest(values, prints, home, 1, 60)
        simhash.PAIRS = before
        assert dict(enumerate(got.tolist())) == want


def test_similar_within_template(spark):
    """Edited copies (0.9) among thousands of texts that share a passage (0.5 to 0.6): each part holds many other neighbours."""
    draw = random.Random(13)
    passage = [f"p{i}" for i in range(230)]
    texts = [passage + [f"w{draw.randrange(10**6)}" for _ in range(70)] for _ in range(3000)]
    for text in texts[-120:]:  # the last ids, so that other neighbours of a part come before the twin
        edited = list(text)
        for at in draw.sample(range(20, 200), 2):
            edited[at] = f"e{draw.randrange(10**6)}"
        texts.append(edited)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert np.mean([got[3000 + k] == got[2880 + k] for k in range(120)]) > 0.97
    assert np.mean([got[i] == i for i in range(2880)]) > 0.99


def test_similar_texts(spark):
    """Recall by similarity of all shingles, against brute force; texts that share little stay apart."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts, base = [], []
    for g in range(60):
        text = [draw.choice(words) for _ in range(draw.choice([60, 150, 400]))]
        for k in range(4):
            edited = list(text)
            for _ in range(k * len(text) // 120):
                edited[draw.randrange(len(text))] = draw.choice(words)
            texts.append(" ".join(edited))
            base.append(g)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (None, texts[0]), (1002, texts[0])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    found = {0.9: [], 0.8: []}
    for a in range(len(texts)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j < 0.3:
                assert got[a] != got[b]
            for limit in found:
                if j >= limit:
                    found[limit].append(got[a] == got[b])
    assert np.mean(found[0.9]) > 0.97 and np.mean(found[0.8]) > 0.85
    assert got[1000] == got[1001] == 1000 and got[1002] == got[None] == got[0]
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [1 << 10, 3])
def test_similar_is_exact(spark, monkeypatch, block):
    """Pairs on both sides of 0.8, by their shares of shingles: those below stay apart, and of those above nearly all that a part can find are joined."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(14)
    texts, shares = [], []
    for g in range(240):
        text = [f"g{g}x{i}" for i in range(300)]
        edited = text[: -draw.choice([24, 28, 38, 42])] + [f"g{g}y{i}" for i in range(30)]
        a, b = (set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in (text, edited))
        shares.append(len(a & b) / len(a | b))
        texts += [" ".join(text), " ".join(edited)]
    if block < 10:  # one large component of copies that differ by a word or two
        base = [f"z{i}" for i in range(300)]
        texts += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 300, 15)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    joined = np.array([got[2 * g] == got[2 * g + 1] for g in range(240)])
    shares = np.array(shares)
    assert 60 < (shares >= 0.8).sum() < 180
    assert not joined[shares < 0.8].any() and joined[shares >= 0.8].mean() > 0.6
    assert all(got[i] == 480 for i in range(480, len(texts)))


def test_exact_forest():
    draw = np.random.default_rng(15)
    sets = [np.sort(draw.permutation(40)[: draw.integers(15, 40)]) for _ in range(120)] + [np.empty(0, np.int64)]
    block, prints = (np.arange(121) % 2), np.zeros((121, simhash.CHECKED), np.uint64)
    for own in (block, block * 0):
        pairs = [(i, j) for i in range(120) for j in range(i) if (own is not block or block[i] != block[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        got = simhash.exact_forest(prints, sets, own, 0, 0.8)
        assert len(pairs) > 20 and dict(enumerate(got.tolist())) == brute_components(range(121), pairs)


def test_repeated_lines():
    """A line that two texts repeat weighs as little as the set of its shingles: different texts stay far apart, near copies near."""
    line = " ".join(f"menu{i}" for i in range(10)) + " "
    a, b = (" ".join(f"{k}{i}" for i in range(1000)) + " " for k in "ab")
    apart = lambda x, y: np.bitwise_count((simhash.long_fingerprint(x, 5) ^ simhash.long_fingerprint(y, 5))[: simhash.CHECKED]).sum()
    assert apart(a + line * 40, b + line * 40) > 400
    assert apart(a + line * 40, a + line) < 60
