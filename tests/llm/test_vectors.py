"""Vector operators: brute force on planted vectors, searches that skip and lose nothing, edge rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.llm import clustering, embedding_dedup, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k)
                                  for i, v, k in rows], SCHEMA).repartition(3)


def clashing(df):
    return df.withColumns({n: F.lit("x") for n in ("node", "name", "raw", "cluster", "list", "of", "code", "part", "n")})


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def edge_rows(width=64):
    rng = np.random.default_rng(8)
    good = [(i, rng.normal(size=width), i % 3 if i % 4 else None) for i in range(1, 100)]
    bad = [(200, None, 1), (201, [], 1), (202, [NAN] + [0.1] * (width - 1), 1), (203, [None] + [0.1] * (width - 1), 2),
           (204, [-INF] + [0.2] * (width - 1), None)]
    ties = [(300, good[0][1], 1), (301, good[0][1], None), (301, good[0][1], None), (301, good[1][1], 5), (None, good[3][1], 1)]
    return good + bad + ties + [(400, [0.0] * width, 0), (401, [-0.0] * width, 0)]


# --- clusters -------------------------------------------------------------------------

def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, floors(v, 64)) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    values = {id(x): x for x in kept}
    order = sorted(values.values(), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:clusters]]

    def find():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        found = find()
        for k in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if own:
                centers[k] = [sum(col) // len(own) for col in zip(*own)]
    found = find()
    inertia = sum(d for d, _ in found)
    per = {k: sum(d for d, c in found if c == k) for k in range(len(centers))}
    return sorted(((i, c, d, per[c], inertia, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, found)), key=str)


def op13(spark, df):
    found = clustering.cluster(df).collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest())
                   for r in found), key=str)


def test_clusters_equal_plain_k_means(spark):
    rows = edge_rows()
    assert op13(spark, frame(spark, rows)) == plain_clusters(rows)
    assert op13(spark, clashing(frame(spark, rows))) == plain_clusters(rows)


def test_clusters_of_few_and_no_vectors(spark):
    rows = edge_rows()[:5]
    assert op13(spark, frame(spark, rows)) == plain_clusters(rows)
    assert op13(spark, frame(spark, [])) == []
    assert op13(spark, frame(spark, [(1, None, 1), (2, [1.0] * 63, 2)])) == []


def test_clusters_of_large_components(spark):
    rows = [(i, v * (1e6 if i % 2 else 1), k) for i, v, k in edge_rows()[:99]]
    assert op13(spark, frame(spark, rows)) == plain_clusters(rows)


def test_progressive_search_is_exact_and_skips():
    rng = np.random.default_rng(3)
    centers = rng.integers(-200, 200, (16, 64))
    centers[9] = centers[4]  # a tie
    points = np.concatenate([centers[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 64)), centers[:5]])
    tally = []
    found, distance = clustering.nearest(clustering.transformed(points), clustering.transformed(centers), tally)
    apart = ((points[:, None] - centers[None]) ** 2).sum(2)
    assert (found == apart.argmin(1)).all() and (distance == 64 * apart.min(1)).all()
    assert sum(tally) < 0.4 * len(points) * 16 * 64


def test_transform_is_orthogonal_and_ordered():
    matrix = clustering.transformed(np.eye(64, dtype=np.int64)).T
    assert (matrix @ matrix.T == 64 * np.eye(64)).all()
    changes = (matrix[:, 1:] != matrix[:, :-1]).sum(1)
    assert changes.tolist() == list(range(64))


# --- codes ----------------------------------------------------------------------------

def plain_codes(rows, rounds=2):
    kept = [(i, floors(v, 256), k) for i, v, k in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[v[4 * p : 4 * p + 4] for _, v, _ in order] for p in range(16)]

    def find(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[4 * p : 4 * p + 4], e)) for e in books[p]]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        found = [[find(v, p) for p in range(16)] for _, v, _ in kept]
        for p in range(16):
            for k in range(len(books[p])):
                own = [v[4 * p : 4 * p + 4] for (_, v, _), f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [[find(v, p) for p in range(16)] for _, v, _ in kept]
    return sorted(((i, tuple(c for _, c in f), sum(d for d, _ in f)) for (i, _, _), f in zip(kept, found)), key=str), books


def op11(df):
    found, books = vector_codes.compress(df)
    return sorted(((r["vec_id"], tuple(r["codes"]), r["error"]) for r in found.collect()), key=str), [b.tolist() for b in books]


def test_codes_equal_plain_search(spark):
    rows = edge_rows()
    assert op11(frame(spark, rows)) == plain_codes(rows)
    assert op11(clashing(frame(spark, rows))) == plain_codes(rows)


def test_codes_of_few_no_and_large_vectors(spark):
    rows = edge_rows()[:7]
    assert op11(frame(spark, rows)) == plain_codes(rows)
    assert op11(frame(spark, [])) == ([], [])
    assert op11(frame(spark, [(1, None, 1), (2, [], 1)])) == ([], [])
    large = [(i, v * (3e5 if i % 2 else 1), k) for i, v, k in edge_rows()[:70]]
    assert op11(frame(spark, large)) == plain_codes(large)


def test_codes_need_equal_parts(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame(spark, [(1, [1.0] * 63, 1)]))


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "few"])
def test_gnat_is_exact_and_skips(kind):
    rng = np.random.default_rng(11)
    entries = rng.integers(-2000, 2000, (64, 4))
    points = rng.integers(-2500, 2500, (3000, 4))
    if kind == "ties":
        entries, points = entries // 800, points // 800
    elif kind == "equal":
        entries = np.zeros_like(entries)
    elif kind == "few":
        entries = entries[:3]
    tally = []
    index, best = vector_codes.nearest(vector_codes.gnat(entries), entries, points, tally)
    apart = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()
    if kind == "spread":
        assert sum(tally) < 0.75 * points.shape[0] * 64


def test_gnat_ranges_hold_their_subtrees():
    entries = np.random.default_rng(2).integers(-100, 100, (64, 4))

    def below(node):
        return set(node[0].tolist()).union(*(below(c) for c in node[3])) if len(node) > 1 else set(node[0].tolist())

    def walk(node):
        if len(node) == 1:
            return
        ids, least, most, children = node
        for i, s in enumerate(ids):
            for j, child in enumerate(children):
                for e in below(child):
                    d = math.dist(entries[s], entries[e])
                    assert least[i, j] <= d <= most[i, j]
        for child in children:
            walk(child)

    tree = vector_codes.gnat(entries)
    assert below(tree) == set(range(64))
    walk(tree)


# --- near duplicates ------------------------------------------------------------------

def linked_pairs(rows, cosine=0.95):
    keep = []
    for at, (_, v, _) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            keep.append((at, np.array(v, np.float32).astype(float)))
    for k, (a, u) in enumerate(keep):
        for b, v in keep[k + 1 :]:
            if len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= cosine:
                yield a, b


def plain_links(rows):
    count, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked_pairs(rows):
        count[a] += 1
        count[b] += 1
        root[find(a)] = find(b)
    least = {}
    for at, (i, _, _) in enumerate(rows):
        k = find(at)
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return sorted(((i, count[at], least.get(find(at)), i == least.get(find(at))) for at, (i, _, _) in enumerate(rows)), key=str)


def op12(df):
    return sorted(map(tuple, embedding_dedup.near_duplicate_vectors(df).collect()), key=str)


def near(rng, v, cosine):
    """A vector at this cosine from v."""
    u = v / np.linalg.norm(v)
    away = rng.normal(size=len(v))
    away -= away @ u * u
    return cosine * u + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def test_links_of_edge_rows(spark):
    rows = edge_rows() + [(500, [1.0], 1), (501, [2.0], 1), (502, [-2.0], 1), (503, [3.0, 0.1], 1), (504, [6.0, 0.1], 1)]
    assert op12(frame(spark, rows)) == plain_links(rows)
    assert op12(clashing(frame(spark, rows))) == plain_links(rows)
    assert op12(frame(spark, [])) == []
    assert op12(frame(spark, [(3, None, 1), (1, [0.0, 0.0], 1)])) == [(1, 0, 1, True), (3, 0, 3, True)]


@pytest.mark.parametrize("rank", [64, 5])
def test_links_close_to_the_limit(spark, rank):
    """Recall over pairs at 0.9505 in random directions, of full and of low rank: 0.99 at least; no false link."""
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(1500, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    rows = [(2 * i, v, 0) for i, v in enumerate(base)] + [
        (2 * i + 1, near(rng, v, 0.9505), 0) for i, v in enumerate(base[:700])]
    truth = set(linked_pairs(rows))
    count = np.zeros(len(rows), int)
    for a, b in truth:
        count[a] += 1
        count[b] += 1
    wanted = {rows[k][0]: int(n) for k, n in enumerate(count)}
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert set(found) == set(wanted) and all(found[i] <= wanted[i] for i in found)
    assert sum(found.values()) >= 0.99 * sum(wanted.values())


def test_hot_group_counts_whole(spark, monkeypatch):
    """A group of near copies that spans several blocks, and many equal rows."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(1)
    center = rng.normal(size=64)
    rows = [(i, rng.normal(size=64), 0) for i in range(300)]
    rows += [(1000 + i, near(rng, center, 0.99), 0) for i in range(250)] + [(2000 + i, center, 0) for i in range(150)]
    assert op12(frame(spark, rows)) == plain_links(rows)
