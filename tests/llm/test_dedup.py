"""Suffix dedup, exact dedup and near-dedup against brute force and SQL."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.llm import exact_dedup, near_dedup, suffix_dedup

TINY = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ suffix dedup


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def ours_repeats(docs, **options):
    found = suffix_dedup.remove_repeats(docs, **options).select(
        "n_bytes", "n_removed", F.size("removed_from"), F.sha2("kept", 256)
    )
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("length,alphabet", [(8, b"ab"), (9, b"abc"), (21, b"abcdefgh"), (40, b"ab")])
def test_sorted_suffixes_and_repeats(length, alphabet):
    rng = random.Random(length)
    base = bytes(rng.choice(alphabet) for _ in range(200))
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 10)):
            at = rng.randint(0, 150)
            part = bytearray(base[at : at + rng.randint(length, 90)] + base[:length])
            part[rng.randrange(len(part))] = rng.choice(alphabet)
            parts.append(bytes(part + part if rng.random() < 0.3 else part))
        owned = [len(p) - length + 1 for p in parts]
        weights = [rng.choice([1, 1, 2]) for _ in parts]
        seen = Counter(p[i : i + length] for p, n in zip(parts, owned) for i in range(n))
        want = [[seen[p[i : i + length]] > 1 or w > 1 for i in range(n)] for p, n, w in zip(parts, owned, weights)]
        assert [f.tolist() for f in suffix_dedup.repeated_starts(parts, owned, weights, length)] == want
        sorter = suffix_dedup.Sorter(np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1), length)
        order, data = sorter.suffixes(), sorter.data.tobytes()
        heads = [data[i : min(data.index(b"\0", i), i + length)] for i in order]
        assert sorted(order.tolist()) == list(range(len(data))) and heads == sorted(heads)


def test_repeats_match_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    texts = [r[0] for r in docs.select("text").collect()]
    assert ours_repeats(docs) == sorted(brute_repeats(texts, 400))


@pytest.mark.parametrize("crowd", [2000, 2])
def test_crowded_grams_are_divided_exactly(frame, crowd):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdef ") for _ in range(60))
    texts = []
    for _ in range(60):
        a, b = ("".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 50))) for _ in range(2))
        cut = rng.randint(30, 60)
        texts.append(a + shared[:cut] + b)
    docs = frame(list(enumerate(texts)))
    assert ours_repeats(docs, length=40, gram=12, crowd=crowd) == sorted(brute_repeats(texts, 40))


def test_repeats_edge_rows(frame, edge_rows, clash, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50_000)  # long texts in overlapping pieces
    rows = [(i, t) for i, t in edge_rows if i not in (6, 12)] + [(6, edge_rows[5][1][:120_000]), (12, edge_rows[5][1][:120_000])]
    docs = clash(frame(rows))
    assert ours_repeats(docs) == sorted(brute_repeats([t for _, t in rows], 400))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# ------------------------------------------------------------------- exact dedup


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return Counter(out)


def test_exact_edge_rows(frame, edge_rows, clash):
    docs = clash(frame(edge_rows))
    found = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept")
    assert Counter(tuple(r) for r in found.collect()) == brute_copies(edge_rows)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    kept = [r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({k for (_, k, _, _) in brute_copies(edge_rows)})
    assert exact_dedup.deduplicate(docs).columns == docs.columns


def test_exact_rows_are_named_by_id_and_text(frame, clash):
    rows = [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "c"), (None, "e"), (None, "f"), (None, "a"), (None, "f"), (2, "d"), (7, None), (7, "")]
    docs = clash(frame(rows))
    kept = Counter((r["doc_id"], r["text"] or "") for r in exact_dedup.deduplicate(docs).collect())
    assert kept == Counter([(1, "a"), (1, "b"), (3, "c"), (2, "d"), (None, "e"), (None, "f"), (7, "")])


def test_texts_that_share_a_digest_are_told_apart(frame):
    rows = [(k, "ab"[k % 2] * (k % 5)) for k in range(40)]
    weak = lambda text: F.substring(F.encode(text, "UTF-8"), 1, 0)  # noqa: E731  one digest for all
    found = exact_dedup.exact_duplicates(frame(rows), digest=weak).select("doc_id", "keep_id", "group_size", "kept")
    assert Counter(tuple(r) for r in found.collect()) == brute_copies(rows)


def test_state_goes_on_with_later_arrivals(spark, tmp_path):
    schema = "doc_id long, digest binary, locator string"
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(1, b"a", ""), (2, b"b", "")], schema).write.parquet(path)
    frame = spark.read.parquet(path)
    assert exact_dedup.absorb(path, frame.schema, state, spark).count() == 2
    spark.createDataFrame([(5, b"a", ""), (3, b"c", "")], schema).write.mode("append").parquet(path)
    found = exact_dedup.absorb(path, frame.schema, state, spark)
    rows = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in found.collect()}
    assert rows == {b"a": (5, 2), b"b": (2, 1), b"c": (3, 1)}


# -------------------------------------------------------------------- near-dedup


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        own = (t or "").encode().translate(near_dedup._LOWER).split()
        n = len(own)
        sets[i] = {tuple(own[k : k + words]) for k in range(max(n - words + 1, 1))} if n else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                label[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_copies_match_brute_force(frame, clash, words, percent):
    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(60, 300))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(400):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, 8)):  # chains of edits around the threshold
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        if k % 5 == 0:  # one common passage that alone links nothing
            own = passage + [rng.choice(vocabulary) for _ in range(40)]
        rows.append((k, " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "Ab cD"), (1003, "ab CD"), (1004, rows[3][1].upper())]
    found = near_dedup.near_duplicates(clash(frame(rows)), words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == brute_components(rows, words, percent)


def test_crowded_regions_go_deeper(frame, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 3)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    rows = []
    for base in range(3):
        stem = [rng.choice(vocabulary) for _ in range(200)]
        for k in range(40):
            own = list(stem)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((base * 100 + k, " ".join(own)))
    found = near_dedup.near_duplicates(frame(rows), 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == brute_components(rows, 3, 85)


def test_links_in_one_large_group_are_all_found(frame):
    """2,000 texts of one template: pairs at 0.81-0.84, every other two at 0.75."""
    rng = random.Random(6)
    rows, want = [], {}
    for pair in range(1000):
        extra = rng.choice([4, 5, 6])
        for k in (2 * pair, 2 * pair + 1):
            own = [f"t{w}" for w in range(90)] + [f"p{pair}w{w}" for w in range(extra)]
            own += [f"o{k}w{w}" for w in range(15 - extra)]
            rng.shuffle(own)
            rows.append((k, " ".join(own)))
            want[k] = 2 * pair
    sets = [set(t.split()) for _, t in rows]
    some = rng.sample(range(2000), 150)
    for x in some:  # brute force: a text's links among all others
        links = [y for y in range(2000) if y != x and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
        assert links == [x ^ 1]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(rows), 1, 80).collect()}
    assert got == want


def test_near_edge_rows(frame, edge_rows, clash):
    docs = clash(frame(edge_rows))
    found = near_dedup.near_duplicates(docs, 3, 85).collect()
    component = {r["doc_id"]: r["component_id"] for r in found}
    assert component[12] == 6 and component[8] == 7 and component[9] == 7 and component[14] == 13
    assert all(component[i] == i for i in (1, 2, 3, 5)) and None not in component
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_rows_are_named_by_id_and_text(spark, frame, clash):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long), (2, long + " end"), (2, "another text"), (None, "clean and unique"), (None, long + " more"),
            (None, "twice"), (None, "twice"), (None, None), (5, "same"), (5, "same")]
    docs = clash(frame(rows))
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(docs, 3, 85).collect())
    assert kept == Counter([(1, long), (2, "another text"), (None, "clean and unique"), (None, "twice"), (None, None), (5, "same")])
    found = near_dedup._by_id(near_dedup.near_rows(docs, 3, 85)).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] is None for r in found) == 5
    assert Counter((r["component_id"], r["kept"]) for r in found if r["doc_id"] == 2) == Counter([(1, False), (2, True)])


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (200, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 200: 100}
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_a_column_of_any_name_survives_exact_dedup(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumn("_text__", F.lit(1))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "_text").collect(), key=str) == [(1, "x"), (3, "z"), (None, "n")]
