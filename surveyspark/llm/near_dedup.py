"""Near-duplicate documents by a MinHash LSH forest, with links confirmed on full sets.

A document's set is its distinct word shingles. Documents are rows of one id (null included)
and text. Those with equal sets form one class, numbered in order of its smallest id, and
only the class goes on. A pool of ``POOL`` minhash values is read in ``TREES``
fixed orders; each order sorts the classes, and classes that share a prefix of an order
are a region of that tree. Candidates come region by region:

1. each class and the first class of every region it is in, at each of ``DEPTHS``;
2. all pairs of a region whose members are still in several components. Shingles that no
   other member has bound what a pair can share: pairs that cannot reach the limit any
   more, or whose minhash pools differ too much, are not made;
3. the members of such regions of more than ``REGION`` classes are joined on their rarest
   shingles instead, which finds every linked pair among them (``crowded_pairs``).

Every link is confirmed by intersecting the full shingle sets. Sets are compared as
64-bit shingle hashes. Copies never meet in one task: classes are pre-aggregated, stars
around a hot id are joins whose large side Spark may split.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bpe import slices
from .common import documents, id_of, row_key, written

POOL, TREES, DEPTHS, REGION = 64, 32, (4, 8, 12), 64
ROWS = 500  # texts or sets that pass to Python at once
MARKS = 16  # words of 64 bits in the parity marks of a set
SALTS, SALT_ROWS, EARLIER = 8, 1024, 16  # of the join on rare shingles
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * _K1
    value = (value ^ (value >> np.uint64(27))) * _K2
    return value ^ (value >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, split at ASCII white space."""
    split = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(split))
    codes, names = pd.factorize(flat)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[codes]
    running = np.zeros(max(len(code) - words + 1, 0), np.uint64)
    for k in range(words):
        running = mix(running * np.uint64(3) + code[k : k + len(running)])
    out, lo = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(running[lo : lo + n - words + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for k in range(n):
                whole = mix(whole * np.uint64(3) + code[lo + k])
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        lo += n
    return out


def _pool(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, POOL, np.uint64) * np.uint64(2) + np.uint64(1)


def _orders(seed: int = 23) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    return [rng.permutation(POOL)[: DEPTHS[-1]].tolist() for _ in range(TREES)]


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """row, n_shingles, two 64-bit sums that name the set, and its minhash pool."""

    def run(batches):
        pool = _pool()
        for ids, texts in slices(batches, 2_000_000):
            sets = shingle_hashes(texts, words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            flat = np.concatenate(sets)
            starts = (np.cumsum(sizes) - sizes)[full]
            names = np.zeros((2, len(sets)), np.uint64)
            found = np.zeros((len(sets), POOL), np.int32)
            if len(full):
                names[0, full] = np.add.reduceat(flat, starts)
                names[1, full] = np.add.reduceat(mix(flat + _K1), starts)
                for k in range(POOL):
                    low = np.minimum.reduceat(flat * pool[k], starts)
                    found[full, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = pa.array(np.arange(0, (len(sets) + 1) * POOL, POOL, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.string()), pa.array(sizes),
                pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(found.ravel())),
            ], ["row", "n_shingles", "name_a", "name_b", "pool"])

    return rows.select("row", "text").mapInArrow(
        run, "row string, n_shingles long, name_a long, name_b long, pool array<int>"
    )


def prefixes(classes: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """node, depth and key: one row for each tree and depth a class is sorted in."""
    orders = F.array(*[F.array(*map(F.lit, order[:depth])) for depth in depths for order in _orders()])
    rows = classes.select("node", "pool", F.posexplode(orders).alias("tree", "order"))
    return rows.select(
        "node", F.size("order").alias("depth"),
        F.xxhash64("tree", F.transform("order", lambda k: F.col("pool")[k])).alias("key"),
    )


def packed_sets(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for ids, texts in slices(batches, 2_000_000):
            sets = [s.tobytes() for s in shingle_hashes(texts, words)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "own"])

    return rows.select("node", "text").mapInArrow(run, "node long, own binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """node and shingle, one row for each shingle of each set."""

    def run(batches):
        for batch in batches:
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "shingle"])

    return sets.select("node", "own").mapInArrow(run, "node long, shingle long")


def _shareable(sets: DataFrame) -> DataFrame:
    """node, size of its set, and room: how many of its shingles some other node has too."""
    lone = _exploded(sets).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    lone = lone.filter("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    size = (F.length("own") / 8).cast("long")
    return sets.select("node", size.alias("size")).join(lone, "node", "left").select(
        "node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("room")
    )


def _marked(sets: DataFrame) -> DataFrame:
    """node, size of its set, and m0, m1, ...: parities of how many of its shingles fall on each bit.

    Two sets' marks differ in no more bits than the sets differ in shingles.
    """
    bits = 64 * MARKS

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.concatenate([*own, np.empty(0, np.uint64)])
            at = np.repeat(np.arange(len(own)), sizes) * bits + (flat % np.uint64(bits)).astype(np.int64)
            odd = np.bincount(at, minlength=len(own) * bits).astype(np.uint8) & 1
            marks = np.packbits(odd).view(np.int64).reshape(len(own), MARKS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *map(pa.array, marks.T.copy())],
                ["node", "size", *(f"m{k}" for k in range(MARKS))],
            )

    columns = ", ".join(f"m{k} long" for k in range(MARKS))
    return sets.select("node", "own").mapInArrow(run, f"node long, size long, {columns}")


def crowded_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of the nodes of ``crowd`` (node, component) that lie in different components
    and may reach the limit; every pair that does is among them.

    With all shingles in one order, rarest first, two sets that reach the limit share one
    of the first size - need + 1 of each, need being the least intersection for the size.
    A pair is made at such a shingle unless sizes, places in the order or marks rule it
    out, or the shingles just before have made it. Common shingles are dealt over salts.
    """
    sets = sets.join(crowd, "node", "left_semi")
    marked = written(_marked(sets).join(crowd, "node"), "marks", ROWS)
    rows = _exploded(sets)
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    own = rows.join(held, "shingle").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own")
    )
    own = own.join(marked.select("node", "size", "component"), "node").select(
        "node", "component", (F.col("size") - F.size("own")).alias("lone"), "own.shingle",
        F.expr(f"size - (size * {percent} + 99) div 100 + 1").alias("prefix"),
    )
    heads = own.filter("prefix > lone").select(
        "node", "component", "lone", F.expr("slice(shingle, 1, cast(greatest(prefix - lone, 0) as int))").alias("head")
    )
    heads = written(heads.select(
        "node", "component", F.posexplode("head").alias("at", "shingle"), "lone", "head"
    ).select(
        "node", "component", "shingle", (F.col("lone") + F.col("at")).alias("at"),
        F.expr(f"slice(head, greatest(at - {EARLIER}, 0) + 1, least(at, {EARLIER}))").alias("before"),
    ), "heads")
    shared = heads.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low <> high").select(
        "shingle", F.expr(f"cast(least({SALTS}, rows div {SALT_ROWS} + 1) as int)").alias("salts")
    )
    heads = written(heads.join(shared, "shingle").join(marked.drop("component"), "node"), "heads")
    names = ["node", "component", "size", "at", "before", *(f"m{k}" for k in range(MARKS))]
    one = heads.select("shingle", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"),
                       *[F.col(n).alias(n + "_a") for n in names])
    two = heads.select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       *[F.col(n).alias(n + "_b") for n in names])
    differ = F.lit(0)
    for k in range(MARKS):
        differ = differ + F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b")))
    both = F.col("size_a") + F.col("size_b")
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    return one.join(two, ["shingle", "salt"]).filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        & ((100 + percent) * most >= percent * both)
        & ((100 + percent) * (both - differ) >= 2 * percent * both)
        & ~F.arrays_overlap("before_a", "before_b")
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those with 100 * intersection >= percent * union."""

    @pandas_udf("boolean")
    def linked(one: pd.Series, other: pd.Series) -> pd.Series:
        def test(x, y):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if not len(u) or not len(v) or 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                return False
            both = np.concatenate([u, v])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            return 100 * common >= percent * (len(u) + len(v) - common)

        return pd.Series([test(x, y) for x, y in zip(one, other)], dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    return pairs.join(right, "b").join(left, "a").filter(linked("own_a", "own_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges a, b.

    Alternates large-star and small-star steps until the edges are stars around the
    smallest nodes. Each step is one grouped minimum and one join back; a node with very
    many neighbours is one pre-aggregated row in the first and a splittable key in the second.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = written(edges.select(high, low).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = Observation()
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
        watched = small.filter("a <> b").distinct().observe(
            state, F.count(F.lit(1)).alias("edges"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("names")
        )
        current = written(watched, "edges")
        if state.get == seen:
            break
        seen = state.get
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def least_agreement(percent: int, spread: float = 4.7) -> int:
    """Equal minhash values that a linked pair has but for a chance of some 1 in 100,000:
    ``spread`` standard deviations below the mean at the limit."""
    share = percent / 100
    return max(0, int(POOL * share - spread * (POOL * share * (1 - share)) ** 0.5))


def near_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """row (its key), n_shingles, keeper (key of the row that stays) of every row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle
    sets; of a component the smallest id stays, null after all others. A text of fewer
    words is one shingle of its own; null texts and texts without words have no shingles
    and no links. Rows that repeat an id, null ids too, take part each with its own text.
    An empty table gives an empty result; other columns are ignored.
    """
    plain = documents(docs).select(row_key().alias("row"), "text")
    signed = written(signatures(plain, words), "signatures", ROWS)
    full = signed.filter("n_shingles > 0")
    name = ["name_a", "name_b", "n_shingles"]
    least = F.min(F.struct(id_of("row").isNull().alias("none"), id_of("row").alias("id"), "row")).alias("least")
    # Numbers follow the order of the smallest ids.
    classes = written(
        full.groupBy(*name).agg(least, F.any_value("pool").alias("pool")).sort("least").select(
            *name, "pool", F.col("least.row").alias("row"), F.monotonically_increasing_id().alias("node")
        ), "classes"
    )
    shared = prefixes(classes, DEPTHS[:1]).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = written(prefixes(classes, DEPTHS[:1]).join(shared, "key").select("node").distinct(), "met")
    crowd = classes.join(met, "node", "left_semi").select("node", "pool")
    wanted = classes.join(met, "node", "left_semi").select("row", "node")
    chosen = plain.join(wanted, "row")
    repeats = full.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(wanted, "row")
    if not repeats.isEmpty():  # a set is wanted once, though rows may repeat id and text
        chosen = chosen.dropDuplicates(["node"])
    sets = written(packed_sets(chosen, words), "sets", ROWS)

    # Regions at every depth: each member and the first one.
    members = prefixes(crowd, DEPTHS)
    regions = members.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(members.join(regions, "key"), "regions")
    stars = members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")
    edges = written(confirmed(stars, sets, percent), "links", ROWS)
    labels = written(components(edges), "labels")

    members = _labelled(members.select("node", "depth", "key", "size"), "node", labels, "component")
    members = members.filter(F.col("depth") == DEPTHS[0])
    open_now = members.groupBy("key").agg((F.min("component") != F.max("component")).alias("open"))
    rest = written(members.join(open_now.filter("open"), "key").select("key", "node", "component", "size"), "open")
    packed = written(rest.filter(F.col("size") > REGION).select("node", "component").distinct(), "packed")
    rest = rest.filter(F.col("size") <= REGION).drop("size")
    room = _shareable(sets.join(rest.select("node").distinct(), "node", "left_semi"))
    rest = rest.join(written(room, "room", ROWS), "node").filter(f"100 * room >= {percent} * size")
    keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most one a tree and depth
    rest = rest.join(keys, "node").join(crowd, "node")
    one, two = (
        rest.select("key", *[F.col(c).alias(c + side) for c in ("node", "component", "size", "room", "keys", "pool")])
        for side in ("_a", "_b")
    )
    most = F.least("room_a", "room_b")
    agreed = F.size(F.filter(F.zip_with("pool_a", "pool_b", lambda x, y: x == y), lambda same: same))
    across = one.join(two, "key").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & (100 * most >= percent * (F.col("size_a") + F.col("size_b") - most))
        # A pair is made in one of the regions it shares, and only if its minhashes allow a link.
        & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")) & (agreed >= least_agreement(percent))
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    across = across.unionByName(crowded_pairs(packed, sets, percent)).distinct()
    across = across.join(stars, ["a", "b"], "left_anti")
    edges = edges.unionByName(written(confirmed(across, sets, percent), "links", ROWS))
    labels = written(components(edges), "labels")

    named = _labelled(classes.select(*name, "node"), "node", labels, "component").drop("node")
    keepers = classes.select(F.col("node").alias("component"), F.col("row").alias("keeper"))
    named = named.join(keepers, "component").drop("component")
    found = full.select("row", *name).join(named, name).select("row", "n_shingles", "keeper")
    empty = signed.filter("n_shingles = 0").select("row", "n_shingles", F.col("row").alias("keeper"))
    return found.unionByName(empty)


def _by_id(rows: DataFrame) -> DataFrame:
    return rows.select(
        id_of("row").alias("doc_id"), "n_shingles", id_of("keeper").alias("component_id"),
        (F.col("row") == F.col("keeper")).alias("kept"),
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row with an id, as ``near_rows`` finds them."""
    return _by_id(near_rows(docs, words, percent)).filter("doc_id IS NOT NULL")


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one row of each component, with all columns."""
    kept = near_rows(docs, words, percent).filter("row = keeper").groupBy(F.col("row").alias("_keep")).agg(
        F.when(F.min("n_shingles") > 0, F.count(F.lit(1))).otherwise(1).alias("_rows")
    )
    kept = written(kept, "kept")
    rows = docs.join(kept.drop("_rows"), row_key() == kept["_keep"], "left_semi")
    again = kept.filter("_rows > 1").drop("_rows")
    if again.isEmpty():
        return rows
    once = rows.join(again, row_key() == again["_keep"], "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.join(again, row_key() == again["_keep"], "left_anti").unionByName(once)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_id(near_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85))


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
