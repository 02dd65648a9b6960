"""Language-model scores by deleted interpolation of n-gram estimates.

The corpus is tokenised once into chunks of about ``CHUNK`` tokens (a stage table). Each
chunk asks for the corpus counts of its distinct n-grams: sorted hashes, with the chunk's
own training counts, packed by hash range. Per range the counts of all chunks are summed
and sent back in the same order, so a frequent n-gram is one entry per chunk and no task
sees more than one range. The probability of a word is

    w2 * count(context, word) / count(context) + w1 * count(word) / tokens + w0 / (words + 1)

with weights by frequency bucket of the context. They are learned by expectation
maximisation on held-out counts: every token of every training document is an event, looked
up in the corpus counts less its own document's. Events of one bucket whose two estimates lie
within an eighth of a binary order of each other are counted together with their sums, so
what the maximisation goes through is bounded, whatever the corpus. N-grams are compared
as 64-bit hashes of their words.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, written

CHUNK = 500_000
BUCKETS = 20  # context frequency buckets: 0, 1, 2-3, 4-7, ...
FOLDS, HELD_OUT = 5, 1
STEPS, LEVELS = 8, 512  # cells a binary order of an estimate; cells in all
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without the empty ones, squeezed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return bytes([used]) + b"".join(
        len(z := zlib.compress(p.tobytes(), 1)).to_bytes(4, "little") + z for p in planes[:used]
    )


def unpack(raw: bytes) -> np.ndarray:
    planes, at = [], 1
    for _ in range(raw[0]):
        size = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8))
        at += 4 + size
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, p in enumerate(planes):
        out[:, k] = p
    return out.reshape(-1).view("<u8")


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each token's word number, tokens per text; the end is a token of its own."""
    split = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    flat = np.empty(int(sizes.sum()) - len(split), object)
    flat[:] = list(itertools.chain.from_iterable(split))
    codes, names = pd.factorize(flat)
    words = np.concatenate([
        [END], np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    ]).astype(np.uint64)
    tokens = np.zeros(int(sizes.sum()), np.uint32)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = codes + 1
    return words, tokens, sizes


def chunks_of(docs: DataFrame) -> DataFrame:
    """Tokenised groups of documents."""

    def emit(rows):
        words, tokens, sizes = tokens_of([t for _, _, t in rows])
        return pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().int >> 65], pa.int64()),
            pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())),
            pa.array([[f == HELD_OUT for _, f, _ in rows]], pa.list_(pa.bool_())),
            pa.array([sizes.tolist()], pa.list_(pa.int64())),
            pa.array([words.tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary()),
        ], ["chunk", "ids", "held_out", "sizes", "words", "tokens"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for i, f, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                text = text.as_py()
                rows.append((i, f, text))
                size += text.count(" ") + text.count("\n") + 1
                if size >= CHUNK:
                    yield emit(rows)
                    rows, size = [], 0
        if rows:
            yield emit(rows)

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold("doc_id", FOLDS).alias("fold"))
    return plain.mapInArrow(
        run, "chunk long, ids array<long>, held_out array<boolean>, sizes array<long>, words binary, tokens binary"
    )


class Chunk:
    """One chunk's tokens with the hashes of their n-grams."""

    def __init__(self, sizes, held_out, words: bytes, tokens: bytes):
        self.sizes = np.asarray(sizes, np.int64)
        self.held_out = np.asarray(held_out, bool)
        self.tokens = np.frombuffer(tokens, np.uint32)
        hashes = np.frombuffer(words, np.uint64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        one = hashes[self.tokens]
        before = np.empty_like(one)
        before[1:] = one[:-1]
        before[self.begin] = START
        self.grams = {1: one, 2: mix(mix(before) + one)}
        self.learned = ~self.held_out[self.owner]

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, training count of each, each token's place among them."""
        distinct, place = np.unique(self.grams[order], return_inverse=True)
        return distinct, np.bincount(place[self.learned], minlength=len(distinct)), place

    def own_counts(self, place: np.ndarray) -> np.ndarray:
        """For each token how often its n-gram occurs in its own document."""
        key = self.owner * (int(place.max()) + 1 if len(place) else 1) + place
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        return count[back]


def requests_of(chunks: DataFrame, ranges: int) -> DataFrame:
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    names = ("chunk", "gram", "part", "asked", "counts")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("chunk", "sizes", "held_out", "words", "tokens")}
                own = Chunk(row["sizes"], row["held_out"], row["words"], row["tokens"])
                for order in own.grams:
                    distinct, counts, _ = own.asked(order)
                    part = (distinct >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(distinct), np.int64)
                    heads = np.flatnonzero(np.diff(part, prepend=-1))
                    edges = [*heads.tolist(), len(distinct)]
                    rows = []
                    for a, b in zip(edges, edges[1:]):
                        steps = np.diff(distinct[a:b], prepend=np.uint64(0))
                        rows.append((row["chunk"], order, int(part[a]), pack(steps), pack(counts[a:b])))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    return chunks.mapInArrow(run, "chunk long, gram int, part long, asked binary, counts binary")


def answers_of(requests: DataFrame) -> DataFrame:
    """Corpus counts for each request; total and distinct of the range on its first row."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(a), dtype=np.uint64) for a in rows["asked"]]
        sizes = [len(k) for k in keys]
        key = np.concatenate(keys)
        _, back = np.unique(key, return_inverse=True)
        total = np.zeros(int(back.max()) + 1, np.int64)
        np.add.at(total, back, np.concatenate([unpack(c) for c in rows["counts"]]).astype(np.int64))
        found = total[back].astype(np.uint64)
        edges = np.cumsum([0, *sizes])
        out = rows[["chunk", "gram", "part"]].copy()
        out["counts"] = [pack(found[a:b]) for a, b in zip(edges, edges[1:])]
        out["total"], out["distinct"] = 0, 0
        out.iloc[0, -2:] = int(total.sum()), int((total > 0).sum())
        return out

    return requests.groupBy("gram", "part").applyInPandas(
        answer, "chunk long, gram int, part long, counts binary, total long, distinct long"
    )


def counted(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with their answers, in the order asked."""
    own = answers.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("gram", "part", "counts"))).alias("answers")
    )
    return chunks.join(own, "chunk")


def _looked_up(row: dict) -> tuple[Chunk, dict[int, np.ndarray], dict[int, np.ndarray]]:
    own = Chunk(row["sizes"], row["held_out"], row["words"], row["tokens"])
    count, place = {}, {}
    for order in own.grams:
        _, _, place[order] = own.asked(order)
        found = np.concatenate([unpack(a["counts"]) for a in row["answers"] if a["gram"] == order])
        count[order] = found[place[order]].astype(np.int64)
    return own, count, place


def _context(own: Chunk, single: np.ndarray, starts: int) -> np.ndarray:
    out = np.empty_like(single)
    out[1:] = single[:-1]
    out[own.begin] = starts
    return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its count's binary exponent."""
    return np.minimum(np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0), BUCKETS - 1)


def _share(count: np.ndarray, of) -> np.ndarray:
    return np.divide(count, of, out=np.zeros(len(count)), where=np.asarray(of) > 0)


def _rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def _cell(estimate: np.ndarray) -> np.ndarray:
    """0 for zero, else by the binary logarithm, ``STEPS`` cells an order."""
    level = LEVELS - 1 + np.floor(np.log2(np.where(estimate > 0, estimate, 1.0)) * STEPS).astype(np.int64)
    return np.where(estimate > 0, np.clip(level, 1, LEVELS - 1), 0)


def events_of(chunks: DataFrame, tokens: int, starts: int) -> DataFrame:
    """Held-out events of all training documents by cell: bucket, n, and the sums of the two
    estimates without the event's own document."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for row in _rows_of(batches):
            own, count, place = _looked_up(row)
            if not own.learned.any():
                continue
            apart = {k: own.own_counts(place[k]) for k in count}
            two, one = count[2] - apart[2], count[1] - apart[1]
            context = _context(own, one, starts - 1)
            rest = tokens - own.sizes[own.owner]
            used = own.learned
            two, one, bucket = _share(two, context)[used], _share(one, rest)[used], bucket_of(context)[used]
            keys, back = np.unique((bucket * LEVELS + _cell(two)) * LEVELS + _cell(one), return_inverse=True)
            sums = np.stack([np.bincount(back, w, len(keys)) for w in (None, two, one)], 1)
            for key, values in zip(keys.tolist(), sums):
                held[key] = held[key] + values if key in held else values
        sums = np.array(list(held.values())).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), *map(pa.array, sums.T.copy())], ["cell", "n", "two", "one"]
        )

    found = chunks.mapInArrow(run, "cell long, n double, two double, one double").groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("n", "two", "one")]
    )
    return found.select((F.col("cell") / LEVELS**2).cast("int").alias("bucket"), "n", "two", "one")


def maximised(events: np.ndarray, floor: float, parts: tuple[int, ...], rounds: int, enough: float) -> np.ndarray:
    """Mixture weights of one group of cells (n, two, one), from equal ones to the tolerance."""
    weights = np.zeros(3)
    weights[list(parts)] = 1 / len(parts)
    n = events[:, 0]
    estimates = np.column_stack([events[:, 1] / n, events[:, 2] / n, np.full(len(n), floor)])
    for _ in range(rounds):
        share = estimates * weights
        share /= share.sum(1, keepdims=True)
        now = n @ share
        # Half an event a part keeps every weight above zero.
        now[list(parts)] += 0.5
        now /= now.sum()
        done = np.abs(now - weights).max() < enough
        weights = now
        if done:
            break
    return weights


def learn_weights(events: DataFrame, words: int, rounds: int = 10_000, enough: float = 1e-7) -> np.ndarray:
    """Mixture weights by bucket. A bucket without events has the weights of all events
    together; without any events they are equal."""
    cells = events.toPandas()  # at most BUCKETS x LEVELS x LEVELS
    floor = 1 / (words + 1)
    columns = ["n", "two", "one"]
    weights = np.empty((BUCKETS, 3))
    for parts, rows in (((0, 1, 2), slice(1, None)), ((1, 2), slice(0, 1))):
        weights[rows] = maximised(cells[columns].to_numpy(), floor, parts, rounds, enough)
    for bucket, own in cells.groupby("bucket"):
        weights[bucket] = maximised(own[columns].to_numpy(), floor, (0, 1, 2) if bucket else (1, 2), rounds, enough)
    return weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from documents outside the held-out fold; scores are log10 probabilities of
    the whole text with its end. A null or empty text is its end alone. Without training
    documents nothing is known and every token has its share of the empty model. Rows
    that repeat an id are scored and counted each; an empty table gives an empty result;
    other columns are ignored.
    """
    chunks = written(chunks_of(docs), "chunks", 500)
    count = chunks.count()
    ranges = 1 << max(3, (max(count // 2, 1) - 1).bit_length())
    answers = written(answers_of(requests_of(chunks, ranges)), "answers", 4)
    tokens, words = answers.filter("gram = 1").agg(
        F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))
    ).first()
    starts = chunks.select(F.expr("size(filter(held_out, h -> NOT h))").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0))
    ).first()[0]
    # Chunks are large: few pass to Python at once while the events are gathered.
    events = written(events_of(counted(chunks, answers), tokens, starts), "events", 1)
    weights = learn_weights(events, words)

    def run(batches):
        for row in _rows_of(batches):
            own, count, _ = _looked_up(row)
            one, two = count[1], count[2]
            context = _context(own, one, starts)
            w = weights[bucket_of(context)]
            chance = w[:, 0] * _share(two, context) + w[:, 1] * _share(one, np.full(len(one), tokens)) + w[:, 2] / (words + 1)
            base = np.log10((one + 0.5) / (tokens + 0.5 * (words + 1)))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(own.held_out), pa.array(own.sizes),
                pa.array(np.add.reduceat((one > 0).astype(np.int64), own.begin)),
                pa.array(np.add.reduceat(base, own.begin)),
                pa.array(np.add.reduceat(np.log10(chance), own.begin)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = counted(chunks, answers).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
