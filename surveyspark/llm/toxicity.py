"""Toxicity scores from a small convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its leading
bytes; filters of several widths slide over the words, each filter's largest answer
over the whole text feeds a logistic output. The classifier is fitted on all labelled rows:
they are dealt into parts of like size, in each round every part goes on from the last
round's model by itself, and the changes are averaged, a bucket's over the parts that met
it. Its thresholds are calibrated per language on all labelled rows left out of the fit
(a fifth); the language is guessed from the text's own function words, so a score
depends on the text alone. Scores are shifted so that a language's threshold becomes
0.5. Scoring runs over whole texts in all tasks.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import arrow_rows, documents, fold, table, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 16, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
BATCH, BATCH_CHARS = 32, 1_000_000  # texts of a gradient step
PART_ROWS, PART_CHARS = 8192, 16_000_000  # labelled rows of a part on average; characters held at once
MARKS = 1 << 25  # bits that tell most rows without a label before they are shuffled
PIECE = 2048  # buckets whose changes are averaged together
GRID = 128  # thresholds are found on logits cut to this part of 1
# Frequent function words by language.
FUNCTION_WORDS = {
    "de": {"der", "die", "und", "das", "ist", "nicht", "von", "mit"},
    "en": {"the", "and", "of", "to", "is", "that", "in", "for"},
    "es": {"el", "los", "las", "que", "y", "con", "por", "para"},
    "fr": {"le", "les", "et", "des", "du", "dans", "est", "pour"},
}
_WORD = re.compile(r"\w+")


def word_buckets(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its leading bytes, one row a word; 0 where it is shorter."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + bytes(max(PREFIXES)), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(sizes) - sizes
    out = np.zeros((len(raw), 1 + len(PREFIXES)), np.int64)
    mixed = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
    out[:, 0] = 1 + _mix(mixed, 0) % np.uint64(BUCKETS - 1)
    value = np.zeros(len(raw), np.uint64)
    for k in range(max(PREFIXES)):
        value = value * np.uint64(257) + data[start + k]
        if k + 1 in PREFIXES:
            bucket = 1 + _mix(value, k + 1) % np.uint64(BUCKETS - 1)
            out[:, 1 + PREFIXES.index(k + 1)] = np.where(sizes > k, bucket, 0)
    return out


def _mix(value: np.ndarray, seed: int) -> np.ndarray:
    value = (value + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)


class Words:
    """Distinct words of some texts, their buckets, each text's word numbers and language."""

    def __init__(self, texts: list[str]):
        split = [_WORD.findall(t.lower()) for t in texts]
        own = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.empty(int(own.sum()), object)
        flat[:] = list(itertools.chain.from_iterable(split))
        codes, names = pd.factorize(flat)
        self.buckets = np.concatenate([np.zeros((1, 1 + len(PREFIXES)), np.int64), word_buckets(list(names))])
        # Padding words after each text keep windows inside it.
        pad = max(WIDTHS) - 1
        self.lengths = own + pad
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.zeros(int(self.lengths.sum()), np.int64)
        inside = np.ones(len(self.tokens), bool)
        for k in range(1, pad + 1):
            inside[self.begin + self.lengths - k] = False
        self.tokens[inside] = codes + 1
        self.padding = ~inside
        known = {w: k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words}
        spoken = np.array([-1, *[known.get(w, -1) for w in names]])[self.tokens]
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        width = len(FUNCTION_WORDS)
        seen = np.bincount(owner[spoken >= 0] * width + spoken[spoken >= 0], minlength=len(texts) * width)
        seen = seen.reshape(len(texts), width)
        names_of = [*FUNCTION_WORDS, "?"]
        self.languages = [names_of[k] for k in np.where(seen.any(axis=1), seen.argmax(axis=1), width)]

    def subset(self, rows: np.ndarray) -> Words:
        """The texts ``rows`` alone, without their languages."""
        out = object.__new__(Words)
        out.lengths = self.lengths[rows]
        out.begin = np.cumsum(out.lengths) - out.lengths
        place = np.repeat(self.begin[rows] - out.begin, out.lengths) + np.arange(int(out.lengths.sum()))
        used, out.tokens = np.unique(self.tokens[place], return_inverse=True)  # padding, word 0, stays first
        out.buckets, out.padding = self.buckets[used], self.padding[place]
        return out

    def embed(self, table: np.ndarray) -> np.ndarray:
        total = table[self.buckets[:, 0]]
        for k in range(1, self.buckets.shape[1]):
            total += table[self.buckets[:, k]]
        return total


def _responses(words: Words, model: dict) -> list[np.ndarray]:
    """For each width the filters' answers at every word."""
    embedded = words.embed(model["table"])
    tokens = words.tokens
    out = []
    for width in WIDTHS:
        total = None
        for k in range(width):
            part = (embedded @ model[f"w{width}"][k])[np.concatenate([tokens[k:], np.zeros(k, tokens.dtype)])]
            total = part if total is None else np.add(total, part, out=total)
        # A window that starts in the padding is empty: it must not reach the next text.
        total[words.padding] = 0
        out.append(total)
    return out


def logits(words: Words, model: dict) -> np.ndarray:
    pooled = [np.maximum.reduceat(r, words.begin, axis=0) for r in _responses(words, model)]
    hidden = np.maximum(np.concatenate(pooled, axis=1) + model["bias"], 0)
    return hidden @ model["out"] + model["out_bias"]


def initial(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    model = {"table": (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)}
    model["table"][0] = 0
    for width in WIDTHS:
        model[f"w{width}"] = (rng.standard_normal((width, DIM, FILTERS)) * 0.3).astype(np.float32)
    model["bias"] = np.zeros(FILTERS * len(WIDTHS), np.float32)
    model["out"] = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
    model["out_bias"] = np.zeros(1, np.float32)
    return model


def _batches(texts: list[str], order: np.ndarray) -> list[np.ndarray]:
    out, held, size = [], [], 0
    for i in order:
        if held and (len(held) == BATCH or size + len(texts[i]) > BATCH_CHARS):
            out.append(np.array(held))
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    return [*out, np.array(held)] if held else out


class Descent:
    """Passes over labelled texts by a copy of ``model``: log loss, Adam, positive rows weighted up to half.

    ``share``: the positive rows' share of all rows that are fitted. ``met`` counts each bucket's steps.
    """

    def __init__(self, model: dict, share: float, seed: int):
        self.model = {k: v.copy() for k, v in model.items()}
        self.first = {k: np.zeros_like(v) for k, v in model.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.items()}
        self.weights = 0.5 / max(1 - share, 1e-6), 0.5 / max(share, 1e-6)
        self.rng = np.random.default_rng(seed)
        self.met = np.zeros(BUCKETS, np.int64)
        self.step = self.rows = 0

    def passes(self, texts: list[str], labels: np.ndarray, rates: list[float]) -> None:
        """One pass for each rate."""
        groups = _batches(texts, self.rng.permutation(len(texts)))
        words = Words(texts)
        self.rows += len(texts)
        for rate in rates:
            for g in self.rng.permutation(len(groups)):
                y = labels[groups[g]]
                self._descend(words.subset(groups[g]), y, np.where(y == 1, self.weights[1], self.weights[0]), rate)

    def _descend(self, words: Words, y: np.ndarray, w: np.ndarray, rate: float) -> None:
        model, first, second = self.model, self.first, self.second
        embedded, responses = words.embed(model["table"]), _responses(words, model)
        pooled, where = [], []
        for r in responses:
            best = np.stack([r[b : b + n].argmax(axis=0) + b for b, n in zip(words.begin, words.lengths)])
            where.append(best)
            pooled.append(np.take_along_axis(r, best, axis=0))
        before = np.concatenate(pooled, axis=1) + model["bias"]
        hidden = np.maximum(before, 0)
        chance = 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_bias"], -30, 30)))
        slope = ((chance - y) * w / len(y)).astype(np.float32)
        grads = {"out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True)}
        down = (slope[:, None] * model["out"]) * (before > 0)
        grads["bias"] = down.sum(axis=0)
        met, gains = [], []
        for j, width in enumerate(WIDTHS):
            part = down[:, j * FILTERS : (j + 1) * FILTERS]
            own = np.empty_like(model[f"w{width}"])
            for k in range(width):
                spot = np.minimum(where[j] + k, len(words.tokens) - 1)
                number = np.where(words.padding[where[j]], 0, words.tokens[spot])
                own[k] = np.einsum("bfd,bf->df", embedded[number], part)
                met.append(number.ravel())
                gains.append((part[:, :, None] * model[f"w{width}"][k].T[None]).reshape(-1, DIM))
            grads[f"w{width}"] = own
        self.step += 1
        # Words that won a filter pass their gradient to all their buckets.
        number, gain = np.concatenate(met), np.concatenate(gains)
        live = np.abs(gain).sum(axis=1) > 0
        number, gain = number[live], gain[live]
        if len(number):
            own = words.buckets[number]
            bucket, owner = own.ravel(), np.repeat(np.arange(len(number)), own.shape[1])
            by = np.argsort(bucket, kind="stable")
            rows_of, cut = np.unique(bucket[by], return_index=True)
            summed = np.add.reduceat(gain[owner][by], cut, axis=0)
            keep = rows_of > 0
            self.met[rows_of[keep]] += 1
            _adam(model["table"], first["table"], second["table"], summed[keep], rate, self.step, rows_of[keep])
        for name, grad in grads.items():
            _adam(model[name], first[name], second[name], grad, rate, self.step)

    def changes(self, start: dict, part: int) -> pd.DataFrame:
        """(piece, part, rows, weight, change): weighted changes since ``start`` of the buckets met, by
        pieces of the table, and of all other parameters (piece -1, row 0)."""
        others = np.concatenate([(self.model[n] - start[n]).ravel() for n in _others(start)])
        out = [(-1, part, *_packed([0], [self.rows], others[None] * self.rows))]
        rows = np.flatnonzero(self.met)
        for piece in np.unique(rows // PIECE):
            own = rows[rows // PIECE == piece]
            change = (self.model["table"][own] - start["table"][own]) * self.met[own, None]
            out.append((piece, part, *_packed(own - piece * PIECE, self.met[own], change)))
        return pd.DataFrame(out, columns=["piece", "part", "rows", "weight", "change"])


def _others(model: dict) -> list[str]:
    return sorted(k for k in model if k != "table")


def _packed(rows, weight, change) -> tuple[bytes, bytes, bytes]:
    return np.asarray(rows, np.int32).tobytes(), np.asarray(weight, np.float32).tobytes(), np.asarray(change, np.float32).tobytes()


def _averaged(frames):
    """Weighted means of ``Descent.changes``, which come in the order of their pieces; one sum at a time."""
    piece = total = weight = None

    def mean():
        rows = np.flatnonzero(weight)
        return pd.DataFrame(
            [(piece, 0, *_packed(rows, weight[rows], total[rows] / weight[rows, None]))],
            columns=["piece", "part", "rows", "weight", "change"],
        )

    for pdf in frames:
        for r in pdf.itertuples(index=False):
            rows = np.frombuffer(r.rows, np.int32)
            change = np.frombuffer(r.change, np.float32).reshape(len(rows), -1)
            if r.piece != piece:
                if piece is not None:
                    yield mean()
                piece = r.piece
                total = np.zeros((PIECE if piece >= 0 else 1, change.shape[1]))
                weight = np.zeros(len(total))
            total[rows] += change
            weight[rows] += np.frombuffer(r.weight, np.float32)
    if piece is not None:
        yield mean()


def _moved(model: dict, means) -> dict:
    """``model`` after the mean changes of a round."""
    out = {k: v.copy() for k, v in model.items()}
    for r in means:
        rows = np.frombuffer(r["rows"], np.int32)
        change = np.frombuffer(r["change"], np.float32).reshape(len(rows), -1)
        if r["piece"] >= 0:
            out["table"][r["piece"] * PIECE + rows] += change
            continue
        at = 0
        for name in _others(model):
            size = model[name].size
            out[name] += change[0, at : at + size].reshape(model[name].shape)
            at += size
    return out


def _adam(value, first, second, grad, rate, step, rows=slice(None)) -> None:
    first[rows] = 0.9 * first[rows] + 0.1 * grad
    second[rows] = 0.999 * second[rows] + 0.001 * grad * grad
    scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    value[rows] -= (scale * first[rows] / (np.sqrt(second[rows]) + 1e-7)).astype(np.float32)


def best_threshold(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The value that splits rows with fewest errors, half way between neighbours, from the
    rows of each label at each value (ascending)."""
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    edges = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    tied = np.flatnonzero(wrong == wrong.min())
    return float(edges[tied[len(tied) // 2]])


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    words = Words(texts)
    cut = np.array([model["thresholds"].get(x, model["thresholds"][""]) for x in words.languages])
    return 1 / (1 + np.exp(-np.clip(logits(words, model).astype(np.float64) - cut, -30, 30)))


def _parts(frames):
    """(part, texts, labels, whether the part ends) from rows in the order of their parts. Of a
    part that holds too much text for a task there are several pieces."""
    part, texts, labels, size = None, [], [], 0
    for pdf in frames:
        for own, text, label in zip(pdf["part"], pdf["text"], pdf["toxic"]):
            if texts and (own != part or size + len(text) > PART_CHARS):
                yield part, texts, np.array(labels, np.float32), own != part
                texts, labels, size = [], [], 0
            part = own
            texts.append(text)
            labels.append(label)
            size += len(text)
    if texts:
        yield part, texts, np.array(labels, np.float32), True


def _round(rows: DataFrame, model: dict, share: float, rates: list[float], seed: int) -> dict:
    """Every part goes on from ``model``; the mean of their changes is added to it. Only that comes
    to the driver, as large as the model."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(frames):
        local = None
        for part, texts, labels, ends in _parts(frames):
            local = local or Descent(shipped.value, share, seed + part)
            local.passes(texts, labels, rates)
            if ends:
                yield local.changes(shipped.value, part)
                local = None

    schema = "piece int, part int, rows binary, weight binary, change binary"
    with arrow_rows(spark, 1000):
        changes = rows.mapInPandas(run, schema).repartition(16, "piece").sortWithinPartitions("piece", "part")
        means = changes.mapInPandas(_averaged, schema).collect()
    shipped.destroy()
    return _moved(model, means)


def _thresholds(rows: DataFrame, model: dict, least: int) -> dict:
    """Thresholds by language, of languages with ``least`` rows of each label, and of all rows together.
    Tasks send counts by language, cut logit and label, of which there are boundedly many."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                words = Words(part.column(0).to_pylist())
                place = np.floor(np.clip(logits(words, shipped.value), -30, 30) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.languages, pa.string()), pa.array(place, pa.int32()), part.column(1)],
                    ["language", "place", "toxic"],
                )

    with arrow_rows(spark, 1000):
        found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "language string, place int, toxic int")
        found = found.groupBy("language", "place").agg(
            F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")
        ).toPandas()
    shipped.destroy()
    out = {}
    for language in ["", *FUNCTION_WORDS]:
        own = found if not language else found[found["language"] == language]
        own = own.groupby("place")[["toxic", "clean"]].sum().sort_index()
        if not language or min(own["toxic"].sum(), own["clean"].sum()) >= least:
            out[language] = best_threshold((own.index.to_numpy() + 0.5) / GRID, own["toxic"].to_numpy(), own["clean"].to_numpy())
    return out


def _marked(texts: DataFrame, usable: DataFrame) -> DataFrame:
    """``texts`` without most rows that ``usable`` does not have: a bitmap of hashed ids, of fixed
    size, is held against them, so that the join after it shuffles few other texts."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marks = usable.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_marks")
    )
    near = texts.withColumns({"_bucket": F.bitmap_bucket_number(spot), "_bit": F.bitmap_bit_position(spot)})
    found = near.join(F.broadcast(marks), "_bucket")
    byte = F.expr("CAST(conv(hex(substring(_marks, CAST(_bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    return found.filter(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0).select(*texts.columns)


def _labelled(texts: DataFrame, usable: DataFrame, parts: int) -> DataFrame:
    """(part, spot, doc_id, text, toxic) of the texts that ``usable`` labels, dealt by part. Labels are
    dealt like the texts and meet them there, so that a text is shuffled once: a join by id and the
    dealing after it would shuffle it twice, on large tables only."""
    sides = texts.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")).unionByName(
        usable.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    )
    spot = F.xxhash64("doc_id")
    dealt = sides.withColumns({"spot": spot, "part": F.pmod(spot, F.lit(parts)).cast("int")}).repartition(parts, "part")
    # Of an id its label comes first; null ids have none, as ``usable`` has no null id.
    by_id = Window.partitionBy("part", "spot", "doc_id").orderBy(F.col("text").isNotNull())
    met = dealt.withColumn("toxic", F.first("toxic", ignorenulls=True).over(by_id))
    return met.filter("text IS NOT NULL AND toxic IS NOT NULL").select("part", "spot", "doc_id", "text", "toxic")


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, part_rows: int = PART_ROWS, rounds: int = 3, steps: int = 1500, least: int = 40,
    seed: int = 5,
) -> bytes:
    """Fit on whole texts of all labelled rows in folds other than 0; the model, pickled.

    Four fifths (by the text's hash) are fitted, at least 6 passes and in a single part at least
    ``steps`` steps; thresholds come from the rest.
    """
    usable = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(fold() != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents(docs).filter(fold() != 0)
    parts = max(1, -(-texts.select("doc_id").join(usable, "doc_id").count() // part_rows))
    spot = F.xxhash64("doc_id")
    rows = _labelled(_marked(texts, usable), usable, parts)
    rows = rows.select("part", "text", "toxic", (fold("text") == 0).alias("apart"), "spot")
    # Every round reads the rows: a part is a file.
    rows = written(rows.sortWithinPartitions("part", "spot", "text"), "labelled", by=["part"])
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("apart", "toxic").count().collect()}
    kinds = {label for _, label in sizes}
    if len(kinds) < 2:
        return pickle.dumps({"constant": float(kinds.pop()) if kinds else 0.0})
    fitted = rows if len(sizes) < 4 else rows.filter("NOT apart")
    n = {label: sum(c for (a, k), c in sizes.items() if k == label and (len(sizes) < 4 or not a)) for label in kinds}
    count, share = sum(n.values()), n[1] / sum(n.values())
    model, rounds = initial(seed), rounds if parts > 1 else 1
    epochs = 6 if parts > 1 else max(6, -(-steps // -(-count // BATCH)))
    rates = [0.01 * (1 - k / (epochs + 1)) for k in range(epochs)]
    for own in np.array_split(rates, rounds):
        model = _round(fitted.select("part", "text", "toxic"), model, share, own.tolist(), seed)
        seed += parts
    model["thresholds"] = _thresholds(rows.filter("apart"), model, least) if len(sizes) == 4 else {"": 0.0}
    return pickle.dumps(model)


fit_on_sample = fit_on_labels  # its name before it was fitted on all rows


def scores(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text.

    A null or empty text is scored like a text without words. A model fitted on one
    label only scores that label's share everywhere; without labelled rows the score
    is 0. Repeated rows give repeated rows, an empty table gives none, other columns
    are ignored.
    """

    def run(batches):
        loaded = pickle.loads(model)
        for ids, texts in slices(batches, 4_000_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(score_texts(texts, loaded), pa.float64())],
                ["doc_id", "score"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: bytes, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``limit``, with all their columns, in one pass."""
    place = docs.columns.index("text")

    def run(batches):
        loaded = pickle.loads(model)
        for batch in batches:
            rows = max(1, min(500, 8_000_000 * batch.num_rows // max(1, batch.column(place).nbytes)))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(score_texts(texts, loaded) < limit))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", (fold() == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
