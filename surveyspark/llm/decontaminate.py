"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Spark builds the postings (item, word, impact) from statistics over all items. Every text is
cut into overlapping passages, each one a query. A pair of text and item is found
if some window of the text, as long as the item allows (``window``), passes the
verification on its words. Passages are cut so that every window lies whole in one of
them, whatever the item and wherever it starts.

An item's threshold is its own score less the impacts of as many of its words as may be
missing from a window that still passes, so the search loses no pair. Items lie in runs of
similar threshold, and each word's postings in blocks, one a run, with their largest
impact. For a batch of passages:

1. the pivot of a passage is the word at which the sums of its words' largest impacts,
   smallest first, reach the least threshold. An item with none of the words from there
   on cannot reach it: only runs that hold one of these are looked at;
2. of these, runs whose block maxima add up to less than their least threshold are skipped;
3. the postings of the rest are added up, and items that reach their threshold verified.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents, id_of, row_key, table, written

SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
RUN = 8  # items whose block maxima are summed together
STRETCH, SPARE = 2, 32  # a window has so many times the words of its item, and so many more
ROWS = 2_000_000  # blocks or postings unfolded at once
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: an item's last sentence, if it has several."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) < 2:
        return list(itertools.chain.from_iterable(sentences)), []
    return list(itertools.chain.from_iterable(sentences[:-1])), sentences[-1]


def shingles(words: list[str], size: int = SHINGLE) -> list[tuple[str, ...]]:
    """All runs of ``size`` words in order; the whole sequence if there are fewer."""
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def may_miss(question: list[str], answer: list[str]) -> int:
    """How many words a passage can lack and still pass: each lacking word costs a shingle."""
    n = len(shingles(question))
    lost = n - math.ceil(OVERLAP * n - 1e-9)
    return lost + len(answer) - math.ceil(OVERLAP * len(answer) - 1e-9)


def window(size: int) -> int:
    """Words of text in which an item of ``size`` words has to be found."""
    return STRETCH * size + SPARE


def postings(items: DataFrame) -> DataFrame:
    """item, word, impact: BM25 weight of the word in the item, over all items."""

    def split(frames):
        for frame in frames:
            found = [(i, w) for i, t in zip(frame["item"], frame["text"]) for w in words_of(t)]
            yield pd.DataFrame(found, columns=["item", "word"])

    words = items.select("item", "text").mapInPandas(split, "item string, word string")
    counts = words.groupBy("item", "word").agg(F.count(F.lit(1)).alias("tf"))
    sizes = counts.groupBy("item").agg(F.sum("tf").alias("size"))
    spread = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total, mean = sizes.agg(F.count(F.lit(1)), F.coalesce(F.avg("size"), F.lit(1.0))).first()
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("size") / mean)
    return (
        counts.join(sizes, "item").join(spread, "word")
        .select("item", "word", "size", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("impact"))
    )


def index_data(items: list[tuple[str, str]], found: pd.DataFrame) -> tuple:
    """One block of the inverted index as plain lists and arrays, to be shipped to tasks."""
    own = dict(tuple(found.groupby("item")["impact"]))
    entries = []
    for item, text in items:
        question, answer = parts(text)
        if item in own:
            impacts = np.sort(own[item].to_numpy())[::-1]
            entries.append((impacts[may_miss(question, answer) :].sum() - 1e-9, item, question, answer))
    entries.sort(key=lambda e: (e[0], e[1]))
    limits = np.array([e[0] for e in entries])
    place = {e[1]: k for k, e in enumerate(entries)}
    codes, names = pd.factorize(found["word"])
    at, impact = found["item"].map(place).to_numpy(np.int64), found["impact"].to_numpy(float)
    order = np.lexsort((at, codes))
    return entries, limits, list(names), codes[order], at[order], impact[order]


def unfolded(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and which range each is of."""
    sizes = stops - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), owner


class Index:
    """One block of the inverted index; made in the task from ``index_data``."""

    def __init__(self, data: tuple):
        self.entries, self.limits, names, codes, self.items, self.impacts = data
        self.terms = {w: k for k, w in enumerate(names)}
        # Posting blocks: the postings of one word in one run of items.
        run = self.items // RUN
        heads = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
        self.block_run, self.block_start = run[heads], np.append(heads, len(codes))
        self.block_most = np.maximum.reduceat(self.impacts, heads) if len(heads) else np.empty(0)
        self.term_start = np.searchsorted(codes[heads], np.arange(len(names) + 1))
        self.term_most = np.zeros(len(names))
        np.maximum.at(self.term_most, codes, self.impacts)
        firsts = np.arange(0, len(self.limits), RUN)
        self.run_limits = np.minimum.reduceat(self.limits, firsts) if len(firsts) else np.empty(0)
        self.scored = 0  # postings added up so far
        self.word_codes = [tuple([self.terms[w] for w in q] for q in e[2:]) for e in self.entries]
        self.own: dict[int, dict[int, float]] = {}

    def candidates(self, term: np.ndarray, passage: np.ndarray) -> list[tuple[int, int]]:
        """(passage, item place) that reach the item's threshold; one row a distinct term of a
        passage, passages in order."""
        out = []
        load = np.cumsum(self.term_start[term + 1] - self.term_start[term])
        heads = np.flatnonzero(np.diff(passage, prepend=-1))
        lo = 0
        while lo < len(heads):  # so many passages that their blocks fit
            done = load[heads[lo] - 1] if heads[lo] else 0
            ends = load[np.append(heads[lo + 1 :], len(term)) - 1]
            hi = lo + max(1, int(np.searchsorted(ends, done + ROWS, side="right")))
            rows = slice(heads[lo], heads[hi] if hi < len(heads) else len(term))
            out += self._candidates(term[rows], passage[rows])
            lo = hi
        return out

    def _candidates(self, term: np.ndarray, passage: np.ndarray) -> list[tuple[int, int]]:
        runs = len(self.run_limits)
        first = passage[0]
        own = passage - first
        # The pivot: words below it cannot reach the least threshold together.
        most = self.term_most[term]
        order = np.lexsort((most, own))
        sums = np.cumsum(most[order])
        heads = np.flatnonzero(np.diff(own[order], prepend=-1))
        base = np.concatenate([[0.0], sums])[heads]
        reached = np.empty(len(term), bool)
        reached[order] = sums - np.repeat(base, np.diff(np.append(heads, len(term)))) >= self.limits[0] * (1 - 1e-9)
        block, row = unfolded(self.term_start[term], self.term_start[term + 1])
        key = own[row] * runs + self.block_run[block]
        looked = np.zeros((own[-1] + 1) * runs, bool)
        looked[key[reached[row]]] = True
        bound = np.bincount(key, self.block_most[block], len(looked))
        looked &= bound >= np.tile(self.run_limits, own[-1] + 1) * (1 - 1e-9)
        live = looked[key]
        block, key = block[live], key[live]
        if not len(block):
            return []
        order = np.argsort(key, kind="stable")
        block, key = block[order], key[order]
        at, row = unfolded(self.block_start[block], self.block_start[block + 1])
        self.scored += len(at)
        pair, place = np.unique(key[row] // runs * len(self.limits) + self.items[at], return_inverse=True)
        score = np.bincount(place, self.impacts[at])
        item = pair % len(self.limits)
        hit = score >= self.limits[item] * (1 - 1e-12)
        return list(zip((pair[hit] // len(self.limits) + first).tolist(), item[hit].tolist()))

    def verified(self, codes: list[int], place: int) -> tuple[int, float, float, float] | None:
        """(first word, score, question overlap, answer overlap) of the first window of a
        passage that passes, None if none does."""
        question, answer = self.word_codes[place]
        length = window(len(question) + len(answer))
        size = min(SHINGLE, len(question))
        wanted = Counter(shingles(question, size)) if size else Counter()
        needs = Counter(answer)
        found: dict[object, list[int]] = {}
        for k, code in enumerate(codes):
            if size and (piece := tuple(codes[k : k + size])) in wanted:
                found.setdefault(piece, []).append(k)
            if code in needs:
                found.setdefault(code, []).append(k)
        # A window that passes can be moved on to the first thing of the item in it.
        for start in sorted({k for own in found.values() for k in own}):
            held = {
                name for name, own in found.items()
                if (k := bisect.bisect_left(own, start)) < len(own)
                and own[k] + (size if isinstance(name, tuple) else 1) <= start + length
            }
            shares = [
                sum(n for name, n in parts_.items() if name in held) / parts_.total() if parts_ else 1.0
                for parts_ in (wanted, needs)
            ]
            if min(shares) >= OVERLAP - 1e-9:
                if place not in self.own:
                    at = np.flatnonzero(self.items == place)
                    terms = np.searchsorted(self.block_start, at, side="right") - 1
                    names = np.searchsorted(self.term_start, terms, side="right") - 1
                    self.own[place] = dict(zip(names.tolist(), self.impacts[at].tolist()))
                own = self.own[place]
                score = sum(own.get(c, 0.0) for c in sorted(set(codes[start : start + length])))
                return start, score, *shares
        return None

    def search(self, texts: list[str], longest: int):
        """(text number, item, first word, score, question overlap, answer overlap) of each pair's
        first window. ``longest``: words of the longest of all items, not only this block's."""
        stride = window(longest)
        length = 2 * stride
        split = [words_of(t) for t in texts]
        flat = np.array([self.terms.get(w, -1) for w in itertools.chain.from_iterable(split)], np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(sizes) - sizes
        counts = np.maximum(1, -(-sizes // stride) - 1)
        owner = np.repeat(np.arange(len(texts)), counts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
        span = np.minimum(length, sizes[owner] - first)
        places, passage = unfolded(begin[owner] + first, begin[owner] + first + span)
        term = flat[places]
        width = len(self.terms) + 1
        known = term >= 0
        pairs = np.unique(passage[known] * width + term[known])
        best: dict[tuple[int, int], tuple] = {}
        for p, place in self.candidates(pairs % width, pairs // width) if len(pairs) else ():
            text, at = int(owner[p]), int(first[p])
            if (text, place) in best:  # passages come in order: an earlier window was found
                continue
            # Windows that begin in the passage are seen to their end.
            codes = flat[begin[text] + at : begin[text] + min(at + length + stride, sizes[text])].tolist()
            if (found := self.verified(codes, place)) is not None:
                best[text, place] = (at + found[0], *found[1:])
        return [(text, self.entries[place][1], *rest) for (text, place), rest in best.items()]


def found_rows(docs: DataFrame, benchmark: DataFrame, block_items: int = 50_000) -> DataFrame:
    """row and item (their keys) of pairs with first_word and bm25 of the first window and both overlaps.

    A pair is found if a window of the text holds at least 0.8 of the question's five-word
    shingles (with fewer words the whole question) and 0.8 of the answer's words; words
    are runs of letters, digits and underscores, lower-cased. A window has twice the words of
    the item and 32 more. Rows of the benchmark are items of their own by id and text, null
    and repeated ids too. Null or empty texts and items without words match nothing. An empty
    table gives an empty result; other columns are ignored. A pass over ``docs`` serves
    ``block_items`` items: neither the driver nor a task holds more of the index.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").select(
        F.concat(F.sha2("text", 256), F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("item"), "text"
    ).distinct()
    weights = written(postings(items), "postings")
    count, longest = weights.agg(F.count_distinct("item"), F.coalesce(F.max("size"), F.lit(1))).first()
    blocks = max(1, -(-count // block_items))
    shard = F.pmod(F.xxhash64("item"), F.lit(blocks))
    plain = documents(docs).select(row_key().alias("row"), "text")
    schema = "row string, item string, first_word long, bm25 double, question_overlap double, answer_overlap double"
    found = []
    for k in range(blocks):
        part = items.filter(shard == k).collect()
        data = index_data([(r[0], r[1]) for r in part], weights.filter(shard == k).toPandas())
        found.append(plain.mapInArrow(_searcher(spark.sparkContext.broadcast(data), longest), schema))
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = 50_000) -> DataFrame:
    """Pairs doc_id, item_id as ``found_rows`` has them, the best score of equal pairs."""
    pairs = found_rows(docs, benchmark, block_items).withColumns({"doc_id": id_of("row"), "item_id": id_of("item")})
    best = F.max_by(F.struct("first_word", "bm25", "question_overlap", "answer_overlap"), F.struct("bm25", "first_word"))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _searcher(shipped, longest: int):
    def run(batches):
        index = Index(shipped.value)
        for ids, texts in slices(batches, 2_000_000):
            rows = index.search(texts, longest) if index.entries else []
            columns = list(zip(*[(ids[text], *rest) for text, *rest in rows])) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ("row", "item", "first_word", "bm25", "question_overlap", "answer_overlap")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    hit = found_rows(docs, benchmark).select(F.col("row").alias("_hit")).distinct()
    return docs.join(hit, row_key() == hit["_hit"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
