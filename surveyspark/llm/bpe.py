"""Byte-pair encoding of whole texts with a public word-level BPE vocabulary.

A partition is read in slices. The distinct pre-tokens of a slice that were not met
before are laid out as one symbol array; a pair index maps each mergeable pair's rank
to all its positions there. Ranks are applied in ascending order, each to all its
positions at once, and only the lists of pairs next to a merge are updated. Texts are
then put together from their pre-tokens' pieces.

Supported are ``tokenizers`` files of this kind: BPE model with an end-of-word suffix,
normalizer NFC + white space + lower case, split by pattern, byte-level alphabet, no
decoder (tokens are joined by one space). Added tokens are found in the raw text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SLICE_CHARS = 2_000_000  # text worked on and handed back at once
MEMORY = 400_000  # pre-tokens remembered by a task before it starts afresh ...
MEMORY_CHARS = 4_000_000  # ... and their length


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def newer_signs(source: str) -> tuple[str, dict[int, str]]:
    """What the tokenizers library makes of letters and numbers newer than Python's tables.

    A character class of those that it takes for other signs, though the pattern
    library knows them, and their lower case where it knows one that Python does not.
    Asked once, on the driver.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    signs: list[list[int]] = []
    lower: dict[int, str] = {}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for char in regex.findall(r"[\p{L}\p{N}]", everything):
        if unicodedata.category(char)[0] in "LN":
            continue
        if (normal := library.normalizer.normalize_str(char)) != char:
            lower[ord(char)] = normal
        if len(library.pre_tokenizer.pre_tokenize_str(char + "!")) == 1:
            if signs and signs[-1][1] == ord(char) - 1:
                signs[-1][1] = ord(char)
            else:
                signs.append([ord(char), ord(char)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in signs), lower


class WordBpe:
    """A vocabulary ready to encode pre-tokens; built once per task from the file's text."""

    def __init__(self, source: str, newer: tuple[str, dict[int, str]]):
        spec = json.loads(source)
        model, (split, _) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        suffix = model["end_of_word_suffix"]
        if steps != ["NFC", "Replace", "Lowercase"] or not suffix or spec["decoder"] is not None:
            raise ValueError("not a word-level BPE file of the supported kind")
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self._pattern = regex.compile(split["pattern"]["Regex"])
        signs, self._lower = newer
        letters, numbers = rf"[\p{{L}}--[{signs}]]", rf"[\p{{N}}--[{signs}]]"
        old = split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", "@")
        old = old.replace(r"[\p{L}]", letters).replace(r"[\p{N}]", numbers)
        old = old.replace("@", rf"[[^\s\p{{L}}\p{{N}}]||[{signs}]]")
        self._old = regex.compile(old, regex.V1)
        self._newer = re.compile("[" + signs + "".join(map(chr, self._lower)) + "]")
        names = {i: t for t, i in (vocab | self.added).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        alphabet = byte_alphabet()
        self._inner = np.array([vocab[c] for c in alphabet], np.int32)
        self._final = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._left = np.array([vocab[a] for a, _ in merges], np.int64)
        self._right = np.array([vocab[b] for _, b in merges], np.int64)
        self._merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._width = len(self.names)
        keys = self._left * self._width + self._right
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a whole text in order; added tokens stand as themselves."""
        if "<" not in text:
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self._added.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out.extend(self._words(part))
        return out

    def _words(self, text: str) -> list[str]:
        # One character at a time, capital sigma has one lower case only.
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not lowered.isascii() and self._newer.search(lowered):
            return self._old.findall(lowered.translate(self._lower))
        return self._pattern.findall(lowered)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        keys = left.astype(np.int64) * self._width + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pre-tokens, one after the other, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        total = len(data)
        if not total:
            return np.empty(0, np.int32), sizes
        symbol = self._inner[data]
        symbol[ends - 1] = self._final[data[ends - 1]]
        after = np.arange(1, total + 1)
        after[ends - 1] = -1
        before = np.arange(-1, total - 1)
        before[ends[:-1]] = -1
        before[0] = -1
        alive = np.ones(total, bool)

        # Pair index: rank -> positions of the pair's left symbol.
        first = np.flatnonzero(after >= 0)
        ranks = self._ranks(symbol[first], symbol[first + 1])
        first, ranks = first[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        first, ranks = first[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = np.concatenate([[0], cuts]) if len(ranks) else np.empty(0, np.int64)
        index = {int(ranks[s]): [part] for s, part in zip(starts, np.split(first, cuts))}
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self._left[rank], self._right[rank]
            partner = after[at]
            valid = alive[at] & (symbol[at] == left) & (partner >= 0)
            valid &= symbol[partner] == right
            at = np.unique(at[valid])
            if left == right and len(at) > 1:
                at = _leftmost(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self._merged[rank]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            touched = np.concatenate([ahead[ahead >= 0], at[beyond >= 0]])
            fresh = self._ranks(symbol[touched], symbol[after[touched]])
            touched, fresh = touched[fresh >= 0], fresh[fresh >= 0]
            if not len(fresh):
                continue
            order = np.argsort(fresh, kind="stable")
            touched, fresh = touched[order], fresh[order]
            cuts = (np.flatnonzero(fresh[1:] != fresh[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(fresh)]):
                r = int(fresh[lo])
                if r in index:
                    index[r].append(touched[lo:hi])
                else:
                    index[r] = [touched[lo:hi]]
                    heapq.heappush(active, r)
        owner = np.repeat(np.arange(len(raw)), sizes)
        return symbol[alive], np.bincount(owner[alive], minlength=len(raw))


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of runs of one symbol, every second pair from the left: pairs may not overlap."""
    follows = np.zeros(len(at), bool)
    follows[1:] = after[at[:-1]] == at[1:]
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(follows, 0, place))
    return at[(place - start) % 2 == 0]


def slices(batches, chars: int = SLICE_CHARS):
    """(ids, texts) of about ``chars`` characters from Arrow batches; one text may be larger."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        lo = size = 0
        for hi in range(len(ids)):
            size += len(texts[hi].as_buffer() or b"")
            if size >= chars or hi + 1 == len(ids):
                yield ids[lo : hi + 1], texts.slice(lo, hi + 1 - lo).to_pylist()
                lo, size = hi + 1, 0


class Remembered:
    """Token ids of the pre-tokens met so far, one after the other in one array."""

    def __init__(self, bpe: WordBpe):
        self._bpe = bpe
        self._forget()

    def _forget(self) -> None:
        added = self._bpe.added
        self.place = dict(zip(added, range(len(added))))
        self._tokens = np.fromiter(added.values(), np.int32, len(added))
        self._stops = np.arange(len(added) + 1)
        self._chars = 0

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.place]
        chars = sum(map(len, fresh))
        if len(self.place) + len(fresh) > MEMORY or self._chars + chars > MEMORY_CHARS:
            self._forget()
            fresh = [w for w in words if w not in self.place]
            chars = sum(map(len, fresh))
        tokens, counts = self._bpe.encode_words(fresh)
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self._stops = np.concatenate([self._stops, self._stops[-1] + np.cumsum(counts)])
        self._tokens = np.concatenate([self._tokens, tokens])
        self._chars += chars

    def tokens(self, words: list[str]) -> np.ndarray:
        """Ids of all the words in order."""
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        starts, counts = self._stops[at], self._stops[at + 1] - self._stops[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self._tokens[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (token ids of the whole text) and decoded (their text again), per row.

    As the tokenizers library gives them without added special tokens, truncation or
    padding, and with special tokens kept when decoding. A null or empty text has no
    ids and decodes to the empty string. Repeated rows give repeated rows, an empty
    table gives none, other columns are ignored. Memory is bounded by one slice, or
    by the longest text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    newer = newer_signs(source)

    def run(batches):
        bpe = WordBpe(source, newer)
        names, known = bpe.names, Remembered(bpe)
        for ids, texts in slices(batches):
            split = [bpe.pretokens(t) for t in texts]
            known.learn(set().union(*split))
            found = [known.tokens(doc) for doc in split]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(found))),
                pa.array([" ".join([names[i] for i in doc.tolist()]) for doc in found], pa.string()),
            ], ["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    if docs is None:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
