"""Removal of long repeated byte strings by suffix sorting.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere
else. Sorting all suffixes of a corpus would move every suffix's text, so the corpus is
first divided by content:

- Each string of ``length`` bytes (a window) belongs to the gram of ``gram`` bytes in it
  with the least hash, leftmost of ties. Equal windows hold the same gram at the same
  place, so they meet under its hash. Neighbouring windows of one gram are one span.
- Grams seen once are done with. Equal spans are counted, not repeated.
- A span that is the only one of its gram and was seen twice is repeated as a whole. The
  spans of other grams go to suffix sorting, many grams to a batch, a gram whole.
- A gram with more than ``CROWD`` different spans is divided further: each of its windows
  is a span of its own, under the digest of all its bytes, and equal ones are counted.

Suffix sorting takes two stages: suffixes smaller than their successor are sorted
directly, all others are put in place by one scan over the buckets of first bytes. Then
the common prefixes of neighbours are measured, on the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

LENGTH, GRAM, CROWD = 400, 128, 2000
PIECE = 8_000_000  # bytes of a text looked at together; pieces overlap by a window
BATCH = 2_000_000  # bytes sorted together
_BASE = 0x9E3779B97F4A7C15
_BITS = np.uint64(0xFFFFFF)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash and inverse powers: a substring's hash in one step."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=total[1:])
    return total, _powers(len(data) + 1, pow(_BASE, -1, 2**64))


def spans_of(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """(text number, gram hash, first and last window start) of all spans of some texts.

    ``data`` holds the texts one after the other, at most 2**24 bytes.
    """
    if len(data) < length:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    total, inverse = _running(data)
    grams = (total[gram:] - total[:-gram]) * inverse[: len(data) - gram + 1]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    # Least gram of each window, by doubling; the place breaks ties to the left.
    least = (grams & ~_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    anchor = (least & _BITS).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (begin + sizes)[owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    return owner[first], grams[anchor[first]], first, stop


def _pieces(ids, versions, texts, length: int):
    """Groups of texts of at most PIECE bytes together; longer texts in overlapping pieces."""
    group, size = [], 0
    for i, v, raw in zip(ids, versions, texts):
        for lo in range(0, max(1, len(raw) - length + 1), PIECE):
            part = raw[lo : lo + PIECE + length - 1]
            if group and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, v, lo, part))
            size += len(part)
    if group:
        yield group


def _read(batches):
    """(ids, versions, texts in UTF-8) of bounded slices; columns id, version, text."""
    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)]
        lo = size = 0
        for hi in range(batch.num_rows):
            size += len(columns[2][hi].as_buffer() or b"")
            if size >= PIECE // 2 or hi + 1 == batch.num_rows:
                texts = [t.encode("utf-8", "surrogatepass") for t in columns[2].slice(lo, hi + 1 - lo).to_pylist()]
                yield columns[0][lo : hi + 1], columns[1][lo : hi + 1], texts
                lo, size = hi + 1, 0


def _groups(batches, length: int, gram: int):
    for ids, versions, texts in _read(batches):
        for group in _pieces(ids, versions, texts, length):
            raw = b"".join(p for *_, p in group)
            sizes = np.fromiter((len(p) for *_, p in group), np.int64, len(group))
            begin = np.cumsum(sizes) - sizes
            yield group, raw, begin, spans_of(np.frombuffer(raw, np.uint8), begin, sizes, length, gram)


def grams_of(plain: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for _, _, _, (_, grams, _, _) in _groups(batches, length, gram):
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return plain.mapInArrow(run, "gram long")


def places_of(plain: DataFrame, length: int, gram: int) -> DataFrame:
    """id, version, gram, digest of the span's bytes, first and last window start."""

    def run(batches):
        for group, raw, begin, (owner, grams, first, last) in _groups(batches, length, gram):
            view = memoryview(raw)
            digest = [
                xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())
            ]
            ids, versions = [g[0] for g in group], [g[1] for g in group]
            shift = np.fromiter((g[2] for g in group), np.int64, len(group)) - begin
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in owner.tolist()], pa.int64()),
                pa.array([versions[k] for k in owner.tolist()], pa.int64()),
                pa.array(grams.view(np.int64)),
                pa.array(np.array(digest, np.uint64).view(np.int64)),
                pa.array((first + shift[owner]).astype(np.int32)),
                pa.array((last + shift[owner]).astype(np.int32)),
            ], ["id", "version", "gram", "digest", "first", "last"])

    return plain.mapInArrow(run, "id long, version long, gram long, digest long, first int, last int")


# ---------------------------------------------------------------- suffix sorting


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as such."""
    step = np.sign(np.diff(data.astype(np.int16), append=np.int16(256)))
    place = np.where(step != 0, np.arange(len(data)), len(data) - 1)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


class Sorter:
    """Suffixes of a text of byte values plus one; value 0 ends a part. Compared to ``depth``."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
        self.eight = np.zeros(len(padded) - 8, np.uint64)
        for k in range(8):
            self.eight |= padded[k : k + len(self.eight)].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.total, self.inverse = _running(padded)
        ends = np.flatnonzero(data == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(data)))] - np.arange(len(data))

    def _same(self, a, b, n):
        return (self.total[a + n] - self.total[a]) * self.inverse[a] == (self.total[b + n] - self.total[b]) * self.inverse[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix by halving, never over the end of a part."""
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.depth)
        low = np.where(self._same(a, b, most), most, 0)
        rest = np.flatnonzero(low < most)
        lo, hi, x, y = low[rest], most[rest] - 1, a[rest], b[rest]
        while len(rest) and (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._same(x, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[rest] = lo
        return low

    def direct(self, at: np.ndarray) -> np.ndarray:
        """Sort suffixes by their first ``depth`` values: eight at once, then against the
        first of each tied group, which tells every other's place by common prefix and side."""
        order = at[np.argsort(self.eight[at], kind="stable")]
        key = self.eight[order]
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        place = np.arange(len(order))  # where each still tied suffix stands
        tied = order
        while True:
            size = np.bincount(group)
            many = size[group] > 1
            place, tied, group = place[many], tied[many], group[many]
            if not len(tied):
                return order
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            number = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
            leader = tied[heads][number]
            shared = self.common(tied, leader)
            one, two = self.data[np.minimum(tied + shared, len(self.data) - 1)], self.data[np.minimum(leader + shared, len(self.data) - 1)]
            equal = (shared >= self.depth) | (one == two)
            side = np.where(equal, self.depth, np.where(one < two, shared, 3 * self.depth - shared))
            after = np.where(equal, np.uint64(0), self.eight[np.minimum(tied + shared, len(self.eight) - 1)])
            by = np.lexsort((after, side, number))
            tied = tied[by]
            order[place] = tied
            side, after, number, equal = side[by], after[by], number[by], equal[by]
            new = np.concatenate([[True], (number[1:] != number[:-1]) | (side[1:] != side[:-1]) | (after[1:] != after[:-1])])
            group = np.cumsum(new) - 1
            open_ = ~equal
            place, tied, group = place[open_], tied[open_], group[open_]
            if len(group):
                group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1

    def suffixes(self) -> np.ndarray:
        """All suffixes, sorted by at least their first ``depth`` values."""
        data, small = self.data, smaller_than_next(self.data)
        ends = np.flatnonzero(data == 0)
        straight = self.direct(np.flatnonzero(small & (data > 0)))
        firsts = data[straight]
        values = np.flatnonzero(np.bincount(data, minlength=256))
        waiting: dict[int, list[np.ndarray]] = {}
        out = []

        def scan(found: np.ndarray, value: int) -> np.ndarray:
            """Put the predecessors of a scanned stretch in their buckets; return those of this one."""
            before = found[found > 0] - 1
            before = before[~small[before] & (data[before] > 0)]
            own = data[before]
            later = own > value
            for v, part in _by_value(before[later], own[later]):
                waiting.setdefault(v, []).append(part)
            return before[own == value]

        for value in values.tolist():
            stretch = np.concatenate(waiting.pop(value)) if value in waiting else np.empty(0, np.int64)
            while len(stretch):
                out.append(stretch)
                stretch = scan(stretch, value)
            own = ends if value == 0 else straight[np.searchsorted(firsts, value) : np.searchsorted(firsts, value, "right")]
            if len(own):
                out.append(own)
                scan(own, value)
        return np.concatenate(out)


def _by_value(items: np.ndarray, values: np.ndarray):
    if not len(items):
        return
    order = np.argsort(values, kind="stable")
    items, values = items[order], values[order]
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    for part, v in zip(np.split(items, cuts), values[np.concatenate([[0], cuts])].tolist()):
        yield v, part


def repeated_starts(parts: list[bytes], owned: list[int], weights: list[int], length: int) -> list[np.ndarray]:
    """For each part, which of its first ``owned`` positions start a string of ``length``
    bytes that starts at another owned position too, or lies in a part seen more than once."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    begin = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)  # 0xff never occurs in UTF-8
    sorter = Sorter(joined, length)
    owner = np.repeat(np.arange(len(parts)), sizes)
    own = np.arange(len(joined)) - begin[owner] < np.asarray(owned)[owner]
    ranked = sorter.suffixes()
    ranked = ranked[own[ranked]]
    # Common prefixes of neighbours, eight bytes at a time, on the bytes themselves.
    a, b = ranked[:-1], ranked[1:]
    alike = np.arange(len(a))
    for k in range(0, length, 8):
        shift = min(k, max(length - 8, 0))
        alike = alike[sorter.eight[a[alike] + shift] == sorter.eight[b[alike] + shift]]
    found = np.zeros(len(joined), bool)
    found[a[alike]] = True
    found[b[alike]] = True
    found |= (np.asarray(weights) > 1)[owner] & own
    return [found[s : s + n] for s, n in zip(begin.tolist(), owned)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _sort_batches(length: int):
    """Rows gram, digest, n, owned, bytes in gram order -> gram, digest, from, upto."""

    def flush(rows):
        flags = repeated_starts([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length)
        found = [(r[0], r[1], a, b) for r, f in zip(rows, flags) for a, b in runs(f)]
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "digest", "from", "upto"]
        )

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > BATCH and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield flush(rows)

    return run


def _cut(length: int):
    """Texts with wanted spans -> the spans' bytes."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for text, asked in zip(batch.column(0), batch.column(1)):
                raw = memoryview(text.as_py().encode("utf-8", "surrogatepass"))
                for ask in asked.as_py():
                    part = bytes(raw[ask["first"] : ask["last"] + length])
                    out.append((ask["gram"], ask["digest"], ask["n"], ask["last"] - ask["first"] + 1, part))
                    size += len(part)
                if size > BATCH:
                    yield _rows(out, ("gram", "digest", "n", "owned", "bytes"))
                    out, size = [], 0
            if out:
                yield _rows(out, ("gram", "digest", "n", "owned", "bytes"))

    return run


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"owned": pa.int32(), "at": pa.int32(), "bytes": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], list(names)
    )


def _windows(length: int):
    """Texts with wanted spans -> every window's digest (two words) and place in its span."""
    names = ("gram", "digest", "n", "at", "high", "low")

    def run(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0), batch.column(1)):
                raw = memoryview(text.as_py().encode("utf-8", "surrogatepass"))
                for ask in asked.as_py():
                    for k in range(ask["last"] - ask["first"] + 1):
                        at = ask["first"] + k
                        full = xxhash.xxh3_128_intdigest(raw[at : at + length])
                        out.append((ask["gram"], ask["digest"], ask["n"], k, (full >> 64) - 2**63, (full & (2**64 - 1)) - 2**63))
                    if len(out) > 50_000:
                        yield _rows(out, names)
                        out = []
            if out:
                yield _rows(out, names)

    return run


def repeated_spans(plain: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """id, version, from, upto: byte ranges (upto exclusive) that repeated windows cover."""
    # Counts by gram are written before they are joined, so that the join can split a hot gram.
    twice = grams_of(plain, length, gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = written(twice.select("gram"), "twice")
    places = written(places_of(plain, length, gram).join(twice, "gram", "left_semi"), "places")
    spans = written(
        places.groupBy("gram", "digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "version", "first", "last")).alias("one")
        ), "spans",
    )
    kinds = written(spans.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    ranked = written(spans.join(kinds, "gram"), "ranked")
    whole = ranked.filter("kinds = 1").select(
        "gram", "digest", F.lit(0).alias("from"), (F.col("one.last") - F.col("one.first")).alias("upto")
    )

    def asked(which: str) -> DataFrame:
        wanted = ranked.filter(which).groupBy("one.id", "one.version").agg(
            F.collect_list(F.struct("gram", "digest", "n", "one.first", "one.last")).alias("asked")
        )
        return plain.join(wanted, ["id", "version"]).select("text", "asked")

    parts = asked(f"kinds BETWEEN 2 AND {crowd}").mapInArrow(
        _cut(length), "gram long, digest long, n long, owned int, bytes binary"
    )
    found = written(
        parts.repartition("gram").sortWithinPartitions("gram").mapInArrow(
            _sort_batches(length), "gram long, digest long, from int, upto int"
        ), "found",
    )
    answers = whole.unionByName(found)
    if not ranked.filter(f"kinds > {crowd}").isEmpty():
        windows = written(asked(f"kinds > {crowd}").mapInArrow(
            _windows(length), "gram long, digest long, n long, at int, high long, low long"
        ), "windows")
        again = windows.groupBy("high", "low").agg(F.sum("n").alias("all")).filter("all > 1").drop("all")
        crowded = windows.join(again, ["high", "low"], "left_semi")
        answers = answers.unionByName(
            crowded.select("gram", "digest", F.col("at").alias("from"), F.col("at").alias("upto"))
        )
    return places.join(answers, ["gram", "digest"]).select(
        "id", "version", (F.col("first") + F.col("from")).alias("from"),
        (F.col("first") + F.col("upto") + length).alias("upto"),
    )


def _strip(batches):
    schema = ("doc_id", "kept", "n_bytes", "n_removed", "removed_from", "removed_upto")
    for batch in batches:
        out, size = [], 0
        for k, (doc, text, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, b in sorted((s["from"], s["upto"]) for s in spans.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *[x for span in merged for x in span], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc, kept, len(raw), len(raw) - len(kept), [a for a, _ in merged], [b for _, b in merged]))
            size += len(raw)
            if size > BATCH or k + 1 == batch.num_rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], list(schema))
                out, size = [], 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, removed_from, removed_upto.

    Repeats are judged on the input, matches stay inside a document and may overlap. A
    null text is empty; texts shorter than ``length`` lose nothing. Rows that repeat an
    id are documents of their own: equal rows lose all windows. An empty table gives an
    empty result; other columns are ignored. ``length`` is at least 8 and over ``gram``.
    """
    # The version tells apart rows that share an id; a null id is told by it alone.
    plain = documents(docs).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("version"), "text"
    )
    spans = repeated_spans(plain, length, gram, crowd).groupBy("id", "version").agg(
        F.collect_set(F.struct("from", "upto")).alias("spans")
    )
    joined = plain.join(spans, ["id", "version"], "left").select(
        F.expr(f"nullif(id, {-(2**63) + 1} - 1)").alias("doc_id"), "text", "spans"
    )
    return joined.mapInArrow(
        _strip, "doc_id long, kept binary, n_bytes long, n_removed long, removed_from array<int>, removed_upto array<int>"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_from").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.length("kept").cast("long").alias("kept_bytes"), (F.col("n_removed") > 0).alias("repeated"),
    )
