"""Operator 9: repeated strings of 400 bytes or more, by distributed prefix doubling.

A full suffix array has a position for every byte. Here suffixes are those that begin at
anchors: for each place x, the position of the least hash of 16 bytes within the next w. An
anchor, and the anchors after it, depend only on what stands to their right, so equal strings
have equal chains of anchors. Prefix doubling ranks the strings from an anchor over one, two and
four of the anchors behind it: Spark sorts the pairs of ranks at growing offsets, the order gives
new ranks, and positions whose pair is unique go. With w = (400 - 16) / 5, four
steps end within any 400 bytes that begin up to w before the anchor, so nothing is lost.

What is left is made exact. Each anchor stands for an interval of starts; where the whole
stretch of an interval repeats, all its starts do. The starts at the edges of repeats, and one
copy of each stretch that they could match, are compared by 96 bits of two hashes of their 400 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, dealt_anew, durable, partitions
from terraloom.llm.packed import exchange, mix
from terraloom.llm.word_dedup import _keyed

LENGTH = 400
GRAM = 16
STEPS = 4  # 2 ** rounds of doubling
REACH = (LENGTH - GRAM) // (STEPS + 1)
_LOW = np.uint64(127)
_SPAN = np.uint64(511)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(raw: bytes) -> np.ndarray:
    """A hash of the 16 bytes at every position that has so many."""
    n = len(raw) - GRAM + 1
    x = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = x[:n] * _A
    h ^= x[8 : n + 8] * _B
    h ^= h >> np.uint64(31)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first starts): anchor i serves the starts from first[i] up to first[i + 1]."""
    c = h & ~_LOW
    width = 1
    while 2 * width <= reach:
        c = np.minimum(c[:-width], c[width:] + np.uint64(width))
        width *= 2
    if rest := reach - width:
        c = np.minimum(c[:-rest], c[rest:] + np.uint64(rest))
    at = np.arange(len(c)) + (c & _LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first


def names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for the bytes from each anchor to 16 past the next, its low nine bits the distance."""
    a, b = at[:-1], at[1:]
    out = h[a]
    for r in range(GRAM, REACH, GRAM):
        out = (out ^ (out >> np.uint64(30))) * _B + h[np.minimum(a + r, b)]
    return (mix(out * _A + h[b]) & ~_SPAN) | (b - a).astype(np.uint64)


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)


def _first_names(b: pa.RecordBatch) -> Iterator[tuple]:
    for key, order, text in _rows(b):
        raw = (text.as_py() or "").encode()
        if len(raw) >= LENGTH:
            h = grams(raw)
            at, _ = anchors(h)
            yield key, order, names(h, at), at[:-1].astype(np.int32), None


def _lists(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each list of structs."""
    cuts = column.offsets.to_numpy()
    flat = column.flatten()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    for x, y in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist(), strict=True):
        yield {k: v[x:y] for k, v in fields.items()}


def _paired(rows: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(row_key, at, next, one, two): each place with its rank and that of the place where it ends."""
    for key, at, end, rank in rows:
        if not len(at):
            continue
        j = np.minimum(np.searchsorted(at, end), len(at) - 1)
        ok = at[j] == end
        if ok.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(ok.sum()), key, dtype=np.int64)), pa.array(at[ok]), pa.array(end[j][ok]), pa.array(rank[ok]), pa.array(rank[j][ok])],
                names=["row_key", "at", "next", "one", "two"],
            )


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for key, spots, named in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            at, name = np.frombuffer(spots, dtype=np.int32), np.frombuffer(named, dtype=np.uint64)
            yield key, at, at + (name & _SPAN).astype(np.int32), name.view(np.int64)

    for b in batches:
        yield from _whole(_paired(rows(b)))


def _next_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _whole(_paired((key, x["at"], x["next"], x["rank"]) for key, x in zip(b.column(0).to_pylist(), _lists(b.column(1)), strict=True)))


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in one."""
    found = list(parts)
    if found:
        yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]


@cache
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


class Hasher:
    """Hashes of any stretches of a text, from two running sums."""

    powers: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def __init__(self, raw: bytes) -> None:
        n = len(raw)
        if not Hasher.powers or len(Hasher.powers[0][0]) <= n:
            size = max(1 << 16, 2 * n)
            made = []
            for m in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
                both = []
                for x in (m, pow(m, -1, 1 << 64)):
                    p = np.full(size, x, dtype=np.uint64)
                    p[0] = 1
                    both.append(np.multiply.accumulate(p))
                made.append(tuple(both))
            Hasher.powers = tuple(made)
        b = np.frombuffer(raw, dtype=np.uint8)
        self.sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_table(k)[b] * up[:n], dtype=np.uint64)]) for k, (up, _) in enumerate(Hasher.powers)]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of 64 bits for each stretch, which are told apart by what either sum has."""
        one, two = ((s[end] - s[start]) * down[start] for s, (_, down) in zip(self.sums, Hasher.powers, strict=True))
        size = (end - start).astype(np.uint64) * _C
        return mix(mix(one) + two * _B + size), mix(mix(two ^ size) + one * _A)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row_key, text, places): arrays of (first, last, chain, stretch, check), one item per anchor."""
    seen: set[int] = set()
    for b in batches:
        keys: list[int] = []
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for key, text, places in zip(b.column(0).to_pylist(), b.column(1), _lists(b.column(2)), strict=True):
            if key in seen:  # a repeated row is the same document
                continue
            seen.add(key)
            raw = (text.as_py() or "").encode()
            at, first = anchors(grams(raw))
            end = len(raw) - LENGTH
            last = np.minimum(np.append(first[1:], len(raw)) - 1, end)
            i = np.searchsorted(at, places["at"])
            ok = first[i] <= end
            i, chain = i[ok], places["rank"][ok]
            stretch, check = Hasher(raw).of(first[i], last[i] + LENGTH)
            keys.append(key)
            for x, y in zip(out, (first[i].astype(np.int32), last[i].astype(np.int32), chain, stretch.view(np.int64), check.view(np.int64)), strict=True):
                x.append(y)
        if keys:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out[0]])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists], names=["row_key", "first", "last", "chain", "stretch", "check"])


def _edge_windows(b: pa.RecordBatch) -> Iterator[tuple]:
    for (key, order, text), edges in zip(_rows(b), b.column(3).to_pylist(), strict=True):
        raw = (text.as_py() or "").encode()
        x = np.unique(np.concatenate([np.arange(e["first"], e["last"] + 1) for e in edges]))
        h, check = Hasher(raw).of(x, x + LENGTH)
        yield key, order, h, x.astype(np.int32), None, (check >> np.uint64(32)).astype(np.uint32)


def removed(size: int, whole: list[dict] | None, starts: bytes | None) -> np.ndarray:
    """Which bytes go: those of whole stretches and those of windows that begin at starts."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for e in whole or ():
        edge[e["first"]] += 1
        edge[e["last"] + LENGTH] -= 1
    x = np.frombuffer(starts or b"", dtype=np.int32)
    np.add.at(edge, x, 1)
    np.add.at(edge, x + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _reranked(pairs: DataFrame, steps: Scratch) -> DataFrame:
    """(one, two, rank) for the pairs of ranks that are found twice or more: their places in the order that Spark sorts them into.

    Equal pairs are counted before they are shuffled and sorted, so a pair that a third of all places have is one row.
    """
    seen = steps.keep(pairs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two"))
    order = seen.repartitionByRange(partitions(pairs), "one", "two").sortWithinPartitions("one", "two")
    ranks = steps.keep(order.select(dealt_anew("one").alias("o"), dealt_anew("two").alias("t"), F.monotonically_increasing_id().alias("rank")))
    steps.drop(seen)
    return ranks


def _chains(scan: DataFrame, steps: Scratch) -> DataFrame:
    """(row_key, places): anchors whose next four anchors are as those of another, by prefix doubling.

    The first rank of an anchor is the name of the bytes from it to 16 past the next one. In each
    round Spark sorts the pairs of an anchor's rank and that of the anchor where its string ends, at
    twice the offset of the round before, and places in that order are the new ranks. Anchors whose
    pair is unique go. Rounds end where no anchor is left, or strings of four steps have been told
    apart: they are as long as what any 400 bytes are sure to hold.
    """
    names_of = exchange(scan.sortWithinPartitions("order", "row_key"), _first_names, values=True)
    rows = steps.keep(names_of.dropDuplicates(["row_key"]))
    reach, schema = 1, "row_key long, at int, next int, one long, two long"
    while reach < STEPS:
        pairs = steps.keep(rows.mapInArrow(_first_pairs if reach == 1 else _next_pairs, schema))
        steps.drop(rows)
        ranks = _reranked(pairs, steps)
        known = pairs.join(ranks, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")))
        rows = steps.keep(known.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("at", "next", "rank"))).alias("places")))
        steps.drop(pairs, ranks)
        reach *= 2
    return rows


def _marked(scan: DataFrame, steps: Scratch) -> DataFrame:
    """(row_key, whole, edges): stretches that are found twice or more, and those whose starts must be compared."""
    chains = _chains(scan, steps)
    held = scan.join(chains.hint("shuffle_hash"), "row_key").select("row_key", "text", "places")
    packed = steps.keep(held.mapInArrow(_stretches, "row_key long, first array<int>, last array<int>, chain array<long>, stretch array<long>, check array<long>"))
    steps.drop(chains)
    found = packed.select("row_key", F.inline(F.arrays_zip("first", "last", "chain", "stretch", "check")))
    # How often each stretch is found, and whether its chain has stretches that are found once.
    counts = steps.keep(found.groupBy("chain", "stretch", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "first")).alias("one")))
    single = counts.groupBy(F.col("chain").alias("c")).agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("lone"))
    single = single.select(dealt_anew("c").alias("c"), "kinds", "lone")
    known = counts.join(single, F.col("chain") == F.col("c")).where("n > 1 OR kinds > 1").select(dealt_anew("chain").alias("c"), dealt_anew("stretch").alias("s"), F.col("check").alias("t"), "n", "lone", "one")
    marked = found.join(known, (F.col("chain") == F.col("c")) & (F.col("stretch") == F.col("s")) & (F.col("check") == F.col("t")))
    span = F.struct("first", "last")
    is_one = (F.col("one.row_key") == F.col("row_key")) & (F.col("one.first") == F.col("first"))
    out = steps.keep(
        marked.groupBy("row_key").agg(
            F.collect_list(F.when(F.col("n") > 1, span)).alias("whole"),
            F.collect_list(F.when((F.col("n") == 1) | (F.col("lone") > 0) & is_one, span)).alias("edges"),
        )
    )
    steps.drop(packed, counts)
    return out


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs keyed by row, and (row_key, whole, starts): repeated stretches and window starts."""
    keyed = _keyed(docs, doc_id, text)
    scan = keyed.select("row_key", "order", "text")
    steps = Scratch(docs.sparkSession)
    by_row = _marked(scan, steps)
    edges = scan.join(by_row.where(F.size("edges") > 0).select("row_key", "edges").hint("shuffle_hash"), "row_key")
    starts = exchange(edges.sortWithinPartitions("order", "row_key"), _edge_windows, checked=True)
    starts = steps.keep(starts.groupBy(F.col("row_key").alias("k")).agg(F.max("spots").alias("starts")))
    out = by_row.join(starts, F.col("row_key") == F.col("k"), "left").select("row_key", "whole", "starts")
    found = durable(out.where(F.col("starts").isNotNull() | (F.size("whole") > 0)))
    steps.close()
    return keyed, found


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, spans, digest = [], [], [], []
        for text, whole, starts in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            n.append(len(raw))
            if not whole and not starts:
                gone.append(0)
                spans.append(0)
                digest.append(hashlib.sha256(raw).hexdigest())
                continue
            out = removed(len(raw), whole, starts)
            gone.append(int(out.sum()))
            spans.append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
            digest.append(hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~out].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, whole, starts in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            out.append(np.frombuffer(raw, dtype=np.uint8)[~removed(len(raw), whole, starts)].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "kept"])


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    keyed, found = repeats(docs, doc_id, text)
    return keyed.join(found.hint("shuffle_hash"), "row_key", "left").select("doc_id", "text", "whole", "starts")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept): every row's remaining bytes, which may begin or end inside a character."""
    return _joined(docs, doc_id, text).mapInArrow(_kept, "doc_id long, kept binary")


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if a string of 400 bytes over it also begins anywhere else, in any document.
    Null texts are empty; texts under 400 bytes and empty tables are left as they are. Rows
    repeated as a whole are one document, each with its result; a null doc_id is one like others.
    """
    return _joined(docs, doc_id, text).mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
