"""Finding equal keys among very many positions, with packed bytes in place of rows.

A table of one row per position would be several times the texts. Here each task packs its
positions chunk by chunk: keys that repeat within a chunk are settled there, and of every other
key one entry (four or eight bytes of key, two of position) goes to the key's bucket. A bucket
compares the entries of all chunks and replies to those concerned; replies go back to the chunk,
which turns them into positions in rows. A key that a third of all rows hold costs one entry a
chunk, chunks and buckets are of bounded size, and all that is collected is nothing.

The flow is a single chain (pack, deal by bucket, compare, deal by chunk, unpack); rows are
sorted in each partition first, so a task that is run again packs the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import partitions

#: Entries in a chunk, about, and for each bucket; a chunk ends with a row. With very many buckets
#: chunks grow (eightfold at most), so that what a chunk sends to a bucket stays worth a row.
CHUNK = 1 << 21
ENTRIES = 64

#: From a batch of rows to (key, order, hashes, positions, flags[, checks]) for each: positions rise; checks are 32 bits more of the hashes.
Extract = Callable[[pa.RecordBatch], Iterator[tuple]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_keys(n: int) -> np.ndarray:
    """For each of n partitions a long that Spark's hash partitioning deals to it."""
    x = np.arange(40 * n + 100, dtype=np.int64)
    rotate = lambda v, k: v << np.uint32(k) | v >> np.uint32(32 - k)
    h = np.full(len(x), 42, dtype=np.uint32)
    for word in ((x & 0xFFFFFFFF).astype(np.uint32), (x >> 32).astype(np.uint32)):
        k = rotate(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    dealt = h.view(np.int32) % n
    out = np.arange(n, dtype=np.int64)
    found, first = np.unique(dealt, return_index=True)
    out[found] = x[first]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(x for a in arrays for x in (a.itemsize * 10 + (a.dtype.kind == "i"), len(a)))], dtype=np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    head = np.frombuffer(data, dtype=np.int64, count=1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for kind, count in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        size, signed = divmod(kind, 10)
        out.append(np.frombuffer(data, dtype=np.dtype(f"{'i' if signed else 'u'}{size}"), count=count, offset=at))
        at += size * count
    return out


def _gaps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, in two bytes each where they fit."""
    d = np.diff(rising, prepend=0)
    return d.astype(np.uint16 if not len(d) or d.max() < 65536 else np.uint32)


def _packing(extract: Extract, buckets: int, key_bytes: int, later: bool, values: bool, checked: bool):
    keys_of = bucket_keys(buckets)
    most = min(8 * CHUNK, max(CHUNK, ENTRIES * buckets))

    def flush(rows: list, chunk: int) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        orders = np.array([r[1] for r in rows], dtype=np.int64)
        spans = np.array([int(r[3][-1]) + 1 if len(r[3]) else 0 for r in rows], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
        hashes = np.concatenate([r[2] for r in rows])
        at = np.concatenate([r[3].astype(np.int64) + b for r, b in zip(rows, base, strict=True)])
        flags = None if rows[0][4] is None else np.concatenate([r[4] for r in rows])
        checks = np.concatenate([r[5] for r in rows]) if checked else None
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(first)
        many = np.diff(np.append(starts, len(order))) > 1
        if later:
            settled = order[~first]
        else:
            settled = order[np.repeat(many, np.diff(np.append(starts, len(order))))]
        settled = np.sort(settled)
        sent = order[starts]
        raised = None if flags is None else np.maximum.reduceat(flags[order], starts) if len(starts) else flags[:0]
        bucket = (hashes[sent] % np.uint64(buckets)).astype(np.int64)
        # By bucket, and in a bucket by place.
        by = np.lexsort((sent, bucket))
        sent, bucket, many = sent[by], bucket[by], many[by]
        raised = None if raised is None else raised[by]
        keys = hashes[sent] if key_bytes == 8 else (hashes[sent] // np.uint64(buckets)).astype(np.uint32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, dtype=np.int64)
        dest, kind, data = [int(keys_of[chunk % buckets])], [0], [_pack(ids, base, at[settled], *([hashes[settled]] if values else []))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m, k, where = many[a:b], keys[a:b], at[sent[a:b]]
            c = checks[sent[a:b]] if checked else None
            if later:
                row = np.searchsorted(base, where, side="right") - 1
                there, row = np.unique(row, return_inverse=True)
                data.append(_pack(k, _gaps(where), orders[there], ids[there], base[there], *([c] if checked else [])))
            else:
                f = None if raised is None else raised[a:b].astype(np.uint8)
                data.append(_pack(k[~m], _gaps(where[~m]), k[m], *(() if f is None else (np.packbits(f[~m]), np.packbits(f[m]))), *([c[~m], c[m]] if checked else [])))
            dest.append(int(keys_of[bucket[a]]))
            kind.append(1)
        return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(kind, pa.int32()), pa.array([chunk] * len(dest), pa.int64()), pa.array(data, pa.binary())], names=["dest", "kind", "chunk", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size, chunk, last = 0, TaskContext.get().partitionId() << 24, None
        for b in batches:
            for r in extract(b):
                if last == r[:2]:  # a repeated row is the same document
                    continue
                last = r[:2]
                if not len(r[2]):
                    continue
                rows.append(r)
                size += len(r[2])
                if size >= most:
                    yield flush(rows, chunk)
                    rows, size, chunk = [], 0, chunk + 1
        if rows:
            yield flush(rows, chunk)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Consecutive rows with the same value in a column."""
    now: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now and now[-1][column] != row[column]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _comparing(later: bool, values: bool, flagged: bool, checked: bool):
    def changes(keys: np.ndarray, checks: np.ndarray | None, by: np.ndarray) -> np.ndarray:
        """Where in an order another key begins."""
        first = np.ones(len(by), dtype=bool)
        k = keys[by]
        first[1:] = k[1:] != k[:-1]
        if checks is not None:
            c = checks[by]
            first[1:] |= c[1:] != c[:-1]
        return first

    def replies(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [_unpack(d) for _, d in blobs]
        if later:
            n = [len(p[0]) for p in parts]
            where = [np.cumsum(p[1], dtype=np.int64) for p in parts]
            rows = [np.searchsorted(p[4], w, side="right") - 1 for p, w in zip(parts, where, strict=True)]
            keys = np.concatenate([p[0] for p in parts])
            order, ident, pos = (np.concatenate(x) for x in zip(*((p[2][r], p[3][r], w - p[4][r]) for p, w, r in zip(parts, where, rows, strict=True)), strict=True))
            checks = np.concatenate([p[5] for p in parts]) if checked else None
            by = np.lexsort((pos, ident, order, *([checks] if checked else []), keys))
            o, i, at = order[by], ident[by], pos[by]
            first = changes(keys, checks, by)
            head = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            same = (o == o[head]) & (i == i[head]) & (at == at[head])
            hit = np.zeros(len(by), dtype=bool)
            hit[by] = ~same
        else:
            n = [len(p[0]) for p in parts]
            m = [len(p[2]) for p in parts]
            where = [np.cumsum(p[1], dtype=np.int64) for p in parts]
            keys = np.concatenate([p[0] for p in parts] + [p[2] for p in parts])
            checks = np.concatenate([p[-2] for p in parts] + [p[-1] for p in parts]) if checked else None
            by = np.lexsort((checks, keys)) if checked else np.argsort(keys)
            starts = np.flatnonzero(changes(keys, checks, by))
            count = np.diff(np.append(starts, len(by)))
            weight = np.ones(len(keys), dtype=np.int64)
            weight[sum(n) :] = 2
            good = np.add.reduceat(weight[by], starts) > 1 if len(starts) else np.zeros(0, dtype=bool)
            if flagged:
                f = np.concatenate([np.unpackbits(p[3], count=x) for p, x in zip(parts, n, strict=True)] + [np.unpackbits(p[4], count=x) for p, x in zip(parts, m, strict=True)])
                good &= np.maximum.reduceat(f[by], starts) > 0 if len(starts) else False
            hit = np.zeros(len(keys), dtype=bool)
            hit[by] = np.repeat(good, count)
        at = 0
        for (chunk, _), size, w in zip(blobs, n, where, strict=True):
            mine = hit[at : at + size]
            if mine.any():
                yield chunk, _pack(w[mine].astype(np.uint32), *([keys[at : at + size][mine]] if values else []))
            at += size

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        c, k, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["chunk", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back: dict[int, list[bytes]] = {}
        for rows in _grouped(batches, 0):
            if out := [(chunk, 0, data) for _, kind, chunk, data in rows if kind == 0]:
                yield batch(out)
            if blobs := [(chunk, data) for _, kind, chunk, data in rows if kind == 1]:
                for chunk, data in replies(blobs):
                    back.setdefault(chunk, []).append(data)
        # A row for each chunk, whatever number of buckets this task had.
        whole = [(chunk, 1, parts[0] if len(parts) == 1 else _pack(*map(np.concatenate, zip(*map(_unpack, parts), strict=True)))) for chunk, parts in back.items()]
        for i in range(0, len(whole), 1000):
            yield batch(whole[i : i + 1000])

    return run


def _unpacking(values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            head = next(_unpack(d) for _, kind, d in rows if kind == 0)
            ids, base = head[0], head[1]
            more = [_unpack(d) for _, kind, d in rows if kind == 1]
            at = np.concatenate([head[2].astype(np.int64), *(x[0].astype(np.int64) for x in more)])
            by = np.argsort(at, kind="stable")
            at = at[by]
            given = np.concatenate([head[3], *(x[1] for x in more)])[by] if values else None
            cuts = np.searchsorted(at, np.append(base, np.int64(1) << 62))
            keys, spots, named = [], [], []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                keys.append(int(ids[i]))
                spots.append((at[a:b] - base[i]).astype(np.int32).tobytes())
                if values:
                    named.append(given[a:b].tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spots, pa.binary()), *([pa.array(named, pa.binary())] if values else [])], names=["row_key", "spots", *(["names"] if values else [])])

    return run


def exchange(rows: DataFrame, extract: Extract, *, later: bool = False, key_bytes: int = 8, values: bool = False, flagged: bool = False, checked: bool = False) -> DataFrame:
    """(row_key, spots[, names]): the positions (int32, packed) whose hash is found elsewhere too.

    rows has row_key and doc_id first, and is sorted by them in each partition. later: all but
    the first place of a hash, by (doc_id, row_key, position), instead of all places. flagged:
    only hashes that have the flag at some place, or repeat within a chunk. values: names are
    the hashes (uint64, packed). checked: keys count as equal only if their checks are equal too,
    which makes 96 bits. With key_bytes=4 a few positions more may be found. A row_key
    that lies in several partitions may have several result rows.
    """
    n = partitions(rows)
    blobs = rows.mapInArrow(_packing(extract, n, key_bytes, later, values, checked), "dest long, kind int, chunk long, data binary")
    dealt = blobs.repartition(n, "dest").sortWithinPartitions("dest", "kind")
    back = dealt.mapInArrow(_comparing(later, values, flagged, checked), "chunk long, kind int, data binary")
    home = back.repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    return home.mapInArrow(_unpacking(values), f"row_key long, spots binary{', names binary' * values}")
