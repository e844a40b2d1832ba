"""Operator 4: repeated passages of 20 words or more, by fixed-block anchors.

Documents are cut into reference blocks of 10 words that don't overlap; every rolling window of
10 words probes them. A window of 20 words holds a whole block, so both places of any repeat
have a hit. Around hits, windows of 20 words are compared by 96 bits of two hashes, and consecutive
repeated ones are the maximal exact repeats; of equal windows the first place stays. Pairs of
places are never made: a passage that a third of all documents share costs an entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, durable
from terraloom.llm.packed import exchange, mix

WINDOW = 20
#: A window of 20 words holds a whole block of 10, wherever blocks begin.
BLOCK = WINDOW // 2
_STEP = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, of which a bounded number is remembered."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of `size` consecutive items, by doubling; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    done, out, part, width, power = 0, None, h, 1, _STEP
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                m = min(len(out), len(part) - done)
                out, done = out[:m] * power + part[done : done + m], done + width
        if 2 * width > size:
            return mix(out[:n])
        part = part[:-width] * power + part[width:]
        power, width = power * power, 2 * width


def _blocks():
    def extract(b: pa.RecordBatch) -> Iterator[tuple]:
        known = extract.known
        for key, order, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            h = rolling(word_hashes((text.as_py() or "").encode().split(), known), BLOCK)
            at = np.arange(len(h), dtype=np.int32)
            yield key, order, h, at, at % BLOCK == 0

    extract.known = WordHashes()
    return extract


def _windows():
    def extract(b: pa.RecordBatch) -> Iterator[tuple]:
        known = extract.known
        for key, order, text, spots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            w = word_hashes((text.as_py() or "").encode().split(), known)
            h = rolling(w, WINDOW)
            hits = np.frombuffer(spots, dtype=np.int32)
            edge = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(edge, np.clip(hits - (WINDOW - BLOCK), 0, len(h)), 1)
            np.add.at(edge, np.clip(hits + 1, 0, len(h)), -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0).astype(np.int32)
            yield key, order, h[at], at, None, (rolling(mix(w), WINDOW)[at] >> np.uint64(32)).astype(np.uint32)

    extract.known = WordHashes()
    return extract


def keep_words(text: str | None, starts: np.ndarray) -> tuple[list[bytes], int]:
    """The words outside of the windows that begin at starts, and how many words there were."""
    w = (text or "").encode().split()
    if not len(starts):
        return w, len(w)
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, len(w)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [x for x, g in zip(w, gone.tolist(), strict=True) if not g], len(w)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # A row is known by a hash of all it holds: repeated rows are one document.
    return slim.select(F.xxhash64(F.lit("row"), "doc_id", F.coalesce("text", F.lit(""))).alias("row_key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "text", "doc_id")


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs keyed by row, and (row_key, starts): window starts (int32, packed) to take out."""
    keyed = _keyed(docs, doc_id, text)
    scan = keyed.select("row_key", "order", "text")
    steps = Scratch(docs.sparkSession)
    anchors = exchange(scan.sortWithinPartitions("order", "row_key"), _blocks(), key_bytes=4, flagged=True)
    hits = steps.keep(anchors.groupBy("row_key").agg(F.max("spots").alias("spots")))
    near = keyed.join(hits.hint("shuffle_hash"), "row_key").select("row_key", "order", "text", "spots")
    starts = exchange(near.sortWithinPartitions("order", "row_key"), _windows(), later=True, checked=True)
    found = durable(starts.select("row_key", F.col("spots").alias("starts")))
    steps.close()
    return keyed, found


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, digest = [], [], []
        for text, starts in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            kept, size = keep_words(text.as_py(), np.frombuffer(starts or b"", dtype=np.int32))
            n.append(size)
            gone.append(size - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [b" ".join(keep_words(t.as_py(), np.frombuffer(s or b"", dtype=np.int32))[0]).decode() for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    keyed, starts = repeated_windows(docs, doc_id, text)
    return keyed.join(starts.hint("shuffle_hash"), "row_key", "left").select("doc_id", "text", "starts")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every row's kept words, joined by one space."""
    return _joined(docs, doc_id, text).mapInArrow(_texts, "doc_id long, text string")


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    A word goes if a window of 20 words over it also begins earlier: in a smaller doc_id, or
    earlier in the same document. Null texts have no words; a null doc_id is before all others.
    Rows repeated as a whole are one document, each with its result; texts under 20 words and
    empty tables are left as they are.
    """
    return _joined(docs, doc_id, text).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(0, 20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
