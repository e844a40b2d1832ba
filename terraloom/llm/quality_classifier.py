"""Operator 6: document quality by gradient-boosted trees over statistics of the text.

Statistics are made in one Arrow pass over the texts and kept (about 100 bytes a document);
a bounded sample of labelled rows trains the trees on the driver; scoring goes over the kept
statistics. Texts are neither shuffled nor collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_sample, durable
from terraloom.llm.gbt import Trees, fit

#: At most so many labelled rows train the trees: those of the smallest hashed doc_id.
TRAINING_ROWS = 20_000
MARKS = b"#*$%&|<>!?.,;:\"'()-_=@/"
FEATURES = (
    "log_words", "log_chars", "mean_word", "std_word", "longest_word", "unique_share", "next_repeat_share", "top_word_share", "bigram_repeat_share",
    "lines_per_word", "dup_line_share", "upper_share", "digit_share", "space_share", "high_byte_share", "all_upper_words", "title_words", "no_letter_words", "ends_with_mark", "stop_lines",
    *(f"mark_{chr(c)}" for c in MARKS),
)
_IS_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_IS_LOWER = np.array([97 <= i <= 122 for i in range(256)])
_IS_SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])


def features(text: str | None) -> np.ndarray:
    """The statistics of a whole text; those of the empty one are finite too. Null is empty."""
    raw = (text or "").encode()
    w = raw.split()
    n, size = len(w), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lens = np.fromiter(map(len, w), dtype=np.int64, count=n) if n else np.zeros(1)
    tally: dict[bytes, int] = {}
    for x in w:
        tally[x] = tally.get(x, 0) + 1
    pairs = len(set(zip(w, w[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, n)
    head = (
        np.log1p(n), np.log1p(len(raw)), lens.mean(), lens.std(), lens.max(), len(tally) / k, sum(map(bytes.__eq__, w, w[1:])) / k, max(tally.values(), default=0) / k, 1 - pairs / max(1, n - 1) if n > 1 else 0,
        len(lines) / k, 1 - len(set(lines)) / max(1, len(lines)), count[_IS_UPPER].sum() / size, count[48:58].sum() / size, count[_IS_SPACE].sum() / size, count[128:].sum() / size,
        sum(map(bytes.isupper, w)) / k, sum(map(bytes.istitle, w)) / k, (n - sum(map(bytes.isalpha, w))) / k, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), len(lines) / max(1, count[10] + 1),
    )
    return np.array([*head, *(count[c] / k for c in MARKS)], dtype=np.float32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        rows = [features(t.as_py()) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.float32)
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "features"])


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features): one row per row of docs."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_statistics, "doc_id long, features array<float>")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the doc_id as text leaves 1 when divided by 3; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Trees from the labelled rows that are not held out, at most `rows` of them.

    A document with several labels counts with the larger; rows with a null id or label don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_y"))
    chosen = bounded_sample(known.where(~held_out(F.col("_id"))), "_id", rows)
    got = stats.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.first("features").alias("features"), F.first("_y").alias("_y")).orderBy("_id").collect()
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r["features"] for r in got]), np.array([float(r["_y"]) for r in got]))


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            s = model.score(flat.reshape(b.num_rows, -1)) if b.num_rows else np.zeros(0)
            out = [np.array([zlib.crc32(str(x).encode() if x is not None else b"") % 3 == 1 for x in b.column(0).to_pylist()], dtype=bool)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels come only from rows that are not held out; without any, every score is 0.5. The
    score of a text depends on the text and the trees alone: repeated rows have the same, each its
    own row; null texts are scored as empty ones, and texts of any length as a whole, one at a time.
    A null doc_id is held out as the empty text is. Other columns don't matter; empty tables give none.
    """
    stats = durable(statistics(docs))
    return stats.mapInArrow(_scored(train(stats, labels)), "doc_id long, held_out boolean, score double, predicted int")
