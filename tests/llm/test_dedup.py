import hashlib
import random

import numpy as np
import pytest

from terraloom.llm import byte_dedup, packed, word_dedup
from tests.llm.conftest import prose


def corpus(seed, n=40):
    r = random.Random(seed)
    shared = [prose(1000 + i, r.randrange(15, 120)) for i in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(seed * 1000 + i, r.randrange(0, 90))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(n, rows[0][1]), (n + 1, rows[3][1] + " tail"), (n + 2, "ab" * 700), (n + 3, "x " * 60), (n + 4, "é" * 500), (n + 5, None), (n + 6, "")]
    return rows


def brute_words(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(rows):
    places = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, b in raw.items():
        for k in range(len(b) - 399):
            places.setdefault(b[k : k + 400], []).append((i, k))
    gone = {i: np.zeros(len(b), dtype=bool) for i, b in raw.items()}
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i][k : k + 400] = True
    out = {}
    for i, b in raw.items():
        g = gone[i]
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(g.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~g].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(make, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in word_dedup.dedup_report(make(rows)).collect()}
    assert got == brute_words(rows)
    assert sum(v[1] for v in got.values()) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(make, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in byte_dedup.dedup_report(make(rows)).collect()}
    assert got == brute_bytes(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_small_chunks_and_many_partitions(make, monkeypatch):
    """Positions settled inside a chunk and between chunks come to the same."""
    monkeypatch.setattr(packed, "CHUNK", 200)
    rows = corpus(3)
    docs = make(rows).repartition(7)
    assert {r["doc_id"]: r["kept_sha256"] for r in word_dedup.dedup_report(docs).collect()} == {k: v[2] for k, v in brute_words(rows).items()}
    assert {r["doc_id"]: r["kept_sha256"] for r in byte_dedup.dedup_report(docs).collect()} == {k: v[3] for k, v in brute_bytes(rows).items()}


def test_edges_of_the_threshold(make):
    a, b = prose(1, 200, 10**6), prose(2, 200, 10**6)
    for n in (399, 400, 401):
        rows = [(1, "1" + a[:n] + "2"), (2, "3" + a[:n] + "4"), (3, b)]
        got = {r["doc_id"]: r["n_removed"] for r in byte_dedup.dedup_report(make(rows)).collect()}
        assert got == {1: n if n >= 400 else 0, 2: n if n >= 400 else 0, 3: 0}
    w = prose(3, 21, 10**6).split()
    for n in (19, 20, 21):
        rows = [(1, " ".join(["p", *w[:n], "q"])), (2, " ".join(["r", *w[:n], "s"]))]
        got = {r["doc_id"]: r["n_removed"] for r in word_dedup.dedup_report(make(rows)).collect()}
        assert got == {1: 0, 2: n if n >= 20 else 0}


def test_odd_rows(make, odd):
    docs = make(odd)
    for report, n in ((word_dedup.dedup_report, "n_words"), (byte_dedup.dedup_report, "n_bytes")):
        got = report(docs).collect()
        assert len(got) == len(odd)
        assert all(r[n] == 0 for r in got if r["doc_id"] in (1, 2))
        # A row that is repeated as a whole is one document: both have the same result.
        assert len({r["kept_sha256"] for r in got if r["doc_id"] == 5}) == 1
    got = {r["doc_id"]: r for r in word_dedup.dedup_report(docs).collect()}
    assert got[6]["n_removed"] == 60 and got[5]["n_removed"] == 0
    assert word_dedup.deduplicated(docs).count() == byte_dedup.deduplicated(docs).count() == len(odd)


def test_empty(make):
    assert word_dedup.dedup_report(make([])).count() == 0
    assert byte_dedup.dedup_report(make([])).count() == 0


def test_rolling_hashes_tell_windows_apart():
    h = np.arange(100, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 10, 20, 33):
        got = word_dedup.rolling(h, size)
        assert len(got) == 101 - size
        assert [int(x) for x in got] == [int(got[i % 7]) for i in range(len(got))] and len(set(got.tolist())) == 7
    assert len(word_dedup.rolling(h[:5], 6)) == 0


def test_packing_round_trip():
    arrays = [np.arange(5, dtype=np.uint16), np.array([], dtype=np.int64), np.array([-1, 7], dtype=np.int32), np.array([2**63], dtype=np.uint64)]
    for a, b in zip(arrays, packed._unpack(packed._pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_bucket_keys_are_dealt_one_to_a_partition(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 211):
        keys = packed.bucket_keys(n)
        df = spark.createDataFrame([(int(k),) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
        assert [r["p"] for r in df.collect()] == list(range(n))
