import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from terraloom.llm import simhash, word_dedup
from terraloom.llm.components import components
from tests.llm.conftest import prose


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=2):
    """{key: least key reachable} over links of at most `bits` differing bits."""
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints():
    for text in (None, "", " \n", "One", "one TWO", "a b c", prose(1, 50), "É é ß a", prose(2, 9000)):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_against_brute_force(make):
    rows = [(i, prose(i // 3, 80 + i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, prose(1, 30, 2))]
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(make(rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("long_list", [4096, 2])
def test_long_lists_give_the_same_components(spark, long_list):
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base ^ (1 << r.randrange(16)) ^ (1 << r.randrange(16)) ^ (r.randrange(2) << r.randrange(16)) for _ in range(300)}
    values |= {r.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 15, 31}
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    found = {x["node"] & (1 << 64) - 1: x["root"] & (1 << 64) - 1 for x in components(simhash.links(df, long_list=long_list)).collect()}
    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    want = brute_components(signed)
    assert {int(np.uint64(k).view(np.int64)): int(np.uint64(v).view(np.int64)) for k, v in found.items()} == {k: v for k, v in want.items() if k != v}


def test_pairs_that_share_too_few_bytes_are_let_go():
    """In one list, pairs that agree in four or five bytes don't come to be verified; those of six do, and only near ones link."""
    base = 0x1122334455667788
    values = np.unique(np.array([base, base ^ 0x01, base ^ 0x0101, base ^ 0x010101, base ^ 0x0F], dtype=np.uint64))
    for bits in (0, 1, 2):
        label = simhash._components_of_list(values, bits, 8 - bits)
        want = brute_components({i: int(v) for i, v in enumerate(values)}, bits)
        assert dict(enumerate(label.tolist())) == want


def test_fewer_bits(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(50)}
    values |= {v ^ (1 << r.randrange(64)) for v in values} | {v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values}
    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    for bits in (0, 1, 2):
        found = {x["node"]: x["root"] for x in components(simhash.links(df, bits)).collect()}
        groups = lambda roots: {frozenset(k for k in signed if roots.get(k, k) == root) for root in {roots.get(k, k) for k in signed}}
        assert groups(found) == groups(brute_components(signed, bits))


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_odd_rows(make, odd):
    got = simhash.near_duplicates(make(odd)).collect()
    assert len(got) == len(odd)
    zero = {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert zero == {1} and all(r["fp"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    kept = simhash.one_of_each(make(odd))
    assert kept.columns == make(odd).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 5 in ids and 6 not in ids


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.one_of_each(make([])).count() == 0


def edited(text, seed, edits):
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_are_found_by_their_parts(make):
    rows = []
    for i in range(25):
        base = prose(i, 150 + 20 * i, 10**6)
        rows += [(10 * i, base), (10 * i + 1, edited(base, i, 1 + i // 5)), (10 * i + 2, base + " " + prose(9000 + i, 600, 10**6))]
    # A passage that all share makes nobody alike.
    rows = [(i, t + " " + prose(5, 30, 10**6)) for i, t in rows] + [(900, ""), (901, None), (902, "one two")]
    text = dict(rows)
    got = {(r["a"], r["b"]) for r in simhash.similar_pairs(make(rows)).collect()}
    want = {(a, b) for a in text for b in text if a < b and text[a] and text[b] and simhash.similarity(text[a], text[b]) >= 0.8}
    assert want and got == want
    kept = {r["doc_id"] for r in simhash.one_of_each(make(rows)).collect()}
    assert not kept & {b for _, b in want} and kept >= {i for i, t in rows if t} - {b for _, b in want}


def test_a_large_group_of_near_copies(make):
    base = prose(1, 300, 10**6)
    rows = [(i, edited(base, i, 1)) for i in range(400)] + [(1000 + i, prose(50 + i, 100, 10**6)) for i in range(20)]
    kept = {r["doc_id"] for r in simhash.one_of_each(make(rows)).collect()}
    assert kept == {0} | {1000 + i for i in range(20)}


def test_part_prints_follow_the_text():
    from terraloom.llm.word_dedup import WordHashes, rolling, word_hashes

    known = WordHashes()
    a, b = prose(1, 3000, 10**6), prose(2, 40, 10**6)
    one, two = (set(simhash.parts(rolling(word_hashes(t.encode().split(), known), 5))[0].tolist()) for t in (a, b + " " + a))
    assert len(one - two) <= 1 and 100 < len(one) < 300


def brute_kept(rows, least=0.8):
    """doc_ids that are the least of their component, by exact similarity of all pairs."""
    text = dict(rows)
    root = {i: i for i in text}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}
    for a in text:
        for b in text:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in text if find(i) == i}


def linked(make, rows):
    found = components(simhash.similar_pairs(make(rows))).collect()
    return set(dict(rows)) - {r["node"] for r in found}


def test_copies_that_are_alike_only_through_a_document_in_the_middle(make):
    rows = []
    for g in range(4):
        base = prose(70 + g, 300, 10**6)
        rows += [(1000 * g + i, edited(base, 1000 * g + i, 5) if i != 37 else base) for i in range(80)]
    assert brute_kept(rows) == {0, 1000, 2000, 3000}
    assert linked(make, rows) == brute_kept(rows)


def test_links_that_no_head_makes(make, monkeypatch):
    """Whatever the heads of posting lists leave in two components is found."""
    rows = [(i, edited(prose(i // 6, 120, 10**6), i, 1)) for i in range(60)]
    monkeypatch.setattr(simhash, "_to_heads", lambda posts: posts.selectExpr("doc AS a", "doc AS b").where("false"))
    assert len(brute_kept(rows)) < 60 and linked(make, rows) == brute_kept(rows)


def test_short_texts_with_one_edit(make):
    rows = []
    for i in range(160):
        size = 20 + i // 4
        text = prose(400 + i, size, 10**6)
        # A word near an end changes one or two shingles.
        w = text.split()
        w[(-1, -2, 0, random.Random(i).randrange(size))[i % 4]] = f"new{i}"
        rows += [(2 * i, text), (2 * i + 1, " ".join(w))]
    want = brute_kept(rows)
    assert 160 <= len(want) < 250
    assert linked(make, rows) == want


def test_what_a_worker_holds_of_words_is_bounded():
    """Texts of very many different words don't stay in a worker's memory, neither while nor after it reads them."""
    texts = [" ".join(f"{i}x{k}" for k in range(1000)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array([10**6] * 300, pa.int32())], names=["doc", "text", "hits"])
    run = simhash.lean(simhash._sets(0.8))
    tracemalloc.start()
    try:
        found = [b.num_rows for b in run(iter([batch]))]
        left, most = tracemalloc.get_traced_memory()
        assert found == [300] and most < 25e6 and left < 1e6
        # Hashes that were forgotten come back the same.
        assert list(simhash._prefixes(0.8)(batch.select(["doc", "doc", "text"])))[-1][2].tolist() == simhash._shingle_set(texts[-1], word_dedup.WordHashes())[: 996 - 797 + 1 + 996 // 5].tolist()
    finally:
        tracemalloc.stop()
