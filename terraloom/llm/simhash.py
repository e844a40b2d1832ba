"""Operator 1: near-duplicates by SimHash, from an inverted index over byte positions with count filtering.

Fingerprints have eight positional bytes. Lists of single bytes would be a 256th of all
fingerprints long and their pairs grow with the square of the input, so the index is over pairs
of byte positions, two at a time: 32 bits. Within a list, the positional bytes that two
fingerprints share are tallied; linked ones share six at least, and those that reach that are
verified bit by bit. Fingerprints are distinct by then, however many documents have them, and
lists that are long all the same are dealt out once more, by two further bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import Scratch, dealt_anew, durable, lean, packed_rows, partitions, unpacked
from terraloom.llm.components import components
from terraloom.llm.packed import exchange
from terraloom.llm.word_dedup import WordHashes, rolling, word_hashes

SHINGLE = 3
MAX_BITS = 2
#: Posting lists over this long are dealt out by two bytes more.
LONG_LIST = 4096
POSITIONS = 8
#: Near copies share at least this much of their shingles of so many words; parts() are of so many shingles on average.
SIMILAR = 0.8
WIDE = 5
PART = 16


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Space-joined shingles of the words of a text with A-Z in lower case, repeats included."""
    w = (text or "").encode().lower().split()
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    s = shingles(text, size)
    if not s:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), dtype=np.uint64, count=len(s)).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 16384):
        ones += np.unpackbits(h[i : i + 16384], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t.as_py(), size) for t in b.column(b.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts have fingerprint zero."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _bytes_of(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions of a fingerprint, all others zero."""
    mask = sum(0xFF << 8 * p for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _posted(fps: DataFrame, groups: list[tuple[int, ...]], chosen: int, fixed: int = 0) -> DataFrame:
    """(choice, key, fp): each fingerprint under every choice of `chosen` of the groups of byte positions.

    fixed: the choice that rows have already, whose bytes stay part of the key.
    """
    posts = [F.struct(F.lit(i + fixed).cast("int").alias("choice"), _bytes_of(F.col("fp"), sum(c, ())).alias("key")) for i, c in enumerate(combinations(groups, chosen))]
    return fps.select("fp", F.explode(F.array(*posts)).alias("p")).select("p.choice", "p.key", "fp")


def _components_of_list(values: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """For distinct fingerprints of one list, the place of the least one that each is linked to, directly or not.

    For every pair the bytes that they share are tallied, pairs below `least` are let go, and the
    rest are verified bit by bit. Pairs are made a block of rows at a time and not kept.
    """
    label = np.arange(len(values))
    found = []
    step = max(1, (1 << 20) // len(values))
    for i in range(0, len(values), step):
        x = values[i : i + step, None] ^ values[None, i:]
        tally = (x.view(np.uint8).reshape(*x.shape, POSITIONS) == 0).sum(2, dtype=np.uint8)
        r, c = np.nonzero(tally >= least)
        near = (np.bitwise_count(x[r, c]) <= max_bits) & (c > r)
        found.append((r[near] + i, c[near] + i))
    one, two = (np.concatenate(v) for v in zip(*found, strict=True))
    while len(one):
        before = label.copy()
        least_of = np.minimum(label[one], label[two])
        np.minimum.at(label, one, least_of)
        np.minimum.at(label, two, least_of)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(max_bits: int, least: int):
    """From rows (choice, key, fp) sorted by choice and key: star edges (a, b) inside each list."""

    def edges(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        out = []
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            v = np.unique(values[cuts[k] : cuts[k + 1]])
            if len(v) > 1:
                label = _components_of_list(v, max_bits, least)
                moved = label != np.arange(len(v))
                out.append((v[moved], v[label[moved]]))
        if not out:
            return None
        one, two = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for b in batches:
            keys = np.concatenate([keys, np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()], axis=1)])
            values = np.concatenate([values, b.column(2).to_numpy().view(np.uint64)])
            # All lists but the last are whole.
            other = np.flatnonzero((keys != keys[-1:]).any(1))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole and (out := edges(keys[:whole], values[:whole])) is not None:
                yield out
            keys, values = keys[whole:], values[whole:]
        if len(keys) and (out := edges(keys, values)) is not None:
            yield out

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), enough for every link's component.

    max_bits is 0 to 2: fingerprints that differ in so few bits differ in two bytes at most, so of
    the four pairs of neighbouring bytes two at least agree. Every fingerprint is posted under each
    two of its four pairs; in a posting list, the bytes that any two share are tallied and pairs
    that share fewer than 8 - max_bits go. Lists over `long_list` are dealt out again, in the same
    way, under each two of their other four bytes, of which two must agree: such a list has 65,536
    fingerprints at most, since no more differ in two bytes alone.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    pairs = [(2 * i, 2 * i + 1) for i in range(POSITIONS // 2)]
    posts = _posted(fps, pairs, 2)
    sizes = posts.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_list)
    long = durable(sizes.select(F.col("choice").alias("c"), F.col("key").alias("k")))
    if long.take(1):
        same = (F.col("choice") == F.col("c")) & (F.col("key") == F.col("k"))
        short = posts.join(long, same, "left_anti")
        crowded = durable(posts.join(long.select(F.col("c"), dealt_anew("k").alias("k")), same).select("choice", "fp"))
        for i, chosen in enumerate(combinations(pairs, 2)):
            rest = [(p,) for p in range(POSITIONS) if p not in sum(chosen, ())]
            # The bytes that a list agrees on stay in the key.
            again = _posted(crowded.where(F.col("choice") == i), [(*sum(chosen, ()), *two) for two in combinations(sum(rest, ()), 2)], 1, 6 * (i + 1))
            short = short.unionByName(again)
        posts = short
    dealt = posts.repartition(partitions(fps), "choice", "key").sortWithinPartitions("choice", "key")
    return dealt.mapInArrow(_links(max_bits, POSITIONS - max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least doc_id reachable.

    Rows without words have fingerprint zero and are linked like any others. A repeated row is
    in its own component's row each time. A null doc_id gets the least known one of its
    component, or null. An empty table gives an empty result.
    """
    fps = durable(fingerprints(docs, doc_id, text, size))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    # Components over fingerprints, then the least doc_id over each of them.
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(classes, F.col("fp") == F.col("_fp")).select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def fingerprint_text(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class FewHashes(WordHashes):
    """Half a million words would hold tens of megabytes in each worker, beside a full heap."""

    most = 1 << 16


def _need(n: int, least: float) -> int:
    """How many of its n shingles a text must share with any text that is at least so like it."""
    return max(1, math.ceil(least * n - 1e-9))


def _shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; none without words."""
    w = (text or "").encode().lower().split()
    return np.unique(rolling(word_hashes(w, known), min(WIDE, len(w)))) if w else np.zeros(0, dtype=np.uint64)


def _spare(n: int) -> int:
    """So many hashes beyond the one that a shared prefix needs are sent too, to let more texts go."""
    return n // 5


def _prefixes(least: float):
    """The least hashes of a text: alike texts share 1 + _spare() of them, by the smaller text's count, at least."""

    def extract(b: pa.RecordBatch) -> Iterator[tuple]:
        for key, order, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            h = _shingle_set(text.as_py(), extract.known)
            if len(h):
                h = h[: len(h) - _need(len(h), least) + 1 + _spare(len(h))]
                yield key, order, h, np.arange(len(h), dtype=np.int32), None

    extract.known = FewHashes()
    return extract


def _sets(least: float):
    """From (doc, text, hits): the shingles of texts that share enough of their prefix with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FewHashes()
        for b in batches:
            rows = []
            for doc, text, hits in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = _shingle_set(text.as_py(), known)
                if len(h) and hits > _spare(_need(len(h), least)):
                    rows.append((doc, len(h), h.tobytes()))
            if rows:
                doc, n, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(names, pa.binary())], names=["doc", "n", "names"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column(1).to_numpy()
        for i in range(0, b.num_rows, 256):
            m = n[i : i + 256]
            token = np.frombuffer(b"".join(b.column(2)[i : i + 256].to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy()[i : i + 256], m)), pa.array(np.repeat(m, m)), pa.array(token)], names=["doc", "n", "token"])


def parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, numbers) of the parts of a text, from the hashes of its shingles; the search for pairs doesn't use them."""
    starts = np.unique(np.append(np.flatnonzero(h[:-1] % np.uint64(PART) == 0) + 1, 0))
    size = np.diff(np.append(starts, len(h)))
    out = []
    for i in range(0, len(starts), 1024):
        a, z = starts[i], len(h) if i + 1024 >= len(starts) else starts[i + 1024]
        bits = np.unpackbits(h[a:z].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[i : i + 1024] - a, axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > size[i : i + 1024, None], axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out), np.arange(len(starts), dtype=np.int32)


def similarity(a: str | None, b: str | None, size: int = 5) -> float:
    """The Jaccard similarity of two texts' sets of shingles; two texts without words are alike."""
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= _need(max(len(x), len(y)), least) else 0
                good.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    one, two = (sets.select(dealt_anew("doc").alias(k), F.col("names").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(lean(_alike(least)), "a long, b long")


def _rare(sets: DataFrame, least: float) -> DataFrame:
    """(doc, n, weight, at, token): each text's prefix, its rarest shingles, with their places.

    Shingles are in order of the texts that have them, then of their hashes, and the prefix is one
    longer than what a text needn't share; two alike texts have a shingle in both prefixes. Those
    that one text alone has come first and aren't given, nor are texts that have too many of them.
    """
    tokens = sets.mapInArrow(lean(_tokens), "doc long, n int, token long")
    known = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(dealt_anew("token").alias("t"), "c")
    held = tokens.join(known, F.col("token") == F.col("t")).groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("held"), F.sum("c").alias("s"))
    alone = F.col("n") - F.size("held")
    longest = F.col("n") - F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-9)).cast("int") + 1
    begun = held.select("doc", "n", (F.col("s") / F.col("n")).alias("weight"), alone.alias("alone"), F.slice("held", 1, F.greatest(F.lit(0), longest - alone)).alias("held"))
    return begun.select("doc", "n", "weight", "alone", F.posexplode("held").alias("i", "x")).select("doc", "n", "weight", (F.col("alone") + F.col("i")).alias("at"), "x.token")


def _to_heads(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text with six of every posting list that it is in."""
    drawn = [F.min_by("doc", F.xxhash64("doc", F.lit(i))).alias(f"r{i}") for i in range(3)]
    lists = posts.groupBy(F.col("token").alias("p")).agg(F.min("doc").alias("r"), F.max("doc").alias("top"), F.max_by("doc", F.struct("weight", "doc")).alias("mid"), *drawn)
    heads = lists.where("r < top").select(dealt_anew("p").alias("p"), F.array_distinct(F.array("r", "r0", "r1", "r2", "top", "mid")).alias("heads"))
    pairs = posts.join(heads, F.col("token") == F.col("p")).select("doc", F.explode("heads").alias("head")).where("doc != head")
    return pairs.select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct()


def _across(posts: DataFrame, roots: DataFrame, least: float, steps: Scratch) -> DataFrame:
    """Every pair (a, b) that may be alike, by size and places, of two components."""
    tagged = posts.join(roots, F.col("doc") == F.col("node"), "left").select("doc", "n", "at", "token", F.coalesce("root", "doc").alias("root"))
    tagged = steps.keep(tagged)
    apart = tagged.groupBy(F.col("token").alias("p")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(dealt_anew("p").alias("p"))
    left = steps.keep(tagged.join(apart, F.col("token") == F.col("p")).select("doc", "n", "at", "token", "root"))
    steps.drop(tagged)
    one = left.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"), dealt_anew("token").alias("t"))
    two = left.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"), dealt_anew("token").alias("u"))
    # At their first common shingle, no more than what follows it in either can be common.
    may = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-6
    return one.join(two, (F.col("t") == F.col("u")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & may).select("a", "b").distinct()


def similar_pairs(docs: DataFrame, least: float = SIMILAR, read: Callable[[], None] | None = None) -> DataFrame:
    """Edges (a, b) of doc_ids whose texts share at least `least` of their five-word shingles.

    They are enough for every component: no two texts that are so alike are in two of them.
    Texts that don't share enough of their least shingle hashes with others can't be like any and
    go first. Of those that stay, each is posted under its rarest shingles (an exact prefix filter).
    Each posting list is tied to six of its documents; then all pairs that this leaves in two
    components are compared, by lists that span several. Pairs are verified by the exact
    similarity, where shingles are equal if their 64-bit hashes are. doc_ids must be unique and
    not null. read is called when docs isn't read any more.
    """
    steps = Scratch(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("row_key"), F.col("doc_id").cast("long").alias("order"), F.col("text").cast("string").alias("text"))
    hits = steps.keep(exchange(slim.sortWithinPartitions("order", "row_key"), _prefixes(least), key_bytes=4).select(F.col("row_key").alias("k"), (F.length("spots") / 4).cast("int").alias("hits")))
    held = slim.select("row_key", "text").join(hits.hint("shuffle_hash"), F.col("row_key") == F.col("k")).select("row_key", "text", "hits")
    sets = steps.keep(held.mapInArrow(lean(_sets(least)), "doc long, n int, names binary"))
    steps.drop(hits)
    if read is not None:
        read()
    posts = steps.keep(_rare(sets, least))
    near = durable(_verified(steps.keep(_to_heads(posts)), sets, least))
    rest = durable(_verified(steps.keep(_across(posts, components(near), least, steps)), sets, least))
    steps.close()
    return near.union(rest)


def one_of_each(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, least: float | None = SIMILAR) -> DataFrame:
    """The rows of docs that are first of their group: one row for each, with the columns of docs.

    Groups are components of SimHash links; of what they leave, those of texts that share at least
    `least` of their five-word shingles (None: no such groups). The least doc_id stays; of repeated
    rows one does. Rows with a null doc_id stay, one for each text, if any of them is like no other.
    Columns of any name are kept as they are; an empty table gives an empty one.
    """
    # A doc_id as text, where null is the empty one.
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = near_duplicates(docs, size=size, max_bits=max_bits)
    keep = durable(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(known.alias("keep")).distinct())
    steps = Scratch(docs.sparkSession)
    if least is not None:
        first = docs.select("doc_id", "text", known.alias("known")).where("doc_id IS NOT NULL").join(keep.hint("shuffle_hash"), F.col("known") == F.col("keep"), "left_semi")
        first = steps.keep(first.dropDuplicates(["known"]).select("doc_id", "text"))
        later = components(similar_pairs(first, least, lambda: steps.drop(first))).select(F.col("node").cast("string").alias("node"))
        keep = durable(keep.join(later, F.col("keep") == F.col("node"), "left_anti"))
    steps.close()
    rows = packed_rows(docs, known=known, text=F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(keep.hint("shuffle_hash"), F.col("known") == F.col("keep"), "left_semi")
    return unpacked(kept.dropDuplicates(["known", "text"]), docs.columns)
