"""Operator 5: benchmark items in documents, also with other numbers, names and units.

Words are canonicalised: lower case, no punctuation, and typed placeholders for numbers, names
and units. An item that may have e words changed is cut into e + 1 template windows, one of which
is unbroken wherever the item stands; rolling windows of documents are hash-joined with them, and a
hit fixes where the item would begin. The item's whole template is then compared with the document
at that place, and each slot value of the item has to stand for one value throughout. Only
DataFrame functions are used. Where the benchmark's windows are few enough to be broadcast, by
count, a document's window is hashed only around words that some window of the benchmark is known
by; otherwise all windows are hashed and shuffled. Both find the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_broadcast, durable, packed_rows, unpacked, words

MIN_MATCH = 0.8
MIN_WORDS = 8
#: So many windows of the benchmark are looked up by their rarest words, and broadcast if they take no more than so many bytes.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64 << 20

# Words for units of measure.
UNITS = "mm cm km kg mg ml lb oz ft mph kmh usd eur gbp percent meters metres miles grams liters litres hours minutes seconds days weeks months years dollars euros pounds degrees"


# Patterns look at the character itself first, at what stands around it only then: most characters are done with at once.
_MARK = r"[^a-zA-Z\x20](?:(?<=[^{kept}\p{{L}}\p{{N}}.,'\x20\x09-\x0D])|(?<=[.,'])(?:(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}].)))"
_NAME = r"\p{Lu}(?<=\p{Ll}[,;]?[\x20\x09-\x0D].)[\p{Ll}']+(?![\p{L}\p{N}])"
_NUMBER = r"\p{N}(?<![^\x20\x09-\x0D].)[\p{N}.,']*(?![^\x20\x09-\x0D])"
_UNIT = rf"(\x01num[\x20\x09-\x0D])(?i:{'|'.join(UNITS.split())})(?![^\x20\x09-\x0D])"


def raw_words(text: Column) -> Column:
    """Words without punctuation at their ends, in the case they have; none are empty."""
    return words(F.regexp_replace(F.coalesce(text, F.lit("")), _MARK.format(kept=""), ""))


def templates(text: Column) -> Column:
    """The words of raw_words(), each canonical, one to one.

    #num for numbers, #unit for a unit right behind a number, #name for a capitalised word that
    stands behind a word in lower case with no full stop between them.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, "\x01name")
    clean = F.regexp_replace(marked, _MARK.format(kept=r"\x01"), "")
    numbers = F.regexp_replace(clean, _NUMBER, "\x01num")
    return words(F.lower(F.regexp_replace(numbers, _UNIT, "$1\x01unit")))


def probing(items: DataFrame, item_id: str, text: str, min_match: float) -> DataFrame:
    """(item, item_at, window, item_template, item_words): windows of every item that don't overlap.

    There is one more than words that a match may miss, so that one at least is found unbroken.
    """
    rows = items.select(F.col(item_id).alias("item"), templates(F.col(text)).alias("item_template"), raw_words(F.col(text)).alias("item_words"))
    size = F.size("item_template")
    rows = rows.where(size >= MIN_WORDS).dropDuplicates()
    rows = rows.withColumn("_parts", F.least(size, F.floor(size * (1 - min_match) + 1e-9).cast("int") + 1))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.floor(k * size / F.col("_parts")).cast("int"))).alias("item_at")
    return rows.select("*", F.floor(size / F.col("_parts")).cast("int").alias("window"), at).drop("_parts")


def _from(words_of: Column, at: Column, n: Column) -> Column:
    """n words from a place on. Spark may look before it has filtered, so a place before the first counts as the first."""
    return F.slice(words_of, F.greatest(at, F.lit(0)) + 1, n)


def _match(b: Column, d: Column) -> Column:
    """Share of the template words of b that d has at their places."""
    return F.size(F.filter(F.zip_with(b, d, lambda x, y: x == y), lambda x: x)) / F.size(b)


def _slots(b: Column, raw_b: Column, raw_d: Column) -> Column:
    """Whether each slot value of b has one value in d, and whether any is another."""
    slots = F.filter(F.arrays_zip(b.alias("t"), raw_b.alias("x"), raw_d.alias("y")), lambda s: s["t"].startswith("\x01"))
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(F.lower(s["x"]).alias("x"), F.lower(s["y"]).alias("y"))))
    values = F.array_distinct(F.transform(slots, lambda s: F.lower(s["x"])))
    return F.struct((F.size(pairs) == F.size(values)).alias("consistent"), F.exists(slots, lambda s: F.lower(s["x"]) != F.lower(s["y"])).alias("reparameterised"))


def _anchored(probes: DataFrame) -> DataFrame:
    """(item, item_at, window, window_hash, offset, anchor): each window with the word that documents are searched for.

    That is the word that the fewest windows of the benchmark have, of equals the longest; placeholders
    come last. Documents that hold the window hold that word, at that offset.
    """
    words_of = probes.select("item", "item_at", "window", "item_template", F.posexplode(F.slice("item_template", F.col("item_at") + 1, F.col("window"))).alias("offset", "word"))
    common = words_of.groupBy(F.col("word").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("word").startswith("\x01"), F.col("n"), -F.length("word"), F.col("offset"))
    chosen = words_of.join(common, F.col("word") == F.col("w")).groupBy("item", "item_at", "window", "item_template").agg(F.min_by(F.struct("offset", "word"), order).alias("x"))
    window_hash = F.xxhash64(F.slice("item_template", F.col("item_at") + 1, F.col("window")))
    return chosen.select("item", "item_at", "window", window_hash.alias("window_hash"), F.col("x.offset").alias("offset"), F.xxhash64("x.word").alias("anchor"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: float = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, word_at, match, reparameterised): where a document holds an item.

    One row per document and item, at its best place (the first of the best). Every place that
    agrees with an item in `min_match` of its words is found, whatever stands around it. Null
    texts and items of fewer than 8 words hold nothing; repeated rows give one row; empty tables
    give none. Names of other columns don't matter.
    """
    # A row is known by a hash of all it holds: doc_ids may be null or repeated.
    row = F.xxhash64(F.lit("row"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit("")))
    docs = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), row.alias("_row"))
    probes = durable(probing(items.select(F.col(item_id), F.col(item_text)), item_id, item_text, min_match))
    whole = durable(probes.where("item_at = 0").select(F.col("item").alias("i"), "item_template", "item_words"))
    n, least = probes.agg(F.count(F.lit(1)), F.coalesce(F.min("window"), F.lit(1))).collect()[0]
    hashed = docs.withColumn("_t", templates(F.col("_text")))
    begin = (F.col("_at") - F.col("item_at")).alias("begin")
    if n <= BROADCAST_WINDOWS:
        # Only words are exploded, and only those that are some window's anchor look at the words around them.
        keys = bounded_broadcast(durable(_anchored(probes)), BROADCAST_BYTES)
        # The outer form: of the plain one Spark infers a filter, for which all templates would be made once more.
        spots = hashed.select("_doc", "_text", "_t", F.posexplode_outer("_t").alias("_spot", "_word")).withColumn("_h", F.xxhash64("_word"))
        near = spots.join(keys, (F.col("_h") == F.col("anchor")) & (F.col("_spot") >= F.col("offset"))).withColumn("_at", F.col("_spot") - F.col("offset"))
        hits = near.where(F.xxhash64(_from(F.col("_t"), F.col("_at"), F.col("window"))) == F.col("window_hash")).select("_doc", "_text", "_t", "item", begin)
    else:
        # Windows are looked up by the first words, as many as the shortest has, and the next one of a longer window.
        first_words = F.xxhash64(*[F.get("item_template", F.col("item_at") + i) for i in range(least)])
        next_word = F.when(F.col("window") > least, F.xxhash64(F.get("item_template", F.col("item_at") + least)))
        keys = probes.select(first_words.alias("h"), next_word.alias("next"), "item", "item_at")
        fits = (F.col("_h") == F.col("h")) & (F.col("next").isNull() | (F.col("next") == F.xxhash64(f"_w.w{least}")))
        rolling = F.posexplode_outer(F.arrays_zip(*[F.slice("_t", i + 1, F.size("_t")).alias(f"w{i}") for i in range(least + 1)])).alias("_at", "_w")
        # One row for a row of docs, an item and a place, before texts come in again.
        spots = hashed.select("_row", rolling).select("*", F.xxhash64(*[f"_w.w{i}" for i in range(least)]).alias("_h"))
        hits = spots.join(keys, fits).select(F.col("_row").alias("_hit"), "item", begin).distinct()
        hits = hits.join(docs, F.col("_hit") == F.col("_row")).withColumn("_t", templates(F.col("_text"))).select("_doc", "_text", "_t", "item", "begin")
    placed = hits.where("begin >= 0").join(bounded_broadcast(whole), F.col("item").eqNullSafe(F.col("i")))
    size = F.size("item_template")
    placed = placed.withColumn("_match", _match(F.col("item_template"), _from(F.col("_t"), F.col("begin"), size))).where(F.col("_match") >= min_match)
    slots = _slots(F.col("item_template"), F.col("item_words"), _from(raw_words(F.col("_text")), F.col("begin"), size))
    best = placed.select("_doc", "item", "begin", "_match", slots.alias("s")).where("s.consistent")
    first = F.struct(F.col("_match"), -F.col("begin"))
    best = best.groupBy("_doc", "item").agg(F.max("_match").alias("match"), F.max_by("s", first).alias("s"), F.max_by("begin", first).alias("begin"))
    return best.select(F.col("_doc").alias(doc_id), F.col("item").alias(item_id), F.col("begin").alias("word_at"), "match", F.col("s.reparameterised").alias("reparameterised"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs."""
    bad = durable(leaks(docs, items).select(F.col("doc_id").alias("bad")).distinct())
    rows = packed_rows(docs, key=F.col("doc_id"))
    return unpacked(rows.join(bounded_broadcast(bad), F.col("key").eqNullSafe(F.col("bad")), "left_anti"), docs.columns)
