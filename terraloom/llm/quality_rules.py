"""Operator 7: document rules, then a verdict on hosts from shrunken failure rates.

Everything is DataFrame functions. A document's figures need no shuffle; failures are
pre-aggregated by host before they are shuffled, so a host with a third of all rows is no
hot spot, and the host table is broadcast only where its counted size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import SPACE, bounded_broadcast, durable, let, unpacked, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes if its failure rate is surely at least this: by so many standard deviations of its posterior.
HOST_LIMIT = 0.3
SURE = 2.0
#: The prior weighs as much as so many documents at most, which is where hosts differ by no more than chance.
MAX_STRENGTH = 1e6


def _covered(hashes: Column, size: int) -> Column:
    """Words inside windows whose hash occurs twice or more in the array of window hashes."""

    def positions(z: Column) -> Column:
        same = lambda e, j: F.get(z, j).isNotNull() & (F.get(z, j)["h"] == e["h"])
        return F.array_sort(F.transform(F.filter(z, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

    def total(p: Column) -> Column:
        step = F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(size)), F.lit(size)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda z: let(positions(z), total))


def document_figures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Null and empty texts count as no words, no lines and no characters.
    """
    known = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(known, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)

    def of_words(w: Column) -> Column:
        windows = F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>"))
        repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, WINDOW)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(known, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
        )

    return let(words(text), of_words)


def base_failed(figures: Column) -> Column:
    """Whether a document fails by its own figures."""
    return (figures["n_words"] < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * figures["n_words"])


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, sure, rejected): failure rates shrunk by an empirical beta prior.

    The prior's mean is the rate of all documents, and its strength comes from how far the hosts'
    rates lie apart beyond chance, each host weighing as its documents (moments of the beta-binomial).
    rate is the posterior's mean, sure that less two of its standard deviations; a host is rejected
    if sure is at least the limit. A null host is a host.
    """
    by_host = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    by_host = durable(by_host)
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    total = by_host.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"), F.count(F.lit(1)).alias("k"))
    m = F.try_divide("f", "n")
    # Spread of rates between hosts over that of single documents, less what chance alone gives.
    freedom = F.col("n") - F.try_divide("nn", "n") - (F.col("k") - 1)
    share = F.try_divide(F.try_divide(F.col("ff") - F.col("f") * m - (F.col("k") - 1) * m * (1 - m), freedom), m * (1 - m))
    strength = F.when((freedom > 0) & (share > 1 / (MAX_STRENGTH + 1)), F.greatest(F.try_divide(F.lit(1.0), share) - 1, F.lit(1e-3))).otherwise(F.lit(MAX_STRENGTH))
    prior = total.select((F.coalesce(m, F.lit(0.0)) * strength).alias("a"), strength.alias("s"))
    weight = n + F.col("s")
    rate = (f + F.col("a")) / weight
    sure = rate - SURE * F.sqrt(rate * (1 - rate) / (weight + 1))
    # The prior is one row, whatever the input.
    return by_host.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), sure.alias("sure"), (sure >= limit).alias("rejected"))


def _judged(rows: DataFrame, host: str) -> DataFrame:
    """rows (host, figures, base_failed, ...) plus host_rate and kept; rows must be durable, for they are read twice."""
    hosts = durable(host_verdicts(rows, host).select(F.col("host").alias("judged_host"), F.col("rate").alias("host_rate"), "rejected"))
    joined = rows.join(bounded_broadcast(hosts), F.col(host).eqNullSafe(F.col("judged_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False)))


def _figures_of(docs: DataFrame, **more: Column) -> DataFrame:
    rows = docs.select(document_figures(F.col("text")).alias("figures"), F.col("source").alias("host"), *[c.alias(k) for k, c in more.items()])
    return rows.withColumn("base_failed", base_failed(F.col("figures")))


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, figures, base_failed, host_rate, kept): one pass over the texts.

    kept is false if the document fails the base rules or its host is rejected. Null and empty texts
    have no words and fail; empty tables give empty results; repeated rows are judged each by itself.
    """
    rows = durable(_figures_of(docs, doc_id=F.col("doc_id")))
    return _judged(rows, "host").select("doc_id", "figures.*", "base_failed", "host_rate", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names.

    Texts are judged once: rows that pass by themselves are written beside the verdicts on all,
    and those of rejected hosts go when they are read again.
    """
    judged = _figures_of(docs, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = durable(judged.select("host", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")))
    return unpacked(_judged(rows, "host").where("kept"), docs.columns)


ORACLE = """
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
fig AS (SELECT b.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base) b LEFT JOIN cov c USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM fig),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM judged GROUP BY source),
total AS (SELECT sum(n) AS n, sum(f) AS f, sum(f) / sum(n) AS m, sum(n * n) AS nn, sum(f * f / n) AS ff, count(*) AS k FROM hosts),
spread AS (SELECT *, CASE WHEN n - nn / n > k - 1 AND m > 0 AND m < 1 THEN (ff - f * m - (k - 1) * m * (1 - m)) / (n - nn / n - (k - 1)) / (m * (1 - m)) ELSE 0 END AS apart FROM total),
prior AS (SELECT coalesce(m, 0) AS m, CASE WHEN apart > 1 / (1e6 + 1) THEN greatest(1 / apart - 1, 1e-3) ELSE 1e6 END AS s FROM spread),
shrunk AS (SELECT source, n + s AS w, (f + m * s) / (n + s) AS rate FROM hosts, prior),
bad AS (SELECT source, rate - 2 * sqrt(rate * (1 - rate) / (w + 1)) >= 0.3 AS rejected FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""
