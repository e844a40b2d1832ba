"""Operator 2: rules for URLs, and gradient-boosted trees over lexical features for the rest.

Trees are trained on a bounded sample of labelled URLs: those that the caller gives, else weak
labels by words that hosts of unwanted categories are named with. They never see a word:
only lengths, depth, digit and hyphen shares, entropy, counts of parameters and figures of the
suffix. Those are tallied over all labelled URLs; a URL that trees learn from has those of all
hosts but its own, so that its own label isn't among what it is judged by.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import bounded_broadcast, bounded_sample, durable, packed_rows
from terraloom.llm.gbt import Trees, fit

#: At most so many labelled URLs train the trees: those of the smallest hash.
TRAINING_ROWS = 20_000
# Words in the names of unwanted hosts, by category; weak labels where the caller has none.
UNWANTED = {
    "gambling": "bet bets betting bingo blackjack casino gamble gambling jackpot lottery poker roulette slots wager win winner",
    "adult": "adult cam cams dating erotic escort hookup milf nude porn porno sex sexy webcam xxx",
    "drugs": "cialis diet drugs pharma pharmacy pill pills slimming steroids viagra",
    "spam": "cheap clickbait coupon coupons discount freebie giveaway leads mailer promo replica seo spam",
    "money": "bitcoin credit crypto debt forex loan loans mortgage payday",
    "tracking": "ad adclick ads adserver adware analytics banner click clicks counter popunder popup stats track tracker tracking",
    "fraud": "account-verify exploit hack hacked keygen malware phish phishing scam spyware trojan virus",
    "piracy": "crack cracked nulled rip serialz torrent torrents warez",
}
# The rules of the query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The share and the log count of a suffix that no labelled URL has.
UNSEEN = (0.5, 0.0)
FEATURES = 23  # that _lexical() gives
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to /, ? or #, A-Z in lower case; empty without."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands behind the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules of one length: the first by name."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _lexical(url: str, share: float, seen: float) -> list[float]:
    before, sep, rest = url.partition("://")
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest)) if sep else 0
    host, tail = rest[:end].lower() if sep else "", rest[end:] if sep else url
    path, _, query = tail.partition("#")[0].partition("?")
    labels = host.split(".")
    size = max(1, len(url))
    main = max(labels, key=len, default="")
    return [
        len(url), len(host), len(path), len(query), len(labels), path.count("/"), sum(c.isdigit() for c in url) / size, sum(c.isdigit() for c in host) / max(1, len(host)), host.count("-"), path.count("-"),
        _entropy(host), _entropy(path), _entropy(main), query.count("=") , query.count("&"), float(before == "https"), sum(c in "aeiou" for c in main) / max(1, len(main)), len(main), share, seen, float("%" in url), float("@" in url), float("." in path),
    ]


def _features(urls: Sequence[str | None], of_suffix: Sequence[tuple[float, float]]) -> np.ndarray:
    rows = [_lexical(u or "", *x) for u, x in zip(urls, of_suffix, strict=True)]
    return np.array(rows or np.zeros((0, FEATURES)), dtype=np.float64)


def suffix(url: Column) -> Column:
    """The last two labels of the host, A-Z in lower case."""
    return F.substring_index(host_of(url), ".", -2)


def labelled_by_words(urls: DataFrame, url: str = "url", words: dict[str, str] = UNWANTED) -> DataFrame:
    """(url, label): 1 if a part of the host, cut at dots and hyphens, is one of the words."""
    listed = sorted({w for names in words.values() for w in names.split()})
    parts = F.split(host_of(F.col(url)), "[.-]")
    return urls.select(F.col(url).alias("url"), F.arrays_overlap(parts, F.array(*[F.lit(w) for w in listed])).cast("int").alias("label"))


def _distinct(labelled: DataFrame) -> DataFrame:
    """Each url once, with the larger of its labels; nulls don't count."""
    return labelled.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url").agg(F.max("label").alias("label"))


def statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, share, seen) for every suffix of (url, label): the smoothed share of unwanted urls, and the log of 1 + their count."""
    by_suffix = _distinct(labelled).groupBy(suffix(F.col("url")).alias("suffix")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    return by_suffix.select("suffix", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("share"), F.log1p("n").alias("seen"))


def _with_statistics(urls: DataFrame, suffixes: DataFrame, url: str) -> DataFrame:
    """(row, share, seen): the columns of urls as a struct, with the figures of each one's suffix. suffixes must be durable."""
    known = suffixes.select(F.coalesce("suffix", F.lit("")).alias("known"), "share", "seen")
    joined = packed_rows(urls, end=suffix(F.col(url))).join(bounded_broadcast(durable(known)), F.col("end") == F.col("known"), "left")
    return joined.select("row", F.coalesce("share", F.lit(UNSEEN[0])).alias("share"), F.coalesce("seen", F.lit(UNSEEN[1])).alias("seen"))


def _training(labelled: DataFrame, rows: int) -> DataFrame:
    """(url, label, share, seen) of at most `rows` urls, with the figures of their suffixes over all hosts but their own."""
    distinct = _distinct(labelled).withColumn("end", suffix(F.col("url"))).withColumn("host", host_of(F.col("url")))
    by_host = durable(distinct.groupBy("end", "host").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")))
    by_end = by_host.groupBy("end").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    others = durable(by_host.join(by_end, "end").select(F.col("host").alias("h"), ((F.col("all_bad") - F.col("bad") + 1) / (F.col("all_n") - F.col("n") + 2)).alias("share"), F.log1p(F.col("all_n") - F.col("n")).alias("seen")))
    chosen = bounded_sample(distinct.select("url", "label", "host"), "url", rows)
    return chosen.join(bounded_broadcast(others), F.col("host") == F.col("h")).select("url", "label", "share", "seen")


def train(labelled: DataFrame, rows: int = TRAINING_ROWS) -> Trees:
    """Trees from (url, label), at most `rows` of them. A url counts once, with the larger of its labels; nulls don't count."""
    got = _training(labelled, rows).orderBy(F.xxhash64("url"), "url").collect()
    return fit(_features([r["url"] for r in got], [(r["share"], r["seen"]) for r in got]), np.array([float(r["label"]) for r in got]), trees=40, depth=4)


def score_urls(urls: DataFrame, model: Trees, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """(row, score): the columns of urls as a struct, and how likely each is unwanted; null and empty urls have a score too. suffixes: statistics()."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, share, seen in parts:
            yield pd.Series(model.score(_features([x if isinstance(x, str) else "" for x in s], list(zip(share, seen, strict=True)))))

    return _with_statistics(urls, suffixes, url).select("row", score(F.col("row")[url], "share", "seen").alias("score"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of pages.

    The longest rule that fits decides, else the trees: block at a score of 0.5 or more. A url
    that is null or has no :// has an empty host and path, no rule, and is allowed. labelled:
    (url, label), label 1 for the unwanted; without, those of pages are labelled by the words in
    their hosts. An empty table of labels blocks nothing. Repeated rows are judged each by itself,
    urls of any length as a whole; other columns don't matter; an empty table gives an empty result.
    """
    slim = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    labelled = durable(labelled_by_words(slim) if labelled is None else labelled.select("url", "label"))
    suffixes = durable(statistics(labelled))
    known = labelled.take(1)
    judged = score_urls(slim.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), train(labelled), suffixes)
    found = judged.select("row.*", "score").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("host") != "") & (F.col("score") >= 0.5) & F.lit(bool(known)), "block").otherwise("allow")
    return found.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), "score")
