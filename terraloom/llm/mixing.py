"""Operator 8: temperature mixing of sources to target weights.

Source shares of tokens are raised to an exponent between 0 and 1 and normalised; the exponent
is bisected until the mixture has the target entropy or stays within the repetition limit,
whichever is nearer to the natural shares. Two sums over the sources are all that a step of the
bisection needs, so sources may be as many as hosts: few are summed here, many in Spark, a
grid of exponents in one job. The weights are then realised as block permutations:
the rows of a source lie in hashed blocks, blocks are in a permuted order for each epoch, and
running token totals by block, then inside a block, decide which rows the budget still covers.
No source is sorted or gathered as a whole, so a source with a third of all rows is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import UNIT_SQL, bounded_broadcast, durable, packed_rows, unit_hash, unpacked, words

MAX_REPETITION = 4.0
ENTROPY_SHARE = 0.9
BLOCK_ROWS = 2048
#: Sources up to so many are summed on the driver, more by Spark.
FEW_SOURCES = 20_000
#: Exponents tried at a time, and how often the interval between two of them is taken anew.
GRID, ROUNDS = 32, 12

#: For exponents x: the sums over sources of share ** x, and of share ** x * log(share).
Sums = Callable[[Sequence[float]], list[tuple[float, float]]]


def sums_of(tokens: Sequence[float]) -> Sums:
    shares = [t / sum(tokens) for t in tokens if t > 0]
    return lambda xs: [(math.fsum(p**x for p in shares), math.fsum(p**x * math.log(p) for p in shares)) for x in xs]


def sums_in_spark(sources: DataFrame, total: float) -> Sums:
    share = F.col("tokens") / total

    def run(xs: Sequence[float]) -> list[tuple[float, float]]:
        powers = [F.pow(share, F.lit(float(x))) for x in xs]
        row = sources.where("tokens > 0").agg(*[F.sum(p) for p in powers], *[F.sum(p * F.log(share)) for p in powers]).collect()[0]
        return [(row[i], row[len(xs) + i]) for i in range(len(xs))]

    return run


def _least(good: Callable[[float, tuple[float, float]], bool], sums: Sums) -> float:
    """The exponent nearest to 0 for which good holds; good holds from some point up to 1."""
    low, high = 0.0, 1.0
    if good(low, sums([low])[0]):
        return low
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / GRID for k in range(1, GRID)]
        held = [good(x, s) for x, s in zip(tried, sums(tried), strict=True)]
        first = held.index(True) if True in held else len(held)
        low, high = (tried[first - 1] if first else low), (tried[first] if first < len(held) else high)
    return high


def solve(total: float, least: float, most: float, n: int, sums: Sums, budget: float | None, entropy_share: float | None, max_repetition: float) -> tuple[float, float, float]:
    """(exponent, sum of powers, budget) for n sources that have tokens, least to most of them, of a total.

    entropy_share: the target entropy, as a share of that of equal weights (None: the limit on
    repetition alone decides). budget None: the least budget that covers every source once. A
    source's weight is its share to the power of the exponent, over the sum of powers.
    """
    if not n:
        return 1.0, 1.0, 0.0
    small, large = least / total, most / total

    def need(x: float, z: float) -> float:
        """The budget: shares over weights are largest for the largest source."""
        return budget if budget is not None else total * z * large ** (1 - x)

    def fits(x: float, s: tuple[float, float]) -> bool:
        """Repetition is largest for the smallest source."""
        return need(x, s[0]) * small ** (x - 1) <= max_repetition * total * s[0] * (1 + 1e-12)

    def flat(x: float, s: tuple[float, float]) -> bool:
        """Whether the mixture of exponent 1 - x has the target entropy: entropy falls as the exponent rises."""
        return math.log(s[0]) - (1 - x) * s[1] / s[0] >= (entropy_share or 0.0) * math.log(n) * (1 if n > 1 else 0) - 1e-12

    exponent = _least(fits, sums)
    if entropy_share is not None:
        exponent = max(exponent, 1.0 - _least(flat, lambda xs: sums([1.0 - x for x in xs])))
    z = sums([exponent])[0][0]
    return exponent, z, need(exponent, z)


def _sources(rows: DataFrame) -> DataFrame:
    """(source, n_docs, tokens): pre-aggregated before the shuffle. A null source is a source."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").cast("long").alias("tokens"))


def quotas(sources: DataFrame, budget_share: float | None, entropy_share: float | None, max_repetition: float, few: int = FEW_SOURCES) -> DataFrame:
    """(of, weight, quota, total, blocks, epochs) for every source; sources must be durable."""
    r = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"), F.max("tokens").alias("most"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n")).collect()[0]
    total = float(r["total"])
    sums = sums_of([x["tokens"] for x in sources.select("tokens").collect()]) if r["n"] <= few and total else sums_in_spark(sources, total or 1.0)
    exponent, z, budget = solve(total, float(r["least"] or 0), float(r["most"] or 0), r["n"], sums, None if budget_share is None else budget_share * total, entropy_share, max_repetition)
    some = F.col("tokens") > 0
    weight = F.when(some, F.pow(F.col("tokens") / (total or 1.0), F.lit(exponent)) / z).otherwise(0.0)
    quota = F.when(some, weight * budget).otherwise(1.0)
    epochs = F.when(some, F.greatest(F.lit(0), F.ceil(F.try_divide(weight * budget, F.col("tokens")) - 1e-9).cast("int") - 1)).otherwise(0)
    return sources.select(F.col("source").alias("of"), weight.alias("weight"), quota.alias("quota"), F.col("tokens").alias("total"), F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("int").alias("blocks"), epochs.alias("epochs"))


def mixture(docs: DataFrame, source: str = "source", text: str = "text", budget_share: float | None = 1.0, entropy_share: float | None = ENTROPY_SHARE, max_repetition: float = MAX_REPETITION, keys_only: bool = False, few: int = FEW_SOURCES) -> DataFrame:
    """(row, draw): a row of docs as a struct (keys_only: of doc_id and source alone), for each time that it is drawn.

    draw: tokens, weight, epoch (0 at first), block, at (the tokens of its source drawn before
    it, over all epochs). A row is drawn in an epoch while `at` is below its source's quota, the
    weight's share of the budget. budget_share: the budget over all tokens of the corpus; None:
    the least that draws every row at least once. Rows without words are drawn with the rows
    beside them, at no cost. Null texts have no tokens; repeated rows are drawn each by itself.
    An empty table gives an empty result. Columns of any name are carried as they are.
    """
    known = {
        "source": F.col(source),
        "id": F.col("doc_id"),
        "tokens": F.size(words(F.col(text))).cast("long"),
    }
    slim = durable(docs.select(*[c.alias(k) for k, c in known.items()]))
    plan = bounded_broadcast(durable(quotas(durable(_sources(slim)), budget_share, entropy_share, max_repetition, few)))

    def dealt(rows: DataFrame) -> DataFrame:
        """Which rows share a block depends on the row, not on the epoch; the order of blocks does on both."""
        return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.floor(unit_hash(F.col("id"), "block", F.col("tokens")) * F.col("blocks")).cast("int"))

    by_block = dealt(slim).groupBy("of", "block").agg(F.sum("tokens").alias("n"), F.first("quota").alias("quota"), F.first("total").alias("total"), F.first("epochs").alias("epochs"))
    by_block = by_block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    order = Window.partitionBy("of", "epoch").orderBy(unit_hash("order", F.col("block"), F.col("epoch")), "block")
    starts = by_block.withColumn("start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + F.col("epoch") * F.col("total"))
    starts = starts.where(F.col("start") < F.col("quota")).groupBy(F.col("of").alias("s"), F.col("block").alias("b")).agg(F.collect_list(F.struct("epoch", "start")).alias("starts"))
    inside = Window.partitionBy("of", "block").orderBy(unit_hash("row", F.col("id"), F.col("tokens")), "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = slim.select(F.struct(F.col("id").alias("doc_id"), F.col("source").alias(source)).alias("row"), "*") if keys_only else packed_rows(docs, **known)
    rows = dealt(rows).withColumn("before", F.sum("tokens").over(inside) - F.col("tokens"))
    drawn = rows.join(starts, F.col("of").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("one", F.explode("starts"))
    at = F.col("one.start") + F.col("before")
    draw = F.struct("tokens", "weight", F.col("one.epoch").alias("epoch"), "block", at.alias("at"))
    return drawn.where(at < F.col("quota")).select("row", draw.alias("draw"))


def draws(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, weight, epoch, block, at): each draw of the tempered mixture."""
    return mixture(docs, keys_only=True).select("row.*", "draw.*")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs, each row at least once, small sources repeated up to a quarter more often."""
    return unpacked(mixture(docs, budget_share=None, entropy_share=None, max_repetition=1.25), docs.columns)


def _bisected(name: str, holds: str) -> str:
    """SQL of the exponent nearest to 0 for which a condition on x, z and zl holds: the sums over sources of share ** x, and of that times log(share)."""
    return f"""{name}(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT i + 1, CASE WHEN {holds} THEN lo ELSE mid END, CASE WHEN {holds} THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, mid, x, any_value(least) AS least, any_value(total) AS total, any_value(n) AS n, sum(pow(tokens / total, x)) AS z, sum(pow(tokens / total, x) * ln(tokens / total)) AS zl
    FROM (SELECT *, (lo + hi) / 2 AS mid, {'1 - ' if name == 'flat' else ''}(lo + hi) / 2 AS x FROM {name} WHERE i < 70) f, t, s WHERE tokens > 0 GROUP BY i, lo, hi, mid, x))"""


#: SQL of draws().
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens) AS total, min(CASE WHEN tokens > 0 THEN tokens END) AS least, count(CASE WHEN tokens > 0 THEN 1 END) AS n FROM s),
{_bisected("fit", f"pow(least / total, x - 1) <= {MAX_REPETITION} * z * (1 + 1e-12)")},
{_bisected("flat", f"ln(z) - x * zl / z >= {ENTROPY_SHARE} * ln(n) - 1e-12")},
x AS (SELECT greatest((SELECT hi FROM fit WHERE i = 70), 1 - (SELECT hi FROM flat WHERE i = 70)) AS x),
z AS (SELECT x, sum(pow(tokens / total, x)) AS z FROM s, t, x WHERE tokens > 0 GROUP BY x),
plan AS (SELECT source, tokens AS all_tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, x) / z ELSE 0 END AS weight, CASE WHEN tokens > 0 THEN pow(tokens / total, x) / z * total ELSE 1 END AS quota, CAST(ceil(n_docs / {BLOCK_ROWS}) AS INT) AS blocks FROM s, t, z),
dealt AS (SELECT doc_id, d.source, key, tokens, weight, quota, all_tokens, CASE WHEN all_tokens > 0 THEN greatest(0, CAST(ceil(quota / all_tokens - 1e-9) AS INT) - 1) ELSE 0 END AS epochs, CAST(floor({UNIT_SQL.format("key || '|block|' || tokens")} * blocks) AS INT) AS block FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, block, n, quota, all_tokens, unnest(range(epochs + 1)) AS epoch FROM (SELECT source, block, sum(tokens) AS n, any_value(quota) AS quota, any_value(all_tokens) AS all_tokens, any_value(epochs) AS epochs FROM dealt GROUP BY source, block)),
starts AS (SELECT source, block, epoch, sum(n) OVER (PARTITION BY source, epoch ORDER BY {UNIT_SQL.format("'order|' || block || '|' || epoch")}, block ROWS UNBOUNDED PRECEDING) - n + epoch * all_tokens AS start FROM b),
inside AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY {UNIT_SQL.format("'row|' || key || '|' || tokens")}, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM dealt)
SELECT doc_id, i.source AS source, tokens, round(weight, 9) AS weight, CAST(epoch AS INT) AS epoch, i.block AS block, CAST(start + before AS BIGINT) AS "at" FROM inside i JOIN starts b ON i.source IS NOT DISTINCT FROM b.source AND i.block = b.block WHERE start + before < quota AND start < quota"""
