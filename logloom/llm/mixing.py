"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent (1: as it comes, 0: all
alike) is bisected until the weights have the target entropy, or until no source repeats more often than
allowed. Budgets follow from the weights; each source's budget is filled by permutations of its documents, epoch after
epoch, and cut into blocks, so that every block of the mixture holds every source in proportion to its weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import fsum, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm._scan import running_totals
from logloom.llm._spark import written

BLOCK = 1 << 20  # tokens of a block of the mixture
SOURCES = 100_000  # sources whose shares the driver handles; those of more stay in a table, with the same weights and budgets


@dataclass(frozen=True)
class Mixture:
    """Weights and budgets, in the order of ``sources``."""

    sources: list
    tokens: list[int]
    exponent: float
    weights: list[float]
    budgets: list[int]

    @property
    def total(self) -> int:
        return sum(self.budgets)


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    raw = [t**exponent if t else 0.0 for t in tokens]
    whole = fsum(raw)
    return [r / whole if whole else 0.0 for r in raw]


def entropy(weights: list[float]) -> float:
    return -fsum(w * log(w) for w in weights if w)


def most_repeats(tokens: list[int], weights: list[float]) -> float:
    """How often the most repeated source occurs if the least repeated one occurs once."""
    rates = [w / t for w, t in zip(weights, tokens, strict=True) if t]
    return max(rates) / min(rates) if rates else 1.0


def bisect_exponent(tokens: list[int], target_entropy: float | None = None, repeat_limit: float | None = None, steps: int = 60) -> float:
    """The largest exponent in 0..1 with at least the target entropy (0 if none has), and the smallest whose most repeated
    source stays within the limit; the limit comes first."""

    def cut(good) -> tuple[float, float]:  # good falls from true to false between 0 and 1
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low, high

    found = 0.0 if target_entropy is None else 1.0
    if target_entropy is not None and entropy(weights_at(tokens, 1.0)) < target_entropy:
        found = cut(lambda x: entropy(weights_at(tokens, x)) >= target_entropy)[0]
    if repeat_limit is not None and most_repeats(tokens, weights_at(tokens, found)) > repeat_limit:
        found = cut(lambda x: most_repeats(tokens, weights_at(tokens, x)) > repeat_limit)[1]
    return found


def plan(tokens: dict, target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None) -> Mixture:
    """``tokens`` by source. Without ``budget`` it is the least with which no source falls short of one epoch."""
    sources = sorted(tokens, key=lambda s: (s is not None, s))
    counts = [tokens[s] for s in sources]
    exponent = bisect_exponent(counts, target_entropy, repeat_limit)
    weights = weights_at(counts, exponent)
    if budget is None:
        scale = max((t / w for t, w in zip(counts, weights, strict=True) if t), default=0.0)
        budgets = [max(t, round(w * scale)) for t, w in zip(counts, weights, strict=True)]
    else:
        budgets = [round(w * budget) for w in weights]
    return Mixture(sources, counts, exponent, weights, budgets)


def table_exponent(sums: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = None, steps: int = 60) -> float:
    """``bisect_exponent`` of any number of sources: ``sums`` (tokens) stays a table. A pass over it sums up for 15 exponents at once, so 15 passes do what
    60 steps of bisection do; repeats follow from the largest and the smallest source alone."""
    most, least = sums.where("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
    if most is None:
        return 0.0 if target_entropy is None else 1.0

    def entropies(exponents: list[float]) -> list[float]:
        t, parts = F.col("tokens").cast("double"), []
        for x in exponents:
            parts += [F.sum(F.pow(t, F.lit(x))), F.sum(F.pow(t, F.lit(x)) * F.ln(t))]
        row = sums.where("tokens > 0").agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
        return [log(row[2 * i]) - x * row[2 * i + 1] / row[2 * i] for i, x in enumerate(exponents)]

    repeats = lambda x: (most / least) ** (1 - x)
    found = 0.0 if target_entropy is None else 1.0
    if target_entropy is not None and entropies([1.0])[0] < target_entropy:
        low, high = 0.0, 1.0
        for _ in range(steps // 4):
            grid = [low + (high - low) * i / 16 for i in range(1, 16)]
            good = [x for x, h in zip(grid, entropies(grid), strict=True) if h >= target_entropy]
            low, high = max(good, default=low), min((x for x in grid if x not in good), default=high)
        found = low
    if repeat_limit is not None and repeats(found) > repeat_limit:
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if repeats(mid) > repeat_limit else (low, mid)
        found = high
    return found


def table_plan(sums: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None) -> tuple[DataFrame, float]:
    """``plan`` of any number of sources: (name, held, weight, budget, whole) as a table, and the exponent."""
    exponent = table_exponent(sums, target_entropy, repeat_limit)
    powered = sums.withColumn("power", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0))
    whole, scale = powered.agg(F.sum("power"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power")))).first()
    weight = F.col("power") / whole if whole else F.lit(0.0)
    rows = powered.select(F.col("source").alias("name"), F.col("tokens").alias("held"), weight.alias("weight"))
    given = F.bround(F.col("weight") * (budget if budget is not None else (scale or 0.0) * (whole or 0.0))).cast("long")
    rows = rows.withColumn("budget", given if budget is not None else F.greatest("held", given))
    return written(rows.withColumn("whole", F.when(F.col("held") > 0, F.expr("budget div held")).otherwise(1)), "mixture"), exponent


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    repeat_limit: float | None = 2.0,
    budget: int | None = None,
    block: int = BLOCK,
    seed: int = 0,
    sources: int = SOURCES,
) -> DataFrame:
    """One row for each time that a document occurs: doc_id, source, text_hash, tokens, epoch, start, block, order_key, exponent, weight.

    ``tokens`` counts words. ``start`` is the tokens of the same source that come before; an occurrence belongs to
    the mixture if its start lies within its source's budget. Documents without tokens occur once. ``block`` is the block of the
    mixture that holds it, ``order_key`` its place there (a hash). Without ``budget``, every document occurs at least once and
    none is left out; a given budget may sample large sources. Shares of up to ``sources`` sources are worked out on the driver,
    those of more in a table, with the same result.

    Null sources are one source, null texts have no tokens; null ids and repeated rows are mixed as rows of their own.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("tokens")
    )
    rows = written(rows, "tokens")
    sums = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    few = sums.limit(sources + 1).collect()
    if len(few) > sources:
        by_source, exponent = table_plan(sums, target_entropy, repeat_limit, budget)
    else:
        mixture = plan({r.source: r.tokens for r in few}, target_entropy, repeat_limit, budget)
        planned = [
            (s, t, w, b, b // t if t else 1) for s, t, w, b in zip(mixture.sources, mixture.tokens, mixture.weights, mixture.budgets, strict=True)
        ]
        by_source = F.broadcast(spark.createDataFrame(planned, "name string, held long, weight double, budget long, whole long"))
        exponent = mixture.exponent
    known = rows.join(by_source, F.col("source").eqNullSafe(F.col("name")))
    # Whole epochs, and one more of which the budget takes a part. A document without tokens occurs in the first only.
    last = F.when(F.col("tokens") == 0, 0).when((F.col("held") > 0) & (F.col("budget") > F.col("whole") * F.col("held")), F.col("whole")).otherwise(F.col("whole") - 1)
    occurring = known.where((last >= 0) | (F.col("tokens") == 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))))
    keyed = occurring.select(
        "doc_id", "source", "text_hash", "tokens", "epoch", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash").alias("order_key"), "weight", "budget"
    )
    placed = running_totals(keyed, ["source"], ["epoch", "order_key", "doc_id"], "tokens", "start")
    taken = placed.where((F.col("start") < F.col("budget")) | (F.col("tokens") == 0))
    per_block = F.greatest(F.lit(1.0), F.col("weight") * block)
    return taken.select(
        "doc_id", "source", "text_hash", "tokens", "epoch", "start", F.floor(F.col("start") / per_block).cast("long").alias("block"), "order_key",
        F.lit(exponent).alias("exponent"), "weight",
    )


def mixed_documents(docs: DataFrame, repeat_limit: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it."""
    found = mix(docs, id_col, text_col, source_col, repeat_limit=repeat_limit)
    keys = ["__id", "__source", "__hash"]
    times = found.groupBy(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "text_hash"), keys, strict=True)]).agg(F.count("*").alias("__times"))
    # Equal rows were counted together: each takes its part, and what is left over goes to the first epochs of all of them alike.
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"))
    rows = own.groupBy(*[F.col(c).alias(f"{k}n") for c, k in zip(("doc_id", "source", "text_hash"), keys, strict=True)]).agg(F.count("*").alias("__rows"))
    both = times.join(rows, [F.col(k).eqNullSafe(F.col(f"{k}n")) for k in keys]).select(*keys, F.ceil(F.col("__times") / F.col("__rows")).cast("int").alias("__each"))
    same = F.col("__id").eqNullSafe(F.col(id_col)) & F.col("__source").eqNullSafe(F.col(source_col).cast("string")) & (F.col("__hash") == F.xxhash64(text_col))
    joined = docs.join(both.hint("shuffle_hash"), same)
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__each")))).select(*docs.columns)
