"""Fitting sections into a token budget, for any number of packs at once.

Input rows: pack_id, ord, priority, name, content, token_estimate. Priority 0
is exempt. One exchange by pack serves a strategy; ``truncate`` and
``proportional`` are window sums, ``priority`` is a fold over (priority, ord,
tokens) only - contents never enter an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import estimate

#: Priorities and the markers of cut sections.
EXEMPT, ERROR, DIFF, MAP, ENTRY, TESTS = range(6)
TRUNCATED = "\n\n[... truncated by --budget-strategy=truncate ...]"
SCALED = "\n\n[... truncated by --budget-strategy=proportional ...]"
STRATEGIES = ("priority", "truncate", "proportional")


@dataclass(frozen=True)
class Budget:
    max_tokens: int = 8000
    reserve: int = 2000
    strategy: str = "priority"

    @property
    def effective(self) -> int:
        return max(self.max_tokens - self.reserve, 0)


def effective(max_tokens: Column, reserve: Column) -> Column:
    return F.greatest(max_tokens - reserve, F.lit(0))


def _zero():
    return F.lit(0).cast("bigint")


def _with_room(sections: DataFrame, limit) -> DataFrame:
    """Adds ``room``: what exempt sections leave of the limit."""
    limit = F.lit(limit).cast("bigint") if isinstance(limit, int) else limit
    exempt = F.sum(F.when(F.col("priority") == EXEMPT, F.col("token_estimate")).otherwise(0)).over(Window.partitionBy("pack_id"))
    return sections.select("pack_id", "ord", "priority", "name", "content", "token_estimate", F.greatest(limit - exempt, _zero()).alias("room"))


def _decided(df: DataFrame, outcome: Column, final: Column, reason: Column, content: Column) -> DataFrame:
    exempt = F.col("priority") == EXEMPT
    return df.select(
        "pack_id", "ord", "priority", "name",
        F.col("token_estimate").cast("bigint").alias("original_tokens"),
        F.when(exempt, F.col("token_estimate")).otherwise(final).cast("bigint").alias("final_tokens"),
        F.when(exempt, F.lit("kept")).otherwise(outcome).alias("outcome"),
        F.when(exempt, F.lit("exempt")).otherwise(reason).alias("reason"),
        F.when(exempt, F.col("content")).otherwise(content).alias("content"),
    )


def priority(sections: DataFrame, limit) -> DataFrame:
    """Greedy: a section that doesn't fit is skipped, later ones still may.
    Sections of a pack with the same ``ord`` are told apart by their priority,
    tokens, name and content; equal ones go in any order."""
    same = Window.partitionBy("pack_id", "ord").orderBy("priority", "token_estimate", "name", "content")
    sections = _with_room(sections, limit).withColumn("again", F.row_number().over(same).cast("bigint"))
    lean = sections.select("pack_id", "ord", "again", "priority", F.col("token_estimate").cast("bigint").alias("token_estimate"), "room")
    rows = lean.where(F.col("priority") != EXEMPT).groupBy("pack_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("priority").cast("bigint").alias("p"), F.col("ord").cast("bigint").alias("o"), F.col("again").alias("a"), F.col("token_estimate").alias("t")))).alias("xs"), F.max("room").alias("room")
    )
    start = F.struct(_zero().alias("run"), F.array().cast("array<struct<o: bigint, a: bigint>>").alias("kept"))

    def step(acc, x):
        fits = acc["run"] + x["t"] <= F.col("room")
        return F.struct(F.when(fits, acc["run"] + x["t"]).otherwise(acc["run"]).alias("run"), F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["o"].alias("o"), x["a"].alias("a"))))).otherwise(acc["kept"]).alias("kept"))

    kept = rows.select("pack_id", F.explode(F.aggregate("xs", start, step, lambda a: a["kept"])).alias("k"))
    kept = kept.select("pack_id", F.col("k.o").alias("ord"), F.col("k.a").alias("again"), F.lit(True).alias("fits"))
    out = sections.join(kept, ["pack_id", "ord", "again"], "left")
    fits = F.coalesce("fits", F.lit(False))
    return _decided(
        out,
        F.when(fits, F.lit("kept")).otherwise(F.lit("dropped")),
        F.when(fits, F.col("token_estimate")).otherwise(0),
        F.when(~fits, F.lit("priority budget exhausted")),
        F.when(fits, F.col("content")),
    )


def truncate(sections: DataFrame, limit, tokenizer: str = "chars-div4") -> DataFrame:
    """The first section that overflows is cut to what is left, the rest goes."""
    df = _with_room(sections, limit)
    own = F.when(F.col("priority") != EXEMPT, F.col("token_estimate")).otherwise(0)
    run = Window.partitionBy("pack_id").orderBy((F.col("priority") != EXEMPT).cast("int"), "priority", "ord")
    before = F.coalesce(F.sum(own).over(run.rowsBetween(Window.unboundedPreceding, -1)), _zero())
    df = df.withColumn("before", before)
    cut = (F.col("priority") != EXEMPT) & (F.col("before") < F.col("room")) & (F.col("before") + F.col("token_estimate") > F.col("room"))
    df = df.withColumn("cut", cut).withColumn("any_cut", F.max("cut").over(Window.partitionBy("pack_id")))
    fits = (F.col("before") < F.col("room")) & (F.col("before") + F.col("token_estimate") <= F.col("room"))
    left = (F.col("room") - F.col("before")).cast("double")
    share = F.least(left / F.greatest(F.col("token_estimate"), F.lit(1)).cast("double"), F.lit(1.0))
    target = (F.length("content").cast("double") * share * F.lit(0.95)).cast("bigint")
    short = F.concat(F.substr(F.col("content"), F.lit(1), target.cast("int")), F.lit(TRUNCATED))
    return _decided(
        df,
        F.when(fits, F.lit("kept")).when(F.col("cut"), F.lit("truncated")).otherwise(F.lit("dropped")),
        F.when(fits, F.col("token_estimate")).when(F.col("cut"), estimate(short, tokenizer)).otherwise(0),
        F.when(F.col("cut"), F.lit("hard truncated to remaining budget")).when(~fits, F.when(F.col("any_cut"), F.lit("truncate stops after first overflow")).otherwise(F.lit("truncate budget exhausted"))),
        F.when(fits, F.col("content")).when(F.col("cut"), short),
    )


def proportional(sections: DataFrame, limit, tokenizer: str = "chars-div4") -> DataFrame:
    """Every section shrinks by the same ratio, if they don't fit as they are."""
    df = _with_room(sections, limit)
    own = F.when(F.col("priority") != EXEMPT, F.col("token_estimate")).otherwise(0)
    df = df.withColumn("total", F.sum(own).over(Window.partitionBy("pack_id")))
    tokens = F.col("token_estimate")
    target = F.floor(tokens.cast("double") * (F.col("room").cast("double") / F.nullif(F.col("total"), _zero()).cast("double"))).cast("bigint")
    body = target - estimate(F.lit(SCALED), tokenizer)
    # Free of competition, or nothing to scale: as it is.
    whole = (F.col("total") <= F.col("room")) | (F.col("total") == 0) | ((target > 0) & (target >= tokens))
    zero, tight = ~whole & (F.coalesce(target, _zero()) == 0), ~whole & (target > 0) & (body <= 0)
    chars = (F.length("content").cast("double") * body.cast("double") / F.greatest(tokens, F.lit(1)).cast("double")).cast("bigint")
    short = F.concat(F.substr(F.col("content"), F.lit(1), F.greatest(chars, _zero()).cast("int")), F.lit(SCALED))
    return _decided(
        df,
        F.when(whole, F.lit("kept")).when(zero | tight, F.lit("dropped")).otherwise(F.lit("truncated")),
        F.when(whole, tokens).when(zero | tight, 0).otherwise(estimate(short, tokenizer)),
        F.when(whole, F.lit(None)).when(zero, F.lit("proportional share rounded to zero")).when(tight, F.lit("proportional share cannot fit truncation marker")).otherwise(F.lit("proportionally truncated")),
        F.when(whole, F.col("content")).when(~zero & ~tight, short),
    )


def allocate(sections: DataFrame, budget: Budget, limit=None, tokenizer: str = "chars-div4") -> DataFrame:
    """Decisions of the budget's strategy: one row per section, with the
    content that stays (null if dropped)."""
    limit = budget.effective if limit is None else limit
    if budget.strategy == "priority":
        return priority(sections, limit)
    if budget.strategy == "truncate":
        return truncate(sections, limit, tokenizer)
    if budget.strategy == "proportional":
        return proportional(sections, limit, tokenizer)
    raise ValueError(f"unknown strategy {budget.strategy!r}")


def outcome(decisions: DataFrame) -> DataFrame:
    """Per pack: tokens used, sections kept, truncated and dropped."""
    of = lambda x: F.count_if(F.col("outcome") == x)
    return decisions.groupBy("pack_id").agg(F.sum("final_tokens").alias("tokens_used"), of("kept").alias("kept"), of("truncated").alias("truncated"), of("dropped").alias("dropped"))
