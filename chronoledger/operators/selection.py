"""Which rows to audit: exact quotas, lanes taken one after the other, and random draws of known probability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .history import positions, running_sums, same_keys


def _beside(rows: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``totals``, one row for each ``by``."""
    right = totals.select(*[F.col(c).alias("__o_" + c) for c in by], *[c for c in totals.columns if c not in by])
    return rows.join(right, same_keys(rows, right, by, "__o_")).drop(*["__o_" + c for c in by])


def proportional_quotas(sizes: DataFrame, by: Sequence[str], key: Sequence[str], size: str, count: str) -> DataFrame:
    """``sizes`` with ``quota``: ``count`` (one number for each ``by``) dealt over the keys in proportion to ``size``.

    If there are at least as many to deal as keys, each key that has rows gets one first; no key gets more than its size. What
    whole shares leave goes to the largest remainders, ties to the first key. A count beyond all sizes is an error.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    total = sizes.groupBy(*by).agg(F.sum(size).alias("__all"), F.count_if(F.col(size) > 0).alias("__some"), F.count("*").alias("__keys"))
    t = _beside(sizes, total, by).withColumn("__all", F.when(F.col(count) > F.col("__all"), F.raise_error(F.lit("more is to be dealt than there is"))).otherwise(F.col("__all")))
    sure = (F.col(count) >= F.col("__keys")) & (F.col(count) > 0)
    t = t.withColumn("__one", F.when(sure & (F.col(size) > 0), 1).otherwise(0).cast("long")).withColumn("__left", F.greatest(F.col(count) - F.when(sure, F.col("__some")).otherwise(0), F.lit(0)).cast("long"))
    t = t.withColumn("__room", F.col(size) - F.col("__one")).withColumn("__rooms", F.greatest(F.col("__all") - F.when(sure, F.col("__some")).otherwise(0), F.lit(1)).cast("long"))
    share = whole("__left") * whole("__room")
    t = t.withColumn("__share", F.floor(share / whole("__rooms")).cast("long"))
    t = t.withColumn("__share", F.col("__share") - F.when(whole("__share") * whole("__rooms") > share, 1).otherwise(0))  # quotients are rounded
    t = t.withColumn("__rest", -(share - whole("__share") * whole("__rooms")).cast("decimal(38,0)"))
    dealt = t.groupBy(*by).agg(F.sum("__share").alias("__dealt"))
    ranked = positions(_beside(t, dealt, by), by, ["__rest", *key], name="__rank")
    quota = F.col("__one") + F.col("__share") + F.when(F.col("__rank") < F.col("__left") - F.col("__dealt"), 1).otherwise(0)
    return ranked.select(*sizes.columns, quota.cast("long").alias("quota"))


def lanes(rows: DataFrame, key: str, workflow: str, process: str, scores: Mapping[str, str], fractions: Mapping[str, float], count: Column, explored: float = 0.5, seed: int = 7) -> DataFrame:
    """Every row with ``lane`` (``not_selected`` for most) and ``inclusion``, the probability to be chosen.

    ``count`` (an aggregate over all rows) rows are dealt over workflows in proportion. Within a workflow each lane of ``scores`` in
    turn takes its fraction by the highest scores among what is left, ties to the smaller key. Of the last lane's part ``explored`` is
    drawn at random: dealt over processes in proportion or, if there are fewer draws than processes, over all that is left.
    Ranks come from range sorts, so a workflow is not one task's.
    """
    number = rows.agg(count.cast("long").alias("n")).first().n or 0
    sizes = rows.groupBy(workflow).agg(F.count("*").alias("__size")).withColumn("__count", F.lit(number).cast("long"))
    quotas = proportional_quotas(sizes, [], [workflow], "__size", "__count")
    names, quota = list(fractions), F.col("quota")
    fixed = {n: F.floor(F.lit(float(fractions[n])) * quota).cast("long") for n in names[:-1]}
    last = reduce(lambda a, b: a - b, fixed.values(), quota)
    taken = F.floor(F.lit(1.0 - explored) * last).cast("long")
    limits = written(quotas.select(workflow, *[c.alias(f"__n_{n}") for n, c in (fixed | {names[-1]: taken}).items()], (last - taken).alias("__random")), "limits")
    rest, chosen = _beside(rows, limits, [workflow]), []
    for name in names:
        placed = written(positions(rest.withColumn("__turn", -F.col(scores[name]).cast("double")), [workflow], ["__turn", key], name="__rank"), "ranked")
        first = F.col("__rank") < F.col(f"__n_{name}")
        chosen.append(placed.where(first).select(*rows.columns, F.lit(name).alias("lane"), F.lit(1.0).alias("inclusion")))
        rest = placed.where(~first).drop("__rank", "__turn")
    groups = rest.groupBy(workflow).agg(F.count_distinct(F.struct(process)).alias("__groups"), F.max("__random").alias("__random"))
    pooled = written(groups.select(workflow, ((F.col("__random") > 0) & (F.col("__random") < F.col("__groups"))).alias("__pool")), "pools")
    rest = _beside(rest, pooled, [workflow]).withColumn("__stratum", F.when(~F.col("__pool"), F.struct(process)))
    strata = rest.groupBy(workflow, "__stratum").agg(F.count("*").alias("__size"), F.max("__random").alias("__draws"))
    draws = proportional_quotas(strata, [workflow], ["__stratum"], "__size", "__draws").select(workflow, "__stratum", "__size", "quota")
    open_ = _beside(rest, written(draws, "draws"), [workflow, "__stratum"])
    lot = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    drawn = positions(open_.withColumn("__lot", lot), [workflow, "__stratum"], ["__lot", key], name="__rank")
    lane = F.when(F.col("__rank") < F.col("quota"), "process_exploration").otherwise("not_selected")
    chosen.append(drawn.select(*rows.columns, lane.alias("lane"), (F.col("quota") / F.col("__size")).alias("inclusion")))
    return reduce(DataFrame.unionByName, chosen)


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """``by``, ``key`` and ``share``: the value's rank in its group over the group's rows, ties at their middle; without a hot key."""
    placed = positions(rows.select(*by, key, value), by, [value, key])
    ties = placed.groupBy(*by, value).agg((F.min("place") + F.max("place")).alias("__both"))
    sizes = placed.groupBy(*by).agg((F.max("place") + 1).alias("__n"))
    found = _beside(_beside(placed, ties, [*by, value]), sizes, by)
    return found.select(*by, key, ((F.col("__both") / 2 + 1) / F.col("__n")).alias("share"))


def best_factors(rows: DataFrame, by: Sequence[str], key: str, base: str, need: str, target: float, retry: float = 1.0) -> DataFrame:
    """``by``, factor, coverage and cost of the best multiple of ``base`` as a request for ``need`` (whole numbers above 0), by group.

    Every ratio of need by base is tried. A request below the need fails and is paid again with ``retry`` times the need. Factors
    that cover the ``target`` come first, the cheapest of them; without any the one of highest coverage; then the smaller factor.
    Coverage and cost are steps of the sorted ratios: one sort and running sums, no copy of the rows for each factor.
    """
    t = rows.select(*by, key, F.col(base).cast("long").alias("__b"), F.col(need).cast("long").alias("__n")).withColumn("factor", F.col("__n") / F.col("__b"))
    t = running_sums(t, by, ["factor", key], __rank=F.lit(1).cast("long"), __paid=F.col("__n"))
    total = t.groupBy(*by).agg(F.sum("__b").alias("__base"), F.sum("__n").alias("__need"), F.count("*").alias("__all"))
    step = _beside(t.groupBy(*by, "factor").agg(F.max("__rank").alias("__rank"), F.max("__paid").alias("__paid")), total, by)
    step = step.withColumn("coverage", F.col("__rank") / F.col("__all")).withColumn("cost", F.col("factor") * F.col("__base") + retry * (F.col("__need") - F.col("__paid")))
    met = F.col("coverage") >= target
    order = F.struct(F.when(met, 0).otherwise(1), F.when(met, F.col("cost")).otherwise(-F.col("coverage")), "factor")
    return step.groupBy(*by).agg(F.min_by(F.struct("factor", "coverage", "cost"), order).alias("b")).select(*by, "b.*")
