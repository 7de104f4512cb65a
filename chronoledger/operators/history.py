"""Point-in-time history: as-of state and trailing statistics, without a theta join.

No step gives a key to one task: places within a key come from a range-partitioned sort and the counts of the partitions
before, and trailing frames from blocks of places, each with the places before it that its frames reach back to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import Scratch, partitions, release_shuffles, written

_PART, _ONE, _BEFORE, _INNER, _BLOCK, _OWN, _ROW = (f"__place_{n}" for n in ("part", "one", "before", "inner", "block", "own", "row"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Equal keys, null like null; the right side's begin with ``prefix``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys], F.lit(True))


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], counted: Column | None = None, name: str = "place", write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``rows`` with ``name``: how many rows of the same key (those that are ``counted``) come before in ``order``.

    ``order`` should tell rows of a key apart; nulls come first and a null key is a key. ``write`` makes the sorted table.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    cut = rows.repartitionByRange(partitions(rows.sparkSession), *by, *order).withColumn(_PART, F.spark_partition_id()).withColumn(_ONE, one.cast("long"))
    cut = write(cut, "ranges")
    up = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(_PART, *by).agg(F.sum(_ONE).alias(_ONE)).withColumn(_BEFORE, up(_ONE, Window.partitionBy(*by).orderBy(_PART)))
    sums = sums.select(_BEFORE, *[F.col(k).alias("__k_" + k) for k in (_PART, *by)])
    inner = cut.withColumn(_INNER, up(_ONE, Window.partitionBy(_PART, *by).orderBy(*order)))
    found = inner.join(sums, same_keys(inner, sums, (_PART, *by), "__k_"))
    return found.select(*rows.columns, (F.col(_BEFORE) + F.col(_INNER)).alias(name))


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], write: Callable[[DataFrame, str], DataFrame] = written, highs: Mapping[str, Column] | None = None, **sums: Column) -> DataFrame:
    """``rows`` with the sums (and the maxima ``highs``) of all rows of the same key up to and with each in ``order``, which should tell them apart.

    As with ``positions``, a key is spread over ranges of its order, and ``write`` makes the sorted table.
    """
    highs = highs or {}
    total = {**{n: F.sum for n in sums}, **{n: F.max for n in highs}}
    cut = rows.withColumns({f"__s_{n}": c for n, c in (*sums.items(), *highs.items())}).repartitionByRange(partitions(rows.sparkSession), *by, *order)
    cut = write(cut.withColumn(_PART, F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(_PART, *by).agg(*[f(f"__s_{n}").alias(f"__s_{n}") for n, f in total.items()])
    upto = {n: f(f"__s_{n}").over(earlier) for n, f in total.items()}
    before = before.select(*[(F.coalesce(c, F.lit(0)) if n in sums else c).alias(f"__b_{n}") for n, c in upto.items()], *[F.col(k).alias("__k_" + k) for k in (_PART, *by)])
    within = Window.partitionBy(_PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumns({f"__i_{n}": f(f"__s_{n}").over(within) for n, f in total.items()})
    found = inner.join(before, same_keys(inner, before, (_PART, *by), "__k_"))
    both = lambda n: F.col(f"__b_{n}") + F.col(f"__i_{n}") if n in sums else F.greatest(f"__b_{n}", f"__i_{n}")
    return found.select(*rows.columns, *[both(n).alias(n) for n in total])


def asof(decisions: DataFrame, outcomes: DataFrame, on: Sequence[str], at: str, done: str, state: Sequence[str], tie: str) -> DataFrame:
    """Attaches to each decision the ``state`` of the last outcome completed strictly before it.

    Decisions and outcomes are one sorted sequence per key, decisions first at equal times, so an outcome that
    completes at the decision time stays invisible. A decision's place among outcomes names the last one: an equi-join.
    """
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    left = decisions.select(*on, F.col(at).alias("__time"), F.lit(0).alias("__kind"), nothing(outcomes, tie).alias("__tie"), F.struct(*decisions.columns).alias("__d"))
    right = outcomes.select(*on, F.col(done).alias("__time"), F.lit(1).alias("__kind"), F.col(tie).alias("__tie"), F.struct(*state).alias("__s"))
    both = positions(left.unionByName(right, allowMissingColumns=True), on, ["__time", "__kind", "__tie"], F.col("__kind") == 1)
    asks = both.where("__kind = 0").select(*on, (F.col("place") - 1).alias("place"), "__d")
    last = both.where("__kind = 1").select("__s", *[F.col(k).alias("__o_" + k) for k in (*on, "place")])
    found = asks.join(last, same_keys(asks, last, (*on, "place"), "__o_"), "left")
    return found.select("__d.*", *[F.col(f"__s.{c}").alias(f"last_{c}") for c in state])


def _blocked(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int, width: int, before: int = 0) -> DataFrame:
    """Rows with their places in blocks of ``width`` places; a block also gets the places that its frames, which end ``before`` a row, reach back to."""
    placed = positions(rows, by, order)
    block = F.floor(F.col("place") / width)
    reach = F.floor((F.col("place") + size - 1 + before) / width)  # the last block whose frames reach this place
    return placed.withColumn(_BLOCK, F.explode(F.sequence(block, reach))).withColumn(_OWN, F.col(_BLOCK) == block)


def trailing(rows: DataFrame, scope: Sequence[str], order: Sequence[str], size: int, **aggs: Column) -> DataFrame:
    """Aggregates over the ``size`` rows up to and with each row of its scope, and ``support``, the whole scope so far."""
    if not aggs:
        return positions(rows, scope, order).select(*rows.columns, (F.col("place") + 1).alias("support"))
    by = Window.partitionBy(*scope, _BLOCK).orderBy(*order).rowsBetween(1 - size, Window.currentRow)
    found = _blocked(rows, scope, order, size, max(size, 1024)).withColumns({name: agg.over(by) for name, agg in aggs.items()})
    return found.where(_OWN).select(*rows.columns, *aggs, (F.col("place") + 1).alias("support"))


def _quantiles(size: int, asked: Sequence[tuple], out: pa.Schema, before: int = 0):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        own = np.flatnonzero(np.asarray(table[_OWN]))
        if not len(own):
            return out.empty_table()
        frames, columns = {}, []
        for c, q, *how in asked:
            if c not in frames:
                x = np.asarray(table[c].cast(pa.float64()).fill_null(np.inf), np.float64)
                x = np.concatenate((np.full(size - 1 + before, np.inf), np.where(np.isnan(x), np.inf, x)))
                frame = np.sort(np.lib.stride_tricks.sliding_window_view(x, size)[own], 1)
                frames[c] = frame, np.isfinite(frame).sum(1)
            frame, n = frames[c]
            at, row = (np.maximum(n, 1) - 1) * q, np.arange(len(own))
            if how == ["higher"]:
                some = np.maximum(n, 1)
                lo = np.ceil(np.minimum(1, np.ceil((some + 1) * q) / some) * (some - 1)).astype(np.int64)
                columns.append(pa.array(frame[row, lo], mask=n == 0))
                continue
            lo = np.floor(at).astype(np.int64)
            hi = np.minimum(lo + 1, np.maximum(n, 1) - 1)
            low, high = frame[row, lo], frame[row, hi]
            value = low + np.where(hi > lo, high - low, 0) * (at - lo)
            columns.append(pa.array(value, mask=n == 0))
        return pa.table([table[_ROW].take(pa.array(own)), table["place"].take(pa.array(own)), *columns], schema=out)

    return run


def trailing_quantiles(rows: DataFrame, scope: Sequence[str], order: Sequence[str], size: int, **asked: tuple) -> DataFrame:
    """Linear quantiles (name=(column, q)), or conformal ones that take the next higher value (name=(column, q, "higher")), over the ``size`` rows up to and with each row of its scope, and ``support``.

    Null and NaN values are left out; a frame without values gives null. One sorted frame serves all quantiles of a column.
    """
    found = _framed(rows, scope, order, size, F.lit(True), 0, asked)
    return found.select(*rows.columns, *asked, (F.col("place") + 1).alias("support"))


def earlier_quantiles(rows: DataFrame, scope: Sequence[str], order: Sequence[str], size: int, ask: Column, **asked: tuple) -> DataFrame:
    """``before_each`` of ``trailing_quantiles``, of the rows that ``ask`` names only: all others are no more than places in frames."""
    found = _framed(rows, scope, order, size, F.coalesce(ask, F.lit(False)), 1, asked)
    return found.select(*rows.columns, *asked, F.col("place").alias("support"))


def _framed(rows: DataFrame, scope: Sequence[str], order: Sequence[str], size: int, ask: Column, before: int, asked: Mapping[str, tuple]) -> DataFrame:
    columns = sorted({c for c, *_ in asked.values()})
    cut = _blocked(rows, scope, order, size, size, before).withColumn(_OWN, F.col(_OWN) & ask)
    cut = cut.select(*scope, _BLOCK, _OWN, "place", *[F.col(c).alias(f"__v_{c}") for c in columns], F.when(F.col(_OWN), F.struct(*rows.columns)).alias(_ROW))
    schema = cut.select(_ROW, "place").schema
    for name in asked:
        schema = schema.add(name, "double")
    run = _quantiles(size, [(f"__v_{c}", *how) for c, *how in asked.values()], to_arrow_schema(schema), before)
    return cut.groupBy(*scope, _BLOCK).applyInArrow(run, schema).select(f"{_ROW}.*", "place", *asked)


def before_each(seen: DataFrame, scope: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Trailing results as each row found them: ``state`` and ``support`` of the row before in its scope, null (0) for the first."""
    last = seen.select(*[F.col(k).alias("__o_" + k) for k in scope], (F.col("support") + 1).alias("__o_support"), *[F.col(c).alias("__s_" + c) for c in state])
    found = seen.join(last, same_keys(seen, last, (*scope, "support"), "__o_"), "left")
    kept = [F.col(f"__s_{c}").alias(c) if c in state else F.col(c) for c in seen.columns if c != "support"]
    return found.select(*kept, (F.col("support") - 1).alias("support"))


def visible(decisions: DataFrame, outcomes: DataFrame, on: Sequence[str], at: str, done: str, tie: str, key: Sequence[str], counted: Column | None = None) -> DataFrame:
    """``on``, ``key`` and ``support``: how many outcomes (those that are ``counted``) completed strictly before each decision."""
    left = decisions.select(*on, F.col(at).alias("__time"), F.lit(0).alias("__kind"), F.lit(None).cast(outcomes.schema[tie].dataType).alias("__tie"), F.struct(*key).alias("__d"))
    right = (outcomes if counted is None else outcomes.where(counted)).select(*on, F.col(done).alias("__time"), F.lit(1).alias("__kind"), F.col(tie).alias("__tie"))
    both = positions(left.unionByName(right, allowMissingColumns=True), on, ["__time", "__kind", "__tie"], F.col("__kind") == 1)
    return both.where("__kind = 0").select(*on, "__d.*", F.col("place").alias("support"))


#: Outcomes of a scope up to which one task takes it whole, and asks that a task takes beside them.
WIDTH = 1 << 19


def kth_of_first(ranks: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each ask the ``k``-th smallest (from 1) of the first ``n`` of ``ranks``, all asks at once: bit by bit from the highest, a stable
    partition by the bit says how many of a range have it unset."""
    low, high, k, found = np.zeros(len(n), np.int64), n.astype(np.int64), k.astype(np.int64), np.zeros(len(n), np.int64)
    for b in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        unset = (ranks >> b) & 1 == 0
        upto = np.concatenate(([0], np.cumsum(unset)))
        at, to = upto[low], upto[high]
        more = k > to - at
        found |= more.astype(np.int64) << b
        k = np.where(more, k - (to - at), k)
        low, high = np.where(more, upto[-1] + low - at, at), np.where(more, upto[-1] + high - to, to)
        ranks = np.concatenate((ranks[unset], ranks[~unset]))
    return found


def _asked_rank(n: np.ndarray, q: float) -> np.ndarray:
    return np.maximum(1, np.ceil(q * n)).astype(np.int64)


def _sorted_by(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values, ties as they come, and each one's rank in it."""
    order = np.argsort(value, kind="stable")
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return order, ranks


def _whole(asked: Mapping[str, tuple[str, float]], out: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one scope: all asked quantiles."""
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.rename_columns([c.removeprefix("__r") for c in right.column_names]).sort_by("place")
        n, columns, sorts = np.asarray(left["__n"]), [], {}
        for c, q in asked.values():
            if c not in sorts:
                sorts[c] = _sorted_by(np.asarray(right[f"__v_{c}"]))
            order, ranks = sorts[c]
            at = kth_of_first(ranks, n, _asked_rank(n, q))
            columns.append(right[f"__v_{c}"].take(pa.array(order[at])).cast(pa.float64()))
        return pa.table([*[left[c] for c in out.names[: -len(columns)]], *columns], schema=out)

    return run


def _buckets(asked: Sequence[tuple[str, float]], out: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one block of places: in which bucket of values each asked rank lies, and its rank there."""
        if not left.num_rows:
            return out.empty_table()
        right = right.rename_columns([c.removeprefix("__r") for c in right.column_names])
        bucket, place, before = (np.asarray(right[c].fill_null(-1)) for c in ("bucket", "place", "before"))
        upto = np.zeros(int(bucket.max(initial=0)) + 1, np.int64)
        upto[bucket[place < 0]] = before[place < 0]
        held = np.lexsort((place, bucket))
        held = held[place[held] >= 0]
        cuts = np.searchsorted(bucket[held], np.arange(len(upto) + 1))
        asks = np.asarray(left["__n"])
        want = np.stack([_asked_rank(asks, q) for _, q in asked])
        total, found, ranks = np.zeros(len(asks), np.int64), np.full(want.shape, -1), np.zeros(want.shape, np.int64)
        for b, base in enumerate(upto.tolist()):
            more = total + base + np.searchsorted(place[held[cuts[b] : cuts[b + 1]]], asks)
            here = (found < 0) & (want <= more)
            found[here], ranks[here] = b, (want - total)[here]
            total = more
        rows = pa.array(np.tile(np.arange(len(asks)), len(asked)))
        kept = [left[c].take(rows) for c in out.names[:-3]]
        return pa.table([*kept, pa.array(np.repeat([name for name, _ in asked], len(asks))), pa.array(found.ravel()), pa.array(ranks.ravel())], schema=out)

    return run


def _within_buckets(value: str, out: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one bucket of values: the asked rank among those whose place comes before the ask's."""
        if not left.num_rows:
            return out.empty_table()
        right = right.rename_columns([c.removeprefix("__r") for c in right.column_names]).sort_by("place")
        order, ranks = _sorted_by(np.asarray(right[value]))
        at = kth_of_first(ranks, np.searchsorted(np.asarray(right["place"]), np.asarray(left["__n"])), np.asarray(left["__k"]))
        kept = [left[c] for c in out.names[:-1]]
        return pa.table([*kept, right[value].take(pa.array(order[at])).cast(pa.float64())], schema=out)

    return run


def asof_quantiles(decisions: DataFrame, outcomes: DataFrame, on: Sequence[str], at: str, done: str, tie: str, key: Sequence[str], **asked: tuple[str, float]) -> DataFrame:
    """For each decision the nearest-rank quantiles (name=(column, q)) of all outcomes completed strictly before it, and ``support``.

    ``key`` names a decision within ``on``; outcomes with a null in an asked column are left out. Exact at any length of a scope.
    """
    return asof_parts(decisions, outcomes, on, at, done, tie, key, {"support": asked})


def asof_parts(decisions: DataFrame, outcomes: DataFrame, on: Sequence[str], at: str, done: str, tie: str, key: Sequence[str], parts: Mapping[str, Mapping[str, tuple[str, float]]], counts: Mapping[str, Column] | None = None, last: str | None = None) -> DataFrame:
    """``asof_quantiles`` of several sets of outcomes by one sort: each of ``parts`` names its support and what is asked of the outcomes without a
    null in its columns. ``counts`` are numbers of other outcomes, ``last`` is when the last of all completed; those without a time never did.

    Decisions that see the same outcomes of a scope are one ask, so a scope has no more asks than outcomes. One of at most WIDTH outcomes is a group;
    of a longer one WIDTH places (the root of all, if that is more) make a block and as many values a bucket. A block knows how many values
    of each bucket came before it, so an ask finds its bucket there, and its value among the bucket's.
    """
    counts, spark = counts or {}, decisions.sparkSession
    needs = {name: sorted({c for c, _ in asked.values()}) for name, asked in parts.items()}
    columns = sorted({c for some in needs.values() for c in some})
    left = decisions.select(*on, F.col(at).alias("__time"), F.lit(0).alias("__kind"), F.lit(None).cast(outcomes.schema[tie].dataType).alias("__tie"), F.struct(*key).alias("__d"))
    right = outcomes.where(F.col(done).isNotNull()).select(*on, F.col(done).alias("__time"), F.lit(1).alias("__kind"), F.col(tie).alias("__tie"), *[F.col(c).alias(f"__v_{c}") for c in columns], *[F.coalesce(c, F.lit(False)).alias(f"__if_{n}") for n, c in counts.items()])
    one = lambda c: F.coalesce(((F.col("__kind") == 1) & c).cast("long"), F.lit(0).cast("long"))
    whole = {name: reduce(lambda a, b: a & b, [F.col(f"__v_{c}").isNotNull() for c in some]) for name, some in needs.items()}
    sums = {f"__n_{name}": one(c) for name, c in whole.items()} | {f"__n_{n}": one(F.col(f"__if_{n}")) for n in counts}
    highs = {"__last": F.when(F.col("__kind") == 1, F.col("__time"))} if last else {}
    told = {}
    with Scratch(spark) as first:
        both = running_sums(left.unionByName(right, allowMissingColumns=True), on, ["__time", "__kind", "__tie"], first.written, highs, **sums)
        both = written(both.select(*on, "__kind", "__d", *sums, *highs, *[f"__v_{c}" for c in columns]), "places")
    release_shuffles(spark)
    asks = both.where("__kind = 0").select(*on, "__d", *sums, *highs)
    for name, asked in parts.items():
        n = F.col(f"__n_{name}")
        outs = both.where("__kind = 1").where(whole[name]).select(*on, (n - 1).alias("place"), *[f"__v_{c}" for c in needs[name]])
        told[name] = _told(asks.where(n > 0).select(*on, n.alias("__n")).distinct(), outs, on, needs[name], asked)
        release_shuffles(spark)
    out = asks
    for name, found in told.items():
        found = found.select(*parts[name], F.col("__n").alias(f"__o___n_{name}"), *[F.col(k).alias(f"__o_{k}") for k in on])
        out = out.join(found, same_keys(out, found, (*on, f"__n_{name}"), "__o_"), "left").drop(*[f"__o_{k}" for k in (*on, f"__n_{name}")])
    return out.select(*on, "__d.*", *[F.col(c).alias(c.removeprefix("__n_")) for c in sums], *([F.col("__last").alias(last)] if last else []), *[a for asked in parts.values() for a in asked])


def _told(asks: DataFrame, outs: DataFrame, on: Sequence[str], columns: Sequence[str], asked: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``on``, ``__n`` and the asked quantiles of the first ``__n`` of a scope's ``outs``, for all distinct ``asks``."""
    sizes = outs.groupBy(*on).agg(F.count("*").alias("__all"))
    sizes = sizes.withColumn("__w", F.greatest(F.lit(WIDTH), F.ceil(F.sqrt("__all"))).cast("long"))
    with Scratch(asks.sparkSession) as s:
        sizes = s.written(sizes.select(F.struct(*on).alias("__s"), "__w", "__all", F.ceil(F.col("__all") / F.col("__w")).cast("long").alias("__blocks")), "sizes")
        sized = lambda df, sizes: df.join(sizes, F.struct(*[F.col(k) for k in on]).eqNullSafe(F.col("__s"))).drop("__s")
        short, long = sizes.where(F.col("__all") <= WIDTH), sizes.where(F.col("__all") > WIDTH)
        # scopes that are a group
        dealt = sized(asks, short).select(*on, "__n")
        values = sized(outs, short).select(*[F.col(k).alias(f"__r{k}") for k in (*on, "place", *[f"__v_{c}" for c in columns])])
        schema = dealt.select("*").schema
        for name in asked:
            schema = schema.add(name, "double")
        wide = dealt.groupBy(*on).cogroup(values.groupBy(*[f"__r{k}" for k in on])).applyInArrow(_whole(asked, to_arrow_schema(schema)), schema)
        if not long.isEmpty():
            wide = wide.unionByName(_longer(sized(asks, long), sized(outs, long), long, on, columns, asked, s.written))
        return written(wide, "told")


def _longer(asks: DataFrame, outs: DataFrame, sizes: DataFrame, on: Sequence[str], columns: Sequence[str], asked: Mapping[str, tuple[str, float]], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``_told`` of scopes of more than one block. However many asks end in a bucket, a task takes less than two blocks of them; each
    of these pieces gets the bucket's values."""
    spark = asks.sparkSession
    dealt = asks.withColumn("block", F.floor(F.col("__n") / F.col("__w"))).select(*on, "__n", "block")
    found = None
    for c in columns:
        mine = [(name, q) for name, (col, q) in asked.items() if col == c]
        with Scratch(spark) as first:
            cells = positions(outs.select(*on, "place", "__w", f"__v_{c}"), on, [f"__v_{c}", "place"], name="__rank", write=first.written)
            cells = write(cells.select(*on, "place", f"__v_{c}", F.floor(F.col("place") / F.col("__w")).alias("block"), F.floor(F.col("__rank") / F.col("__w")).alias("bucket")), "cells")
        release_shuffles(spark)
        grid = sizes.select("__s.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("bucket"), "__blocks").select(*on, "bucket", F.explode(F.sequence(F.lit(0).cast("long"), "__blocks")).alias("block"))
        held = cells.groupBy(*on, "bucket", "block").agg(F.count("*").alias("held")).select("held", *[F.col(k).alias(f"__o_{k}") for k in (*on, "bucket", "block")])
        grid = grid.join(held, same_keys(grid, held, (*on, "bucket", "block"), "__o_"), "left").select(*grid.columns, F.coalesce("held", F.lit(0)).alias("held"))
        before = F.coalesce(F.sum("held").over(Window.partitionBy(*on, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        known = grid.select(*on, "block", "bucket", F.lit(None).cast("long").alias("place"), before.alias("before")).unionByName(cells.select(*on, "block", "bucket", "place", F.lit(None).cast("long").alias("before")))
        known = known.select(*[F.col(k).alias(f"__r{k}") for k in known.columns])
        schema = dealt.select(*on, "block", "__n").schema.add("name", "string").add("bucket", "long").add("__k", "long")
        ranks = dealt.groupBy(*on, "block").cogroup(known.groupBy(*[f"__r{k}" for k in (*on, "block")])).applyInArrow(_buckets(mine, to_arrow_schema(schema)), schema)
        ranks = write(ranks, "ranks")
        upto = F.sum("n").over(Window.partitionBy(*on, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        pieces = ranks.groupBy(*on, "bucket", "block").agg(F.count("*").alias("n")).withColumn("piece", F.floor(F.coalesce(upto, F.lit(0)) / WIDTH))
        pieces = write(pieces.select("piece", *[F.col(k).alias(f"__o_{k}") for k in (*on, "bucket", "block")]), "pieces")
        cut = ranks.join(pieces, same_keys(ranks, pieces, (*on, "bucket", "block"), "__o_")).select(*ranks.columns, "piece")
        each = pieces.select(*[f"__o_{k}" for k in (*on, "bucket")], "piece").distinct()
        values = cells.join(each, same_keys(cells, each, (*on, "bucket"), "__o_")).select(*[F.col(k).alias(f"__r{k}") for k in (*on, "bucket", "piece", "place", f"__v_{c}")])
        schema = ranks.select(*on, "__n", "name").schema.add("value", "double")
        by = (*on, "bucket", "piece")
        got = write(cut.groupBy(*by).cogroup(values.groupBy(*[f"__r{k}" for k in by])).applyInArrow(_within_buckets(f"__v_{c}", to_arrow_schema(schema)), schema), "values")
        release_shuffles(spark)
        found = got if found is None else found.unionByName(got)
    return found.groupBy(*on, "__n").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in asked])


def stability(p50: Column, p95: Column) -> Column:
    """log p95 over log p50 of one plus the values, at least 0."""
    return F.greatest(F.log1p(p95) - F.log1p(p50), F.lit(0.0))


def confidence(support: Column, spread: Column, distance: Column | None = None, prior: float = 16.0) -> Column:
    """How far history is to be trusted: by its support, its spread and, if given, its median distance. No support: 0."""
    near = F.lit(1.0) if distance is None else F.exp(-F.greatest(F.coalesce(distance, F.lit(0.0)), F.lit(0.0)))
    return F.when(support > 0, support / (support + prior) / (1 + spread) * near).otherwise(0.0)


def last_attempt(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Upsert: the row of each key that comes first in ``order``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")

