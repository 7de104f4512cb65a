"""Conditional quantiles of a measure: a forest's leaves hold the quantiles of the training rows that reach them.

Around the forest: feature views that hold no label, predictions from outside a row's fold, tails by group, consumption as
a feature, requests for workflows never seen, gates that tell which tasks to watch, and replay in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch, partitions, remove, scratch_path, written
from .history import same_keys
from .quantiles import group_quantiles


#: Ranges of the target in which a leaf's rows are counted (at least LEAST_RANGES), and how many places are counted at once.
RANGES, LEAST_RANGES, AT_ONCE = 1024, 16, 1 << 22


def _cells(batch: pa.RecordBatch, leaves: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and tree the cell (leaf of the tree, range of the target) that the row falls into, and the target."""
    y = np.asarray(batch["__y"])
    leaf = np.asarray(batch["__leaf"].flatten()).reshape(len(y), -1)
    node = leaf + np.arange(leaf.shape[1]) * leaves
    return node * (len(edges) + 1) + np.searchsorted(edges, y, "right")[:, None], y


def _counted(cells: int, leaves: int, edges: np.ndarray):
    def run(batches):
        total, held, n = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            held.append(_cells(batch, leaves, edges)[0].ravel())
            n += len(held[-1])
            if n > AT_ONCE:
                total += np.bincount(np.concatenate(held), minlength=cells)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return run


def _within(wanted: np.ndarray, leaves: int, edges: np.ndarray):
    def run(batches):
        for batch in batches:
            cell, y = _cells(batch, leaves, edges)
            row, tree = np.nonzero(wanted[cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell[row, tree]), pa.array(y[row])], ["cell", "v"])

    return run


def _leaf_quantiles(reached: DataFrame, trees: int, leaves: int, quantiles: Sequence[float], groups: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``at`` (the nearest-rank quantiles of ``__y`` over the rows that reach the leaf) and ``rows``; ``__leaf`` holds each row's leaves.

    With ``groups``, leaves of group g lie ``g * trees * leaves`` further and trees are numbered on, group by group. Exact, in two passes: tasks count their rows by leaf and range of the target, which tells in which range an asked rank lies; only
    values of these ranges are shuffled. Places on the driver are bounded by trees, leaves and ranges, whatever the input.
    """
    nodes = groups * trees * leaves
    ranges = min(RANGES, max(LEAST_RANGES, AT_ONCE // nodes))
    edges = reached.agg(F.percentile_approx("__y", [i / ranges for i in range(1, ranges)], 10000)).first()[0]
    edges = np.unique(np.array(edges or [], np.float64))
    width = len(edges) + 1
    cells = nodes * width
    short = reached.select("__y", "__leaf")
    counts = short.mapInArrow(_counted(cells, leaves, edges), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    node = F.floor(F.col("cell") / width)
    own = Window.partitionBy("node")
    upto = counts.withColumn("node", node).withColumn("upto", F.sum("n").over(own.orderBy("cell"))).withColumn("rows", F.sum("n").over(own))
    ranks = F.array(*[F.greatest(F.ceil(F.col("rows") * F.lit(float(q))), F.lit(1)) for q in quantiles])
    asks = upto.select("cell", "node", "rows", "n", "upto", F.posexplode(ranks).alias("q", "rank")).where("rank <= upto and rank > upto - n")
    asks = written(asks.select("cell", "node", "rows", "q", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "asks")
    wanted = np.zeros(cells, bool)
    wanted[[r.cell for r in asks.select("cell").distinct().collect()]] = True  # at most one for each leaf and quantile
    values = short.mapInArrow(_within(wanted, leaves, edges), "cell long, v double").groupBy("cell", "v").agg(F.count("*").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy("cell").orderBy("v")))
    found = values.join(F.broadcast(asks), "cell").where("rank <= upto and rank > upto - n")
    at = F.transform(F.sort_array(F.collect_list(F.struct("q", "v"))), lambda x: x["v"])
    return found.groupBy("node", "rows").agg(at.alias("at")).select(F.floor(F.col("node") / leaves).cast("int").alias("tree"), F.col("node") % leaves, "at", "rows").toDF("tree", "leaf", "at", "rows")


@dataclass(frozen=True)
class Walk:
    """Trees as arrays of nodes, a row a tree: ``feature`` is at most ``threshold`` to the left; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    depth: int

    @staticmethod
    def of(model, spark) -> Walk:
        """Of an MLlib forest, whose leaves are numbered from left to right as its ``leafCol`` does."""
        path = scratch_path(spark, "forest")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # at most trees * 2**(depth + 1)
        remove(spark, path)
        shape = (model.getNumTrees, max(r.id for r in nodes) + 1)
        feature, leaf, threshold = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)
        left = np.tile(np.arange(shape[1], dtype=np.int32), (shape[0], 1))
        right, seen = left.copy(), [0] * shape[0]
        for r in nodes:  # a node before its children, the left ones first
            t, i = r.treeID, r.id
            if r.leftChild < 0:
                leaf[t, i] = seen[t]
                seen[t] += 1
                continue
            feature[t, i], ends = r.split.featureIndex, (r.leftChild, r.rightChild)
            values = list(r.split.leftCategoriesOrThreshold)
            if r.split.numCategories != -1:  # a feature that is 0 or 1
                threshold[t, i], ends = 0.5, ends if values == [0.0] else ends[::-1]
            else:
                threshold[t, i] = values[0]
            left[t, i], right[t, i] = ends
        return Walk(feature, threshold, left, right, leaf, max(t.depth for t in model.trees))

    @property
    def shape(self) -> tuple[int, int]:
        """Trees, and the most leaves that one has."""
        return len(self.leaf), int(self.leaf.max()) + 1

    def leaves(self, features: pa.Array) -> np.ndarray:
        """The leaf of each row (a list of features) in each tree."""
        x = np.asarray(features.flatten())
        start = np.arange(len(features)) * (len(x) // max(len(features), 1))
        out = np.empty((len(features), len(self.leaf)), np.int32)
        for t in range(len(self.leaf)):
            at = np.zeros(len(features), np.int32)
            for _ in range(self.depth):
                at = np.where(x[start + self.feature[t][at]] <= self.threshold[t][at], self.left[t][at], self.right[t][at])
            out[:, t] = self.leaf[t][at]
        return out


def _most_groups(trees: int, leaves: int) -> int:
    """How many groups' leaves are counted, and held by a task, beside each other."""
    return AT_ONCE // (LEAST_RANGES * trees * leaves)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows as lists, NaN as null."""
    flat = values.ravel()
    nothing = np.isnan(flat) if flat.dtype.kind == "f" else None
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(flat, mask=nothing))


@dataclass
class QuantileForest:
    """Quantiles of ``target`` given numeric and categorical columns, on a log scale.

    The table of leaves has at most ``trees * 2**depth`` rows, whatever the input; that bounds what tasks get of it. With ``by``
    (columns) a leaf also holds quantiles of each group that has at least ``least`` rows in it; elsewhere, and for groups
    never seen, those of all rows stand.
    """

    numeric: Sequence[str]
    categorical: Sequence[str]
    target: str
    quantiles: Sequence[float] = (0.5, 0.95, 0.99)
    trees: int = 12
    depth: int = 7
    seed: int = 1996
    by: Sequence[str] = ()
    least: int = 20
    model: PipelineModel | None = None
    leaves: DataFrame | None = None
    local: DataFrame | None = None
    modes: dict[str, str] = field(default_factory=dict)
    walk: Walk | None = None

    def _ready(self, rows: DataFrame) -> DataFrame:
        flags = {f"__no_{c}": F.col(c).isNull().cast("double") for c in self.numeric}
        return rows.withColumns(flags | {f"__x_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in self.numeric} | {f"__c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, "unknown"))) for c in self.categorical})

    def _features(self, stages: Sequence) -> Column:
        """What the fitted ``stages`` make of a row that is ready, as an array."""
        fill = stages[0].surrogateDF.first()
        x = [F.when(F.col(f"__x_{n}").isNull() | F.isnan(f"__x_{n}"), F.lit(fill[f"__x_{n}"])).otherwise(F.col(f"__x_{n}")) for n in self.numeric]
        x += [F.col(f"__no_{n}") for n in self.numeric]
        for n, labels in zip(self.categorical, stages[1].labelsArray if self.categorical else ()):
            x += [(F.col(f"__c_{n}") == v).cast("double") for v in labels] + [(~F.col(f"__c_{n}").isin(*labels)).cast("double")]
        return F.array(*x)

    def fit(self, rows: DataFrame, dealt: bool = False) -> "QuantileForest":
        """``dealt`` tells that ``rows`` are read from a table over all partitions."""
        x, c = [f"__x_{n}" for n in self.numeric], [f"__c_{n}" for n in self.categorical]
        stages = [Imputer(strategy="median", inputCols=x, outputCols=[f"{n}_f" for n in x])]
        if c:
            stages += [StringIndexer(inputCols=c, outputCols=[f"{n}_i" for n in c], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{n}_i" for n in c], outputCols=[f"{n}_v" for n in c], handleInvalid="keep")]
        stages += [VectorAssembler(inputCols=[f"{n}_f" for n in x] + [f"__no_{n}" for n in self.numeric] + [f"{n}_v" for n in c], outputCol="__features")]
        forest = RandomForestRegressor(featuresCol="__features", labelCol="__y", predictionCol="__mean", leafCol="__leaf", numTrees=self.trees, maxDepth=self.depth, seed=self.seed, maxBins=64)
        spark = rows.sparkSession
        with Scratch(spark) as scratch:
            # columns of the fit only: it reads them many times
            short = rows.select(*dict.fromkeys([*self.numeric, *self.categorical, *self.by, self.target]))
            short = short if dealt else scratch.written(short.repartition(partitions(spark)), "train")
            for n in self.categorical:  # a missing category is the most frequent one, ties to the first
                counts = short.where(F.col(n).isNotNull()).groupBy(F.col(n).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()
                self.modes[n] = counts.v if counts else "unknown"
            train = self._ready(short.where(F.col(self.target) >= 0)).withColumn("__y", F.log1p(F.col(self.target).cast("double")))
            ready = Pipeline(stages=stages).fit(train)
            # features once, by plain expressions: the forest reads them several times, and leaves are found in them
            made = scratch.written(train.select("__y", *self.by, self._features(ready.stages).alias("__f")), "features")
            names = ready.transform(train).schema["__features"].metadata
            grown = forest.fit(made.select("__y", array_to_vector("__f").alias("__features", metadata=names)))
            self.model, self.walk = PipelineModel([*ready.stages, grown]), Walk.of(grown, spark)
            walk, (trees, leaves) = self.walk, self.walk.shape

            @F.arrow_udf("array<int>")
            def reach(features: pa.Array) -> pa.Array:
                return _lists(walk.leaves(features))

            reached = scratch.written(made.select("__y", *self.by, reach("__f").alias("__leaf")), "reached")
            self.leaves = written(_leaf_quantiles(reached, trees, leaves, self.quantiles), "leaves")
            if self.by:
                self.local = written(self._by_group(reached, trees, leaves, scratch), "leaves")
        return self

    def _by_group(self, reached: DataFrame, trees: int, leaves: int, scratch: Scratch) -> DataFrame:
        """``by``, ``tree``, ``leaf``, ``at`` and ``rows`` of groups with at least ``least`` rows in a leaf."""
        most = _most_groups(trees, leaves)
        groups = reached.select(*self.by).distinct().limit(most + 1).collect()
        if len(groups) > most:
            # mergeable sketches: a leaf may hold a large share of a group's rows
            held = [F.percentile_approx("__y", [float(q) for q in self.quantiles], 10000).alias("at"), F.count("*").alias("rows")]
            each = reached.select("__y", *self.by, F.posexplode("__leaf").alias("tree", "leaf"))
            return each.groupBy(*self.by, "tree", "leaf").agg(*held).where(F.col("rows") >= self.least)
        # few groups: a group's trees are counted like further trees
        types = reached.select(*self.by).schema
        codes = scratch.written(reached.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], types.add("__code", "integer")).coalesce(1), "groups")
        known = codes.select("__code", *[F.col(c).alias("__o_" + c) for c in self.by])
        mine = reached.join(F.broadcast(known), same_keys(reached, known, self.by, "__o_"))
        mine = mine.select("__y", F.transform("__leaf", lambda v: v + F.col("__code") * trees * leaves).alias("__leaf"))
        found = _leaf_quantiles(mine, trees, leaves, self.quantiles, max(len(groups), 1)).where(F.col("rows") >= self.least)
        found = found.withColumn("__code", F.floor(F.col("tree") / trees).cast("int")).withColumn("tree", F.col("tree") % trees)
        return found.join(F.broadcast(codes), "__code").select(*self.by, "tree", "leaf", "at", "rows")

    @property
    def names(self) -> list[str]:
        return [f"q{q * 100:g}".replace(".", "_") for q in self.quantiles]

    def told(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with ``name``, an array of the medians over trees for all quantiles, on the log scale; found row by row."""
        known = self.leaves.select("tree", "leaf", "at").collect()  # at most trees * 2**depth
        walk = self._walked()
        trees, leaves = walk.shape
        at = np.full((1, trees, leaves, len(self.quantiles)), np.nan)
        for r in known:
            at[0, r.tree, r.leaf] = r.at
        ready, code = self._ready(rows), F.lit(0)
        if self.local is not None:
            own = self.local.collect()  # of the groups that ``_few`` lets through
            groups = {g: i + 1 for i, g in enumerate(dict.fromkeys(tuple(r[c] for c in self.by) for r in own))}
            at = np.repeat(at, len(groups) + 1, axis=0)
            for r in own:
                at[groups[tuple(r[c] for c in self.by)], r.tree, r.leaf] = r.at
            if groups:
                codes = rows.sparkSession.createDataFrame([(*g, i) for g, i in groups.items()], self.local.select(*[F.col(c).alias("__o_" + c) for c in self.by]).schema.add("__code", "integer"))
                ready = ready.join(F.broadcast(codes), reduce(lambda a, b: a & b, [ready[c] == codes[f"__o_{c}"] for c in self.by]), "left")  # a null is in no group
                code = F.coalesce("__code", F.lit(0))

        @F.arrow_udf("array<double>")
        def middle(features: pa.Array, code: pa.Array) -> pa.Array:
            got = at[np.asarray(code)[:, None], np.arange(trees), walk.leaves(features)]
            return _lists(np.nanmedian(got, axis=1) if np.isnan(got).any() else np.median(got, axis=1))

        return ready.select(*rows.columns, middle(self._features(self.model.stages), code).alias(name))

    def rising(self, name: str) -> list[Column]:
        """The quantiles that the array ``name`` holds, never falling."""
        plain = [F.expm1(F.col(name)[i]) for i in range(len(self.quantiles))]
        return [(F.greatest(*plain[: i + 1]) if i else plain[0]).alias(n) for i, n in enumerate(self.names)]

    def _few(self) -> bool:
        """Whether the leaves of groups are few enough for a task to hold them all."""
        if self.local is None:
            return True
        most = _most_groups(*self._walked().shape)
        return self.local.select(*self.by).distinct().limit(most + 1).count() <= most

    def _walked(self) -> Walk:
        self.walk = self.walk or Walk.of(self.model.stages[-1], self.leaves.sparkSession)
        return self.walk

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """``key`` and a column q<percent> for each quantile: the median over trees, never falling."""
        if self._few():
            return self.told(rows, "__told").select(key, *self.rising("__told"))
        reached = self.model.transform(self._ready(rows)).select(key, *self.by, F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"))
        own = self.local.select(*self.by, "tree", "leaf", F.col("at").alias("own"))
        found = reached.join(F.broadcast(self.leaves), ["tree", "leaf"], "left").join(own, [*self.by, "tree", "leaf"], "left").withColumn("at", F.coalesce("own", "at"))
        out = found.groupBy(key).agg(*[F.median(F.col("at")[i]).alias(f"__{i}") for i in range(len(self.quantiles))])
        return out.select(key, F.array(*[f"__{i}" for i in range(len(self.quantiles))]).alias("__told")).select(key, *self.rising("__told"))

    def added(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the prediction of the first quantile as ``name``; without a join if leaves of groups are few."""
        if self._few():
            return self.told(rows, "__told").withColumn(name, self.rising("__told")[0]).drop("__told")
        return rows.join(self.predict(rows, key).select(key, F.col(self.names[0]).alias(name)), key)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.leaves.sparkSession.createDataFrame(list(self.modes.items()), "c string, v string").coalesce(1).write.mode("overwrite").parquet(f"{path}/modes")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        if self.local is not None:
            self.local.write.mode("overwrite").parquet(f"{path}/local")

    def load(self, spark, path: str) -> "QuantileForest":
        self.model, self.leaves = PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/leaves")
        self.local = spark.read.parquet(f"{path}/local") if self.by else None
        self.modes = {r.c: r.v for r in spark.read.parquet(f"{path}/modes").collect()}  # one row a category column
        return self


@dataclass
class Ensemble:
    """Several models that differ in their seed: each quantile is the median over them, at least 0 and never falling."""

    make: Callable[[int], QuantileForest]
    seeds: Sequence[int] = (1996, 1997, 1998)
    members: list[QuantileForest] = field(default_factory=list)

    def fit(self, rows: DataFrame, dealt: bool = False) -> "Ensemble":
        """The members read the same table; ``dealt`` tells that ``rows`` are one over all partitions."""
        rows = rows if dealt else _dealt(rows)
        self.members = [self.make(s).fit(rows, dealt=True) for s in self.seeds]
        return self

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        names = self.members[0].names
        if any(m.local is not None for m in self.members):
            found = reduce(DataFrame.unionByName, [m.predict(rows, key) for m in self.members])
            middle = found.groupBy(key).agg(*[F.greatest(F.median(n), F.lit(0.0)).alias(n) for n in names])
        else:  # row by row, one member after the other
            for i, m in enumerate(self.members):
                rows = m.told(rows, f"__m{i}").withColumn(f"__m{i}", F.struct(*m.rising(f"__m{i}")))
            each = {n: F.sort_array(F.filter(F.array(*[F.col(f"__m{i}")[n] for i in range(len(self.members))]), lambda v: v.isNotNull())) for n in names}
            half = lambda c: (c[F.floor((F.size(c) - 1) / 2).cast("int")] + c[F.ceil((F.size(c) - 1) / 2).cast("int")]) / 2
            middle = rows.select(key, *[F.greatest(F.when(F.size(c) > 0, half(c)), F.lit(0.0)).alias(n) for n, c in each.items()])
        return middle.select(key, *[(F.greatest(*names[: i + 1]) if i else F.col(n)).alias(n) for i, n in enumerate(names)])

    def save(self, path: str) -> None:
        for s, m in zip(self.seeds, self.members):
            m.save(f"{path}/seed={s}")

    def load(self, spark, path: str) -> "Ensemble":
        self.members = [self.make(s).load(spark, f"{path}/seed={s}") for s in self.seeds]
        return self


@dataclass
class GroupQuantiles:
    """Quantiles of ``target`` by the columns ``by``, exact; groups with fewer than ``least`` rows, and those never seen, take all rows'."""

    by: Sequence[str]
    target: str
    quantiles: Sequence[float] = (0.5, 0.995)
    least: int = 20
    groups: DataFrame | None = None
    whole: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        return [f"q{q * 100:g}".replace(".", "_") for q in self.quantiles]

    def fit(self, rows: DataFrame, dealt: bool = False) -> "GroupQuantiles":
        """``dealt`` is what a forest is told; grouping needs no dealing."""
        asked = dict(zip(self.names, self.quantiles))
        self.groups = written(group_quantiles(rows, self.by, self.target, **asked).where(F.col("n") >= self.least), "groups")
        self.whole = written(group_quantiles(rows, [], self.target, **asked), "groups")
        return self

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """``key`` and a column q<percent> for each quantile; null if no row was fitted."""
        groups = self.groups.select(*self.names, *[F.col(c).alias("__o_" + c) for c in self.by])
        found = rows.select(key, *self.by)
        found = found.join(groups, same_keys(found, groups, self.by, "__o_"), "left")
        whole = self.whole.first()  # one row
        return found.select(key, *[F.coalesce(n, F.lit(whole[n] if whole else None).cast("double")).alias(n) for n in self.names])

    def save(self, path: str) -> None:
        self.groups.write.mode("overwrite").parquet(f"{path}/groups")
        self.whole.write.mode("overwrite").parquet(f"{path}/whole")

    def load(self, spark, path: str) -> "GroupQuantiles":
        self.groups, self.whole = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/whole")
        return self


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` as a table over all partitions, for several fits: what made them is done once."""
    return written(rows.repartition(partitions(rows.sparkSession)), "rows")


def feature_view(view: str, parts: Mapping[str, Sequence[str]], labels: Sequence[str]) -> list[str]:
    """Columns of a view such as ``A+P``: those of each of its ``parts``, in order. A label among them is an error."""
    unknown = [p for p in view.split("+") if p not in parts]
    if unknown:
        raise ValueError(f"unknown parts of a view: {', '.join(unknown)}")
    columns = [c for p in view.split("+") for c in parts[p]]
    leaked = sorted(set(columns) & set(labels))
    if leaked:
        raise ValueError(f"labels among the features: {', '.join(leaked)}")
    return columns


def out_of_fold(make: Callable[[], QuantileForest], rows: DataFrame, key: str, fold: Column, folds: int) -> DataFrame:
    """Predictions for all ``rows``, each from a fit on the other folds (0 to ``folds`` - 1)."""
    rows = _dealt(rows)
    parts = [make().fit(rows.where(fold != i), dealt=True).predict(rows.where(fold == i), key) for i in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def derived_memory(rows: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], consumed: str, peak: str, fold: Column, folds: int, **forest) -> DataFrame:
    """``key``, ``c_hat`` (consumption) and ``derived`` (c_hat times memory by consumption), from outside each row's fold.

    Both are learned from rows whose consumption is known and predicted for all.
    """
    rows = _dealt(rows)
    known = rows.where(F.col(consumed) > 0).withColumn("__ratio", F.col(peak) / F.col(consumed) * 1e6)
    make = lambda target: QuantileForest(numeric, categorical, target, (0.5,), **forest)
    parts = []
    for i in range(folds):
        train, test = known.where(fold != i), rows.where(fold == i)
        c, ratio = make(consumed).fit(train, dealt=True), make("__ratio").fit(train, dealt=True)
        parts.append(ratio.added(c.added(test, key, "c_hat"), key, "__m").select(key, "c_hat", (F.col("c_hat") * F.col("__m") / 1e6).alias("derived")))
    return reduce(DataFrame.unionByName, parts)


def cold_start(rows: DataFrame, key: str, workflow: str, make: Callable[[], QuantileForest], peak: str, multiplier: float = 1.0, folds: int = 50) -> DataFrame:
    """Requests for tasks of workflows that the model never saw: each workflow is left out in turn (beyond ``folds``, in groups).

    ``request`` is at least the geometric mean of the model's q99 and the others' 95th percentile. Without other
    workflows there is nothing to learn from, and no rows.
    """
    spark, names = rows.sparkSession, rows.select(workflow).distinct()
    order = names.select(workflow, F.abs(F.hash(workflow)).alias("h")).orderBy("h", workflow).limit(folds).collect() if names.limit(folds + 1).count() <= folds else None
    if order is None:
        place = F.pmod(F.xxhash64(workflow), F.lit(folds))
        rows, count = rows.withColumn("__fold", place), folds
    else:
        found = spark.createDataFrame([(r[0], i) for i, r in enumerate(order)], f"{workflow} string, __fold int")
        rows, count = rows.join(F.broadcast(found), workflow), len(order)  # at most ``folds`` rows
    parts, rows = [], _dealt(rows) if count > 1 else rows
    for i in range(count if count > 1 else 0):
        others = rows.where(F.col("__fold") != i)
        p95 = others.agg(F.percentile_approx(peak, 0.95, 10000)).first()[0]
        got = make().fit(others, dealt=True).predict(rows.where(F.col("__fold") == i), key)
        floor = F.sqrt(F.greatest(F.col("q99"), F.lit(1.0)) * F.lit(float(max(p95 or 1, 1))))
        parts.append(got.select(key, "q95", "q99", floor.alias("floor"), F.ceil(F.greatest(F.col("q95") * multiplier, floor, F.lit(1.0))).alias("request")))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], f"{key} long, q95 double, q99 double, floor double, request long")


def gate_scores(train: DataFrame, rows: DataFrame, key: str, numeric: Sequence[str], labels: Sequence[str], severity: str, seed: int = 1996) -> DataFrame:
    """``key``, p_<label> for each 0/1 label, and ``severity``, predicted for ``rows``.

    Labels are weighed so that both count alike; one that is always the same in ``train`` gives that constant. Null
    features count as 0.
    """
    filled = lambda df: df.fillna(0, list(numeric))
    ready = VectorAssembler(inputCols=list(numeric), outputCol="__f").transform
    have, out = ready(filled(train)), ready(filled(rows)).select(key, "__f")
    n = have.count()
    for label in labels:
        ones = have.where(F.col(label) == 1).count()
        if ones in (0, n):
            out = out.withColumn(f"p_{label}", F.lit(float(bool(ones))))
            continue
        weighed = have.withColumn("__w", F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones))))
        model = GBTClassifier(featuresCol="__f", labelCol=label, weightCol="__w", maxIter=20, maxDepth=4, seed=seed, predictionCol="__y")
        model = model.setProbabilityCol("__p").setRawPredictionCol("__r").fit(weighed)
        out = model.transform(out).withColumn(f"p_{label}", vector_to_array("__p")[1]).drop("__p", "__r", "__y")
    model = GBTRegressor(featuresCol="__f", labelCol=severity, lossType="absolute", maxIter=20, maxDepth=3, seed=seed, predictionCol="severity").fit(have)
    return model.transform(out).drop("__f")


def replay(tasks: DataFrame, key: str, batch: str, batches: int, labels: Sequence[str], make: Callable[[], QuantileForest], quantile: str = "q95") -> DataFrame:
    """Decisions over batches 1 to ``batches`` - 1, each by a fit on the batches before it; batch 0 is known from the start.

    A batch's decisions are made without ``labels`` and written before its outcomes are joined. Returns key, batch, request
    and the labels.
    """
    parts, tasks = [], _dealt(tasks)
    for i in range(1, batches):
        model = make().fit(tasks.where(F.col(batch) < i), dealt=True)
        blind = tasks.where(F.col(batch) == i).drop(*labels)
        parts.append(written(model.predict(blind, key).select(key, F.lit(i).alias(batch), F.ceil(quantile).alias("request")), "decisions"))
    return reduce(DataFrame.unionByName, parts).join(tasks.select(key, *labels), key)


def score_views(history: DataFrame, decisions: DataFrame, key: str, views: Mapping[str, Sequence[str]], categorical: Sequence[str], consumed: str, target: str, quantile: float = 0.95, **forest) -> DataFrame:
    """``key``, ``c_hat`` and a request for each view, side by side, for a batch of decisions; fitted on ``history`` alone.

    Consumption is learned from the first view's columns where it is known; a view may name its prediction, ``c_hat``, and
    learns from predictions for history rows too.
    """
    first = list(next(iter(views.values())))
    history = _dealt(history)
    model = QuantileForest(first, categorical, consumed, (0.5,), **forest).fit(history.where(F.col(consumed).isNotNull()), dealt=True)
    known, out = written(model.added(history, key, "c_hat"), "known"), model.added(decisions, key, "c_hat")
    for i, columns in enumerate(views.values()):
        out = QuantileForest(list(columns), categorical, target, (quantile,), **forest).fit(known, dealt=True).added(out, key, f"__v{i}")
    return out.select(key, "c_hat", *[F.ceil(F.greatest(f"__v{i}", F.lit(1.0))).alias(n) for i, n in enumerate(views)])
