"""Learned transforms and models as Spark ML pipelines; fitted state lives in their stages."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelrisk.operators.interactions import Interactions, InteractionsModel
from panelrisk.sources.scratch import scratch_path


def basis(x: Column, knots: list[float], degree: int = 3) -> Column:
    """B-spline basis values of x as an array, by Cox-de Boor on clamped knots; x outside is clamped to the bounds.

    knots are the distinct boundary and inner knots in order. The last interval is closed, so that the values add up to 1 everywhere.
    The value and the levels are bound one after the other inside lambdas, so that the value is clamped once a row and the
    expression grows with the number of bases, not with two to the degree.
    """
    t = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    last = max(k for k in range(len(t) - 1) if t[k] < t[k + 1])

    def values(u: Column) -> Column:
        level = F.array(*[((u >= t[k]) & ((u < t[k + 1]) | F.lit(k == last))).cast("double") if t[k] < t[k + 1] else F.lit(0.0) for k in range(len(t) - 1)])

        def raised(d: int):
            """From the bases of degree d - 1 to those of degree d."""

            def step(v: Column) -> Column:
                out = []
                for k in range(len(t) - 1 - d):
                    left = (u - t[k]) / (t[k + d] - t[k]) * v[k] if t[k + d] > t[k] else F.lit(0.0)
                    right = (t[k + d + 1] - u) / (t[k + d + 1] - t[k + 1]) * v[k + 1] if t[k + d + 1] > t[k + 1] else F.lit(0.0)
                    out.append(left + right)
                return F.array(*out)

            return step

        for d in range(1, degree + 1):
            level = F.transform(F.array(level), raised(d))[0]
        return level

    clamped = F.greatest(F.lit(t[0]), F.least(F.lit(t[-1]), x.cast("double")))
    return F.when(x.isNotNull(), F.transform(F.array(clamped), values)[0])


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], near: float = 2e-4) -> dict[str, list[float]]:
    """For each column its values at the shares, each the least one that at least that share of the values does not exceed; [] for a column without values.

    Two passes over df, for all columns at once: approximate quantiles on either side of a share bound its value, then values inside the bounds are counted
    one by one, and those between bounds together. Some 4 * near of the rows are inside; a column whose bounds miss a value is counted whole. Null and NaN are no values.
    """
    x = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    around = [min(1.0, max(0.0, q + d)) for q in shares for d in (-near, near)]
    row = df.agg(*[f for k, c in enumerate(columns) for f in (F.count(x[c]).alias(f"n{k}"), F.percentile_approx(x[c], around, 10_000).alias(f"b{k}"))]).first()
    n = {c: row[f"n{k}"] for k, c in enumerate(columns)}
    places = {c: [max(1, math.ceil(round(q * n[c], 6))) for q in shares] for c in columns}

    def counted(bounds: dict[str, list[tuple[float, float]] | None]) -> dict[str, dict[int, float]]:
        """Values by column and place; without those that lie outside the bounds (None: none are set)."""
        parts = []
        for c, own in bounds.items():
            inside, below = F.lit(True), F.lit(None).cast("double")
            if own is not None:
                inside = F.lit(False)
                for lo, hi in own:
                    inside = inside | x[c].between(lo, hi)
                below = F.greatest(below, *[F.when(x[c] > hi, hi) for _, hi in own])
            parts.append(F.struct(F.lit(c).alias("c"), F.when(inside, x[c]).otherwise(below).alias("v"), (~inside).cast("int").alias("between"), x[c].isNotNull().alias("has")))
        rows = df.select(F.explode(F.array(*parts)).alias("_q")).select("_q.*").where("has").groupBy("c", "v", "between").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy(F.col("v").asc_nulls_first(), "between"))
        wanted = F.create_map(*[y for c in bounds for y in (F.lit(c), F.array(*[F.lit(k) for k in sorted(set(places[c]))]))])
        hits = rows.withColumn("upto", upto).withColumn("k", F.explode(F.filter(wanted[F.col("c")], lambda k: (k <= F.col("upto")) & (k > F.col("upto") - F.col("n"))))).where("between = 0")
        found: dict[str, dict[int, float]] = {c: {} for c in bounds}
        for r in hits.select("c", "k", "v").collect():  # a row for each column and share
            found[r["c"]][r["k"]] = r["v"]
        return found

    filled = [c for c in columns if n[c]]
    if not filled:
        return {c: [] for c in columns}
    found = counted({c: list(zip(row[f"b{k}"][::2], row[f"b{k}"][1::2], strict=True)) for k, c in enumerate(columns) if n[c]})
    if missed := [c for c in filled if any(k not in found[c] for k in places[c])]:
        found |= counted(dict.fromkeys(missed))
    return {c: [found[c][k] for k in places[c]] if n[c] else [] for c in columns}


class MedianModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns with null and NaN replaced by a number, in the type of the column."""

    medians = Param(Params._dummy(), "medians", "median by column", TypeConverters.identity)

    def _transform(self, df: DataFrame) -> DataFrame:
        medians, types = self.getOrDefault(self.medians), {f.name: f.dataType for f in df.schema.fields}
        filled = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(float(medians[c]))).cast(types[c])
        return df.withColumns({out: filled(c) for c, out in zip(self.getInputCols(), self.getOutputCols(), strict=True)})


class Medians(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact medians of the training rows, the lower of two middle values; raises where a column has no value."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> MedianModel:
        found = exact_quantiles(df, self.getInputCols(), [0.5])
        if empty := [c for c, v in found.items() if not v]:
            raise ValueError(f"no training row has a value of {empty}")
        model = MedianModel()
        model._set(medians={c: v for c, (v,) in found.items()}, inputCols=self.getInputCols(), outputCols=self.getOutputCols())
        return model


def numbered(n: int) -> dict:
    """Metadata of a vector column with n numeric entries, as Spark ML's own stages write it: what reads the column need not look at a row for its size."""
    return {"ml_attr": {"attrs": {"numeric": [{"idx": k} for k in range(n)]}, "num_attrs": n}}


class SplineModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds <column>_basis, a vector, for every input column; a column without enough knots stays linear."""

    knots = Param(Params._dummy(), "knots", "knots by column", TypeConverters.identity)
    degree = Param(Params._dummy(), "degree", "degree", TypeConverters.toInt)
    reasons = Param(Params._dummy(), "reasons", "why a column stays linear, by column", TypeConverters.identity)

    def _transform(self, df: DataFrame) -> DataFrame:
        knots, degree = self.getOrDefault(self.knots), self.getOrDefault(self.degree)
        out = df.withColumns({f"{c}_basis": array_to_vector(basis(F.col(c), k, degree) if len(k) > 2 else F.array(F.col(c).cast("double"))) for c, k in knots.items()})
        for c, k in knots.items():
            out = out.withMetadata(f"{c}_basis", numbered(len(k) + degree - 1 if len(k) > 2 else 1))
        return out


class Splines(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Knots at exact quantiles of the training rows, all columns together."""

    numKnots = Param(Params._dummy(), "numKnots", "knots, bounds included", TypeConverters.toInt)
    degree = Param(Params._dummy(), "degree", "degree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, numKnots=6, degree=3):
        super().__init__()
        self._setDefault(numKnots=6, degree=3)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SplineModel:
        n = self.getOrDefault(self.numKnots)
        at = [k / (n - 1) for k in range(n)]
        quantiles = exact_quantiles(df, self.getInputCols(), at)
        model, knots, reasons = SplineModel(), {}, {}
        for c in self.getInputCols():
            found = sorted(set(quantiles[c]))
            if not found:
                reasons[c] = "no training row has a value"
            elif not all(map(math.isfinite, found)):
                found, reasons[c] = [], "quantiles are not finite"
            elif len(found) < 3:
                reasons[c] = "fewer than three different quantiles"
            knots[c] = found
        model._set(knots=knots, reasons=reasons, degree=self.getOrDefault(self.degree), inputCols=self.getInputCols())
        return model


class Prepared(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Null categories become Unknown; the same for training and scoring."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in self.getInputCols()})


class Scaled(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector or number times a constant; under a ridge without standardization this shrinks its coefficients."""

    scale = Param(Params._dummy(), "scale", "factor", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, scale=1.0):
        super().__init__()
        self._setDefault(scale=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        s, own, to = self.getOrDefault(self.scale), df.schema[self.getInputCol()], self.getOutputCol()
        if not isinstance(own.dataType, VectorUDT):
            return df.withColumn(to, F.col(own.name) * s)
        out = df.withColumn(to, array_to_vector(F.transform(vector_to_array(own.name), lambda v: v * s)))
        size = own.metadata.get("ml_attr", {}).get("num_attrs")
        return out.withMetadata(to, numbered(size)) if size else out


class Crossed(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """All products of the entries of two vectors or numbers, as one vector.

    Where both columns have attributes of all their entries, as columns of a pipeline do, zeros are not multiplied and the vector is sparse.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        fields = [df.schema[c] for c in self.getInputCols()]
        vectors = [isinstance(f.dataType, VectorUDT) for f in fields]
        if all(not v or f.metadata.get("ml_attr", {}).get("attrs") for f, v in zip(fields, vectors, strict=True)):
            return Interaction(inputCols=self.getInputCols(), outputCol=self.getOutputCol()).transform(df)
        a, b = (vector_to_array(f.name) if v else F.array(F.col(f.name).cast("double")) for f, v in zip(fields, vectors, strict=True))
        products = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))
        return df.withColumn(self.getOutputCol(), array_to_vector(products))


def _inputs(numeric: list[str], categories: list[str]) -> list:
    """Unknown categories, medians, indexes and indicators, unseen ones kept."""
    filled = Medians(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric])
    if not categories:
        return [filled]
    return [
        Prepared(inputCols=categories),
        filled,
        StringIndexer(inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep"),
    ]


def preprocessor(numeric: list[str], categories: list[str]) -> Pipeline:
    """Inputs of a model as one vector, features."""
    parts = [f"{c}_filled" for c in numeric] + [f"{c}_hot" for c in categories]
    return Pipeline(stages=[*_inputs(numeric, categories), VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error")])


def linear_pipeline(numeric: list[str], categories: list[str], label: str = "label", ridge: float = 0.01, tolerance: float = 1e-6, rounds: int = 100) -> Pipeline:
    """Logistic regression; without a ridge, a small tolerance gives the maximum of the likelihood to as many digits."""
    parts = [f"{c}_filled" for c in numeric] + [f"{c}_hot" for c in categories]
    return Pipeline(stages=[*_inputs(numeric, categories), VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"), LogisticRegression(labelCol=label, regParam=ridge, tol=tolerance, maxIter=rounds)])


def checkpointed(spark) -> None:
    """Trees cut their lineage every `every` rounds below spark.checkpoint.dir, so that hundreds of them do not carry one; a folder that is set stays."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "trees"))


def forest_pipeline(numeric: list[str], categories: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 1, every: int = 10) -> Pipeline:
    """A random forest; node ids are kept by row and checkpointed every `every` rounds (see checkpointed)."""
    parts = [f"{c}_filled" for c in numeric] + [f"{c}_hot" for c in categories]
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=every)
    return Pipeline(stages=[*_inputs(numeric, categories), VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"), forest])


def boosted_pipeline(numeric: list[str], categories: list[str], label: str = "label", validation: str | None = None, rounds: int = 10, depth: int = 4, step: float = 0.1, tolerance: float = 0.01, seed: int = 1, every: int = 10) -> Pipeline:
    """Boosted trees; with a boolean validation column, they stop when those rows gain less than the tolerance. Checkpointed every `every` rounds."""
    parts = [f"{c}_filled" for c in numeric] + [f"{c}_hot" for c in categories]
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, validationTol=tolerance, seed=seed, cacheNodeIds=True, checkpointInterval=every, **({"validationIndicatorCol": validation} if validation else {}))
    return Pipeline(stages=[*_inputs(numeric, categories), VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"), trees])


def gam_pipeline(numeric: list[str], categories: list[str], pairs: list[tuple[str, str]] = (), group: str | None = None, group_scale: float = 0.5, label: str = "label", ridge: float = 0.01, weight: str | None = None, linear: list[str] = ()) -> Pipeline:
    """Splines of numeric columns but those of `linear`, products of pairs (numeric or category), and for a group its own intercepts and splines.

    Numeric factors of products, bases or linear, are centred on their training means; a product of two categories is refused.
    Group columns are scaled and the fit does not standardize, so that a smaller group_scale shrinks group effects.
    """
    curved = [c for c in numeric if c not in linear]
    stages = [*_inputs(numeric, categories), *([Splines(inputCols=[f"{c}_filled" for c in curved])] if curved else [])]
    name = lambda c: f"{c}_filled_basis" if c in curved else f"{c}_filled" if c in numeric else f"{c}_hot"
    parts = [name(c) for c in [*numeric, *categories] if c != group]
    for a, b in pairs:
        if a in categories and b in categories:
            raise ValueError(f"{a} x {b}: two categories are not crossed")
    if pairs:
        crossed = [f"{a}_x_{b}" for a, b in pairs]
        stages.append(Interactions(pairs=[[name(a), name(b)] for a, b in pairs], outputCols=crossed, plain=[name(c) for c in categories]))
        parts += crossed
    if group:
        stages.append(Scaled(inputCol=f"{group}_hot", outputCol=f"{group}_own", scale=group_scale))
        parts.append(f"{group}_own")
        for c in numeric:
            # scaled before it is crossed: few entries are scaled, and the indicators of the product stay sparse
            stages += [Scaled(inputCol=name(c), outputCol=f"{c}_scaled", scale=group_scale), Crossed(inputCols=[f"{c}_scaled", f"{group}_hot"], outputCol=f"{c}_by_{group}_own")]
            parts.append(f"{c}_by_{group}_own")
    fit = LogisticRegression(labelCol=label, regParam=ridge, standardization=False, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"), fit])


def class_weights(df: DataFrame, label: str, positive: float, negative: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(negative))


def train(pipeline: Pipeline, df: DataFrame, label: str = "label") -> PipelineModel:
    """Fit after one check: rows, no null label, two classes."""
    n, nulls, classes = df.agg(F.count(F.lit(1)), F.count_if(F.col(label).isNull()), F.count_distinct(label)).first()
    if not n or nulls or classes < 2:
        raise ValueError(f"cannot train on {n} rows with {nulls} null labels and {classes} classes")
    checkpointed(df.sparkSession)
    return pipeline.fit(df)


def horizon_name(months: int) -> str:
    """The name of a probability of default within so many months."""
    return f"pd_{months}m"


def score(model: PipelineModel, df: DataFrame, name: str = "pd") -> DataFrame:
    """df with the probability of label 1 (see horizon_name); all other columns stay in their rows."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def permuted(df: DataFrame, key: list[str], column: str, seed: int = 1) -> DataFrame:
    """df with a column's values dealt out anew: each row takes the value of the row after it in hash order, inside blocks of hashes.

    Nulls are dealt like other values. There are 16 blocks for each shuffle partition, so that blocks grow in number with the cluster.
    """
    return all_permuted(df, key, [column], 1, seed).select(*df.columns)


def all_permuted(df: DataFrame, key: list[str], columns: list[str], repeats: int, seed: int = 1) -> DataFrame:
    """For each of columns (_column, its place) and repeat (_draw), the rows of df with that column dealt as `permuted` deals it with seed + _draw.

    df is read once, and all are dealt by one window.
    """
    blocks = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.array(*[F.struct(F.lit(k).alias("_column"), F.lit(d).alias("_draw")) for k in range(len(columns)) for d in range(repeats)])
    value = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select("*", F.explode(pairs).alias("_pair")).select(*map(value, df.columns), "_pair._column", "_pair._draw")
    h = F.xxhash64(*key, F.lit(seed) + F.col("_draw"))
    w = Window.partitionBy("_column", "_draw", F.pmod(h, F.lit(blocks))).orderBy(h, *key)
    own = F.struct(*[value(c).alias(f"c{k}") for k, c in enumerate(columns)])  # never null itself, so that a null value is not taken for the end of a block
    dealt = rows.withColumn("_dealt", F.coalesce(F.lead(own).over(w), F.first(own).over(w)))
    return dealt.withColumns({c: F.when(F.col("_column") == k, F.col(f"_dealt.c{k}")).otherwise(value(c)) for k, c in enumerate(columns)}).drop("_dealt")


def origins(model: PipelineModel) -> dict[str, str]:
    """For each column that a stage of the pipeline makes, the input columns that it comes from, joined by x for products."""
    of: dict[str, str] = {}
    own = lambda c: of.get(c, c)
    for s in model.stages:
        if isinstance(s, SplineModel):
            of |= {f"{c}_basis": own(c) for c in s.getInputCols()}
        elif isinstance(s, InteractionsModel):
            of |= {name: " x ".join(map(own, pair)) for pair, name in zip(s.getOrDefault(s.pairs), s.getOutputCols(), strict=True)}
        elif isinstance(s, Crossed):
            of[s.getOutputCol()] = " x ".join(map(own, s.getInputCols()))
        elif isinstance(s, Scaled):
            of[s.getOutputCol()] = own(s.getInputCol())
        elif s.hasParam("outputCols") and s.hasParam("inputCols") and not isinstance(s, VectorAssembler):
            if s.isSet("outputCols"):
                of |= {b: own(a) for a, b in zip(s.getInputCols(), s.getOutputCols(), strict=True)}
    return of


def raw_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """For each entry of the assembled features, the column of df that it comes from; of products, both, joined by x.

    Names come from the stages' own columns, and sizes from one row of nulls that passes through the pipeline.
    """
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    before = PipelineModel(model.stages[: model.stages.index(assembler)])
    row = before.transform(df.sparkSession.createDataFrame([tuple(None for _ in df.columns)], StructType([StructField(f.name, f.dataType) for f in df.schema.fields])))
    vectors = {f.name for f in row.schema.fields if f.dataType.typeName() == "vectorudt" or f.dataType.simpleString() == "vector"}
    sizes = row.select(*[(F.size(vector_to_array(c)) if c in vectors else F.lit(1)).alias(f"n{k}") for k, c in enumerate(assembler.getInputCols())]).first()
    of = origins(model)
    return [of.get(c, c) for c, n in zip(assembler.getInputCols(), sizes, strict=True) for _ in range(n)]


def feature_group(feature: Column) -> Column:
    """Business group of a raw feature by its name: what the loan began with, how it has paid, or how it stands."""
    paid = feature.rlike("dpd|delinquen|streak|relapse|modif|deferr|assistance|disaster|step")
    began = feature.rlike("^original|^credit_score|^occupancy|^property|^number_of|^mi_|^channel|^loan_purpose|^first_time|_missing$")
    return F.when(paid, "delinquency").when(began, "origination").otherwise("current state")


def _by_feature(df: DataFrame, names: list[str], values: list[float], total: str) -> DataFrame:
    rows = df.sparkSession.createDataFrame(list(zip(names, map(float, values), strict=True)), "feature string, v double")  # one row for each entry of the model
    sums = rows.groupBy("feature").agg(F.sum("v").alias(total))
    whole, down = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(F.col(total).desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    all_ = F.nullif(F.sum(total).over(whole), F.lit(0.0))
    return sums.select("feature", feature_group(F.col("feature")).alias("feature_group"), total, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col(total).desc(), "feature")).alias("position"), (F.col(total) / all_).alias("share"), (F.sum(total).over(down) / all_).alias("cum_share"))


def tree_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """feature, feature_group, importance, position, share, cum_share of a tree model, folded back to the columns of df."""
    return _by_feature(df, raw_names(model, df), model.stages[-1].featureImportances.toArray().tolist(), "importance")


def contribution_rows(x: Column, df: DataFrame, key: list[str], names: list[str], weights: list[float]) -> DataFrame:
    """key, feature, contribution: weight * (entry - mean entry) of the array x, entries of one feature added up; a row for each key and feature.

    names: the feature of each entry. The means are those of df, which is read for them and again for the rows; nothing is shuffled but the means.
    """
    from pyspark.ml.stat import Summarizer

    m = df.select(Summarizer.mean(array_to_vector(x)).alias("m")).first()["m"]
    means = F.array(*[F.lit(float(v)) for v in (m if m is not None else [0.0] * len(names))])
    parts = F.transform(F.arrays_zip(x.alias("x"), means.alias("m"), F.array(*[F.lit(float(w)) for w in weights]).alias("w")), lambda t: (t["x"] - t["m"]) * t["w"])
    places = {f: [k for k, n in enumerate(names) if n == f] for f in dict.fromkeys(names)}
    own = df.select(*key, parts.alias("_c"))
    add = lambda at: F.aggregate(F.transform(F.array(*map(F.lit, at)), lambda k: F.get("_c", k)), F.lit(0.0), lambda a, v: a + v)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), add(at).alias("contribution")) for f, at in places.items()]))
    return own.select(*key, each.alias("_e")).select(*key, "_e.feature", "_e.contribution")


def model_contributions(model: PipelineModel, df: DataFrame, key: list[str]) -> DataFrame:
    """contribution_rows of a fitted linear pipeline, by the columns of df that its entries come from."""
    rows = model.transform(df)
    return contribution_rows(vector_to_array("features"), rows, key, raw_names(model, df), model.stages[-1].coefficients.toArray().tolist())


def contribution_summary(rows: DataFrame) -> DataFrame:
    """feature, feature_group, mean_abs, mean (signed), position, share, cum_share of contribution rows."""
    sums = rows.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
    whole = Window.partitionBy(F.lit(1))  # one row a feature
    order = whole.orderBy(F.col("mean_abs").desc(), "feature")
    all_ = F.nullif(F.sum("mean_abs").over(whole), F.lit(0.0))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("feature", feature_group(F.col("feature")).alias("feature_group"), "mean_abs", "mean", F.row_number().over(order).alias("position"), (F.col("mean_abs") / all_).alias("share"), (F.sum("mean_abs").over(down) / all_).alias("cum_share"))


def contributions(model: PipelineModel, df: DataFrame) -> DataFrame:
    """contribution_summary of the exact linear contributions coefficient * (x - mean x), by the columns of df."""
    return contribution_summary(model_contributions(model, df, []))


def permutation_importance(model: PipelineModel, df: DataFrame, key: list[str], columns: list[str], repeats: int = 5, seed: int = 1) -> DataFrame:
    """feature, mean and standard deviation over repeats of what ROC-AUC and average precision lose when a column is dealt anew.

    All columns and repeats are dealt, scored and measured in one job; df (with label) is read once for them and once for what is lost.
    """
    from panelrisk.operators.metrics import rank_metrics

    base = rank_metrics(score(model, df)).select(F.col("roc_auc").alias("_auc"), F.col("average_precision").alias("_ap"))
    draws = all_permuted(df, key, columns, repeats, seed)
    own = rank_metrics(score(model, draws), "_column", "_draw").crossJoin(F.broadcast(base))
    auc, ap = F.col("_auc") - F.col("roc_auc"), F.col("_ap") - F.col("average_precision")
    lost = own.groupBy("_column").agg(F.avg(auc).alias("auc_loss"), F.stddev(auc).alias("auc_loss_std"), F.avg(ap).alias("ap_loss"), F.stddev(ap).alias("ap_loss_std"))
    names = F.array(*map(F.lit, columns))
    return lost.select(F.get(names, F.col("_column")).alias("feature"), "auc_loss", "auc_loss_std", "ap_loss", "ap_loss_std")


def ablation(build, numeric: list[str], categories: list[str], groups: dict[str, list[str]], fit: DataFrame, test: DataFrame) -> DataFrame:
    """left_out, roc_auc, average_precision, auc_change: the model without each group of columns, fitted anew, against the full one.

    build: from numeric and category columns to a pipeline. fit and test are read once for each group.
    """
    from panelrisk.operators.metrics import rank_metrics

    out = None
    for name, gone in {"nothing": [], **groups}.items():
        model = train(build([c for c in numeric if c not in gone], [c for c in categories if c not in gone]), fit)
        row = rank_metrics(score(model, test)).select(F.lit(name).alias("left_out"), "roc_auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    full = out.where("left_out = 'nothing'").select(F.col("roc_auc").alias("_full"))
    return out.crossJoin(F.broadcast(full)).select("left_out", "roc_auc", "average_precision", (F.col("roc_auc") - F.col("_full")).alias("auc_change"))


def check_features(df: DataFrame, numeric: list[str], categories: list[str]) -> None:
    """Raise once with all that keeps columns from being inputs of splines: repeated, absent, engineered names, wrong types."""
    types, names = dict(df.dtypes), [*numeric, *categories]
    number = ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
    bad = [f"{c} is given twice" for c in sorted({c for c in names if names.count(c) > 1})]
    bad += [f"{c} is not in the table" for c in names if c not in types]
    bad += [f"{c} is {types[c]}, not a number" for c in numeric if c in types and not types[c].startswith(number)]
    bad += [f"{c} has the name of a derived column" for c in names if c.endswith(("_filled", "_index", "_hot", "_basis", "_scaled", "_own"))]
    if bad:
        raise ValueError("; ".join(bad))


def input_contract(model: PipelineModel) -> dict[str, list[str]]:
    """The columns that a fitted pipeline reads, and those that its features are assembled from, as they were frozen by the fit."""
    filled = [c for s in model.stages if isinstance(s, MedianModel) for c in s.getInputCols()]
    categories = [c for s in model.stages if isinstance(s, Prepared) for c in s.getInputCols()]
    assembled = [c for s in model.stages if isinstance(s, VectorAssembler) for c in s.getInputCols()]
    return {"numeric": filled, "categories": categories, "assembled": assembled}


def save_model(model: PipelineModel, path: str) -> None:
    """The fitted pipeline, and beside it its input contract as one JSON row."""
    model.write().overwrite().save(f"{path}/model")
    kind = "numeric array<string>, categories array<string>, assembled array<string>"
    contract = input_contract(model)
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(contract["numeric"], contract["categories"], contract["assembled"])], kind).coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def load_model(path: str, df: DataFrame) -> tuple[PipelineModel, list[str]]:
    """A saved pipeline and its input columns; raises if df lacks one of them."""
    row = df.sparkSession.read.json(f"{path}/contract").first()
    columns = [*row["numeric"], *row["categories"]]
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {gone}")
    return PipelineModel.load(f"{path}/model"), columns
