"""Interaction terms whose numeric factors are centred on training means; the means are kept by the fit."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(df: DataFrame, c: str) -> Column:
    """A number or a vector as an array."""
    return vector_to_array(c) if isinstance(df.schema[c].dataType, VectorUDT) else F.array(F.col(c).cast("double"))


class InteractionsModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a vector for each pair: all products of the entries of its factors, those of `means` less their training means."""

    pairs = Param(Params._dummy(), "pairs", "factors of each output", TypeConverters.identity)
    means = Param(Params._dummy(), "means", "training means by factor; a factor without means is not centred", TypeConverters.identity)

    def _transform(self, df: DataFrame) -> DataFrame:
        means, out = self.getOrDefault(self.means), {}

        def factor(c: str) -> Column:
            v = _values(df, c)
            return F.zip_with(v, F.array(*map(F.lit, means[c])), lambda x, m: x - m) if c in means else v

        for (left, right), name in zip(self.getOrDefault(self.pairs), self.getOutputCols(), strict=True):
            b = factor(right)
            out[name] = array_to_vector(F.flatten(F.transform(factor(left), lambda x: F.transform(b, lambda y: x * y))))  # noqa: B023
        return df.withColumns(out)


class Interactions(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """pairs: factors (numbers or vectors) of each output column; plain: factors that stay as they are, such as indicators of categories.

    The means of all other factors are taken over the training rows in one aggregate.
    """

    pairs = Param(Params._dummy(), "pairs", "factors of each output", TypeConverters.identity)
    plain = Param(Params._dummy(), "plain", "factors that are not centred", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, pairs=None, outputCols=None, plain=None):
        super().__init__()
        self._setDefault(pairs=[], plain=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> InteractionsModel:
        pairs, plain = self.getOrDefault(self.pairs), self.getOrDefault(self.plain)
        factors = list(dict.fromkeys(c for p in pairs for c in p))
        centred = [c for c in factors if c not in plain]
        model = InteractionsModel()
        means: dict[str, list[float]] = {}
        if centred:
            row = df.select(*[Summarizer.mean(array_to_vector(_values(df, c))).alias(f"m{k}") for k, c in enumerate(centred)]).first()
            means = {c: [float(x) for x in row[f"m{k}"]] for k, c in enumerate(centred)}
        model._set(pairs=[list(p) for p in pairs], means=means, inputCols=factors, outputCols=self.getOutputCols())
        return model
