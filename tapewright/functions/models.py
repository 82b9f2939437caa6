"""Fitted models as column expressions, for batch and streams: the JVM evaluates them, the second stage only behind the gate."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = "array<struct<f:array<int>,t:array<double>,m:array<boolean>,v:array<double>>>"


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


@dataclass(frozen=True)
class Linear:
    """Logistic regression."""

    columns: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self, columns: dict[str, Column] | None = None) -> Column:
        """The probability of class 1; ``columns`` gives expressions in place of columns of that name."""
        z = F.lit(self.intercept)
        for c, b in zip(self.columns, self.coefficients):
            z = z + (columns or {}).get(c, F.col(c)) * b
        return _sigmoid(z)


@dataclass(frozen=True)
class Trees:
    """Full binary trees: per tree columns (f), limits (t), where missing values go (m) and leaf values (v).

    A row goes left where its value is at most the limit, or is null or NaN and m is true; nodes without a column have
    f = -1 and send all rows left. ``link`` says what the values are: log_odds are summed, shares are averaged.
    """

    columns: tuple[str, ...]
    depth: int
    trees: tuple[dict, ...]
    link: str

    def probability(self, columns: dict[str, Column] | None = None) -> Column:
        """The probability of class 1; the trees are one constant, so the expression doesn't grow with them."""
        x = F.array(*[(columns or {}).get(c, F.col(c)).cast("double") for c in self.columns])

        def step(tree: Column, node: Column) -> Column:
            value = F.get(x, F.get(tree["f"], node))
            left = F.when(value.isNull() | F.isnan(value), F.get(tree["m"], node)).otherwise(value <= F.get(tree["t"], node))
            return 2 * node + F.when(left, 1).otherwise(2)

        def leaf(tree: Column) -> Column:
            levels = F.array(*[F.lit(0)] * self.depth)
            node = F.aggregate(levels, F.lit(0), lambda n, _: step(tree, n)) if self.depth else F.lit(0)
            return F.get(tree["v"], node - ((1 << self.depth) - 1))

        total = F.aggregate(F.from_json(F.lit(json.dumps(self.trees)), TREES), F.lit(0.0), lambda s, t: s + leaf(t))
        return _sigmoid(total) if self.link == "log_odds" else total / F.lit(float(max(1, len(self.trees))))


def linear_of(model: PipelineModel, columns: list[str]) -> Linear:
    """The logistic regression at the end of a pipeline."""
    last = model.stages[-1]
    return Linear(tuple(columns), tuple(float(x) for x in last.coefficients), float(last.intercept))


def forest_of(model: PipelineModel, columns: list[str]) -> Trees:
    """The random forest at the end of a pipeline; a leaf's value is its share of class 1."""
    last = model.stages[-1]
    depth = max(t.depth for t in last.trees)

    def filled(tree) -> dict:
        out = {"f": [-1] * ((1 << depth) - 1), "t": [0.0] * ((1 << depth) - 1), "m": [True] * ((1 << depth) - 1), "v": [0.0] * (1 << depth)}

        def put(node, at: int, level: int) -> None:
            if node.getClass().getSimpleName() == "LeafNode":
                stats = list(node.impurityStats().stats())
                out["v"][(at + 1) * (1 << (depth - level)) - (1 << depth)] = stats[1] / sum(stats)
                return
            out["f"][at], out["t"][at], out["m"][at] = node.split().featureIndex(), node.split().threshold(), False
            put(node.leftChild(), 2 * at + 1, level + 1)
            put(node.rightChild(), 2 * at + 2, level + 1)

        put(tree._java_obj.rootNode(), 0, 0)
        return out

    return Trees(tuple(columns), depth, tuple(filled(t) for t in last.trees), "shares")


@dataclass(frozen=True)
class TwoStage:
    """Both stages' models and the scaler's (mu, sd) by column; columns without one are taken as they are."""

    first: Linear | Trees
    second: Linear | Trees
    scaler: dict[str, tuple[float, float]]

    def scaled(self) -> dict[str, Column]:
        return {c: (F.col(c) - F.lit(mu)) / F.lit(sd) for c, (mu, sd) in self.scaler.items()}

    def gated(self, df: DataFrame, tau: float, tau2: float, force: bool = False) -> DataFrame:
        """Adds p1, p2 and yhat; the second model is evaluated only for rows whose p1 reaches ``tau``, unless forced.

        A null p1 doesn't pass. ``df`` may be a stream.
        """
        x = self.scaled()
        out = df.withColumn("p1", self.first.probability(x))
        passes = F.coalesce(F.col("p1") >= tau, F.lit(False))
        second = self.second.probability(x)
        out = out.withColumn("p2", second if force else F.when(passes, second))
        return out.withColumn("yhat", F.when(~passes, 0).when(F.col("p2") >= tau2, 2).otherwise(1))

    def to_json(self) -> str:
        return json.dumps({"first": _plain(self.first), "second": _plain(self.second), "scaler": self.scaler})

    @classmethod
    def from_json(cls, text: str) -> TwoStage:
        doc = json.loads(text)
        return cls(_model(doc["first"]), _model(doc["second"]), {c: tuple(x) for c, x in doc["scaler"].items()})

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TwoStage:
        return cls.from_json(spark.read.text(path, wholetext=True).first()["value"])


def _plain(model: Linear | Trees) -> dict:
    return {"kind": type(model).__name__, **model.__dict__}


def _model(doc: dict) -> Linear | Trees:
    fields = {k: tuple(v) if isinstance(v, list) else v for k, v in doc.items() if k != "kind"}
    return {"Linear": Linear, "Trees": Trees}[doc["kind"]](**fields)
