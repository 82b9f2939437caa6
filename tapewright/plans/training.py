"""Two-stage models as Spark ML jobs: fit, score, tune, evaluate."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Linear, Trees, TwoStage, forest_of, linear_of
from ..operators.boost import Boosting, fit_boosted
from ..operators.curve import choose_threshold, pr_curve
from ..operators.labels import require_shocks, stage_targets
from ..operators.metrics import classification_report, two_stage_prf
from ..operators.score import class_weights, fit_scaler, gate, scale
from ..operators.split import indexed, require_split, three_way
from ..schema import FEATURES
from ..sources.files import gates_by_model
from ..sources.work import kept

KINDS = ("lr", "rf", "gbt")
#: Rounds of boosting and its shrinkage; a round is up to three jobs, so fewer and larger steps than a single process takes.
ROUNDS, STEP = 50, 0.1
#: Fixed values of the two stages' boosting: regularisation, least hessian of a child, early stop of stage 2.
BOOSTING = {
    1: Boosting(step=STEP, depth=3, child=8.0, gamma=0.5, rows=0.8, columns=0.8, l1=0.5, l2=2.0, most=1.0, seed=100),
    2: Boosting(step=STEP, depth=3, child=10.0, gamma=1.0, rows=0.8, columns=0.8, l1=0.5, l2=3.0, most=1.0, patience=80, seed=42),
}


def estimator(kind: str, stage: int, weight_sum: float):
    """Spark's classifier of a kind: lr (L2, C = 1) or rf (10 trees of depth 4)."""
    cols = {"featuresCol": "features", "labelCol": f"y{stage}", "weightCol": "weight"}
    if kind == "lr":
        return LogisticRegression(**cols, regParam=1.0 / weight_sum, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9)
    if kind == "rf":
        return RandomForestClassifier(**cols, numTrees=10, maxDepth=4, minInstancesPerNode=20, seed=51 + stage)
    raise ValueError(f"unknown model {kind}")


def fit_stage(train: DataFrame, kind: str, stage: int, rounds: int = ROUNDS, validation: DataFrame | None = None) -> PipelineModel | Trees:
    """Fits one stage on scaled rows with y1 and y2. Stage 2 sees shocks only.

    lr and rf weight the classes to count alike; gbt (boosted trees of depth 3, see ``operators.boost``) weights
    positives by their lack. With ``validation``, rows like ``train``, boosting of stage 2 stops early by the log loss
    on their shocks and keeps the best round, from the one fit.
    """
    target, rows = f"y{stage}", require_shocks(train) if stage == 2 else train
    w = class_weights(rows, target).first()
    if kind == "gbt":
        weighted = lambda df: df.withColumn("weight", F.when(F.col(target) == 1, w["scale_pos_weight"]).otherwise(1.0))
        held = weighted(validation.where("y != 0")) if stage == 2 and validation is not None else None
        return fit_boosted(weighted(rows), FEATURES, target, "weight", replace(BOOSTING[stage], rounds=rounds), held)
    balanced = F.when(F.col(target) == 1, w["weight_pos"]).otherwise(w["weight_neg"] or 1.0)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, estimator(kind, stage, float(w["n"]))]).fit(rows.withColumn("weight", balanced))


def probability(model: PipelineModel | Trees, df: DataFrame, name: str) -> DataFrame:
    """Adds the fitted stage's probability of class 1."""
    if isinstance(model, Trees):
        return df.withColumn(name, model.probability())
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def as_expression(model: PipelineModel | Trees, kind: str) -> Linear | Trees:
    """A fitted stage as column expressions."""
    return {"lr": lambda m: linear_of(m, FEATURES), "rf": lambda m: forest_of(m, FEATURES), "gbt": lambda m: m}[kind](model)


def fit_two_stage(train: DataFrame, kind: str, rounds: int = ROUNDS, validation: DataFrame | None = None) -> TwoStage:
    """Both stages and the scaler, fitted on split, labelled rows with features; for batches and streams alike.

    ``validation`` is for the early stop of ``fit_stage``.
    """
    scaler = kept(fit_scaler(train))
    fitted = kept(scale(stage_targets(train), scaler))
    held = None if validation is None else scale(stage_targets(validation), scaler)
    stages = [as_expression(fit_stage(fitted, kind, stage, rounds, held), kind) for stage in (1, 2)]
    return TwoStage(*stages, {r["feature"]: (r["mu"], r["sd"]) for r in scaler.collect()})  # a row for each feature


def two_stage(train: DataFrame, rows: DataFrame, kind: str, rounds: int = ROUNDS, validation: DataFrame | None = None) -> DataFrame:
    """``rows`` with p1 and p2 of models fitted on ``train``; both are split, labelled rows with features. Scaled by train."""
    return fit_two_stage(train, kind, rounds, validation).gated(rows, 0.0, 0.0, force=True).drop("yhat")


def tune(scored: DataFrame, policy: str = "f1", **options) -> DataFrame:
    """(model, stage, thr, ...) from rows (model, y, p1, p2): thresholds of all models and stages in one job."""
    first = scored.select("model", F.lit("s1").alias("stage"), F.col("p1").alias("p"), (F.col("y") != 0).cast("int").alias("t"))
    second = scored.where("y != 0").select("model", F.lit("s2").alias("stage"), F.col("p2").alias("p"), (F.col("y") == 2).cast("int").alias("t"))
    curve = pr_curve(first.unionByName(second), "p", "t", ["model", "stage"])
    return choose_threshold(curve, ["model", "stage"], policy, **options)


def evaluate(scored: DataFrame, tau: float, tau2: float, population: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """(precision, recall and F1 of both stages; the three-class report)."""
    report = classification_report(gate(scored, tau, tau2, force=True), [0, 1, 2])
    return two_stage_prf(scored, tau, tau2, population), report


def held_out_scores(labelled: DataFrame, gap: int, kinds: tuple[str, ...] = KINDS, rounds: int = ROUNDS) -> DataFrame:
    """(model, part, symbol, sec, y, p1, p2) of validation and test rows, from models fitted on the training rows.

    70, 15 and 15 percent of the rows in the order of time, with ``gap`` rows left out between parts; scaled by the
    training rows; boosting stops early by the validation rows. ``labelled`` has symbol, sec, y and the features.
    """
    placed = indexed(labelled.select("symbol", "sec", "y", *FEATURES), "sec", ["symbol"])
    rows = kept(three_way(placed, gap).select("symbol", "sec", "part", "y", *FEATURES))
    require_split(rows.where("part != 'test'"))
    train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
    out = None
    for kind in kinds:
        scored = two_stage(train, rows.where("part != 'train'"), kind, rounds, val)
        scored = scored.select(F.lit(kind).alias("model"), "part", "symbol", "sec", "y", "p1", "p2")
        out = scored if out is None else out.unionByName(scored)
    return kept(out)


def hold_out(labelled: DataFrame, gap: int, kinds: tuple[str, ...] = KINDS, rounds: int = ROUNDS, tau: float | None = None, tau2: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, thresholds, metrics) of the whole evaluation.

    thresholds has model, stage, thr, ... tuned on the validation rows. metrics has, per model, population (predicted
    or true shocks for stage 2) and stage, the counts, precision, recall and F1 on the test rows, with the gates that
    are given, or tuned, or the defaults.
    """
    scores = held_out_scores(labelled, gap, kinds, rounds)
    thresholds = kept(tune(scores.where("part = 'val'")))
    return scores, thresholds, held_out_metrics(scores, thresholds, tau, tau2)


def held_out_metrics(scores: DataFrame, thresholds: DataFrame, tau: float | None = None, tau2: float | None = None) -> DataFrame:
    """The metrics of ``hold_out`` from its scores and thresholds."""
    gates = gates_by_model(thresholds, tau, tau2)
    rows = scores.where("part = 'test'").join(gates, "model")
    parts = [two_stage_prf(rows, F.col("tau"), F.col("tau2"), p, ["model"]).withColumn("population", F.lit(p)) for p in ("predicted", "true")]
    return parts[0].unionByName(parts[1])
