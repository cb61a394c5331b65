"""Probes: small supervised models on given vectors, trained by Spark itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators import stats
from chainloom.storage import settle


def probe(rows: DataFrame, key: str, vector: str, label: str, held_out: Column, hidden: list[int] | None = None, rounds: int = 50, penalty: float = 1e-3, seed: int = 0) -> DataFrame:
    """(key, label, held_out, predicted) of all rows, trained on those not held out, by a linear probe, or by a network where ``hidden`` names the sizes of
    its layers. Labels may be any integers; those that training never sees are never predicted. Rows without a vector
    or label are left out."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    whole = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("bigint").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), held_out.alias("held"))
    train = whole.filter(~F.col("held"))
    names = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    if not names:
        raise ValueError("no labelled rows to train on")
    at = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    train = train.withColumn("y", at.cast("double"))
    if hidden is None:
        model = LogisticRegression(labelCol="y", maxIter=rounds, regParam=penalty, family="multinomial").fit(train)
    else:
        width = len(train.first()["features"])
        model = MultilayerPerceptronClassifier(labelCol="y", layers=[width, *hidden, max(2, len(names))], maxIter=rounds, seed=seed).fit(train)
    found = model.transform(whole)
    return found.select(key, "label", F.col("held").alias("held_out"), F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")).alias("predicted"))


#: Metrics that training may watch, of rows (label, predicted, y, score); higher is better.
METRICS = {
    "macro_f1": lambda rows: stats.macro_f1(stats.confusion(rows, "predicted", "label")),
    "accuracy": lambda rows: stats.accuracy(stats.confusion(rows, "predicted", "label")),
    "auroc": lambda rows: stats.auroc(rows, "score", "y"),
}


def watched_probe(
    rows: DataFrame, key: str, vector: str, label: str, part: Column, metric: str = "macro_f1",
    hidden: tuple[int, ...] = (), burst: int = 5, patience: int = 5, most: int = 40, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A probe (softmax, behind the layers of ``hidden``) whose training stops by a metric of the rows it doesn't learn from.

    ``part`` says 'train', 'valid' or anything else of each row. Training runs in bursts of ``burst`` iterations, each from the
    weights of the last; after each, ``metric`` is taken over all of 'valid'. It ends once ``patience`` bursts in a row bring
    nothing better, or after ``most``, and the weights of the best burst (the first of equals) count.

    Returns the history (burst, value, best), one row a burst, and (key, label, part, predicted, score) of all rows, where
    ``score`` is the probability of the last label in order. For labels of residues the rows are residues.

    Rows without a vector or label are left out. 'auroc' wants two labels, and any metric rows in both parts; both are errors
    otherwise. Labels that training never sees are never predicted. The driver sees labels, weights and one value a burst.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    whole = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    whole = settle(whole.select(key, F.col(label).cast("bigint").alias("label"), part.alias("part"), F.col(vector).cast("array<double>").alias("v")))
    train, valid = (whole.filter(F.col("part") == p) for p in ("train", "valid"))
    names = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]
    if not names or valid.isEmpty():
        raise ValueError("no labelled rows to train on, or none to watch")
    if metric == "auroc" and len(names) != 2:
        raise ValueError("auroc is of two labels")
    known = F.array(*map(F.lit, names))
    spread = lambda df: df.withColumn("features", array_to_vector("v"))
    learned = spread(train.withColumn("y", (F.array_position(known, F.col("label")) - 1).cast("double")))
    layers = [len(train.select("v").first()["v"]), *hidden, max(2, len(names))]

    def predicted(model, df: DataFrame) -> DataFrame:
        found = model.transform(spread(df)).withColumn("p", vector_to_array("probability"))
        return found.select(key, "label", "part", F.get(known, F.col("prediction").cast("int")).alias("predicted"), F.get("p", F.lit(len(names) - 1)).alias("score"))

    history, weights, best, at = [], None, None, 0
    for number in range(1, most + 1):
        trainer = MultilayerPerceptronClassifier(labelCol="y", layers=layers, maxIter=burst, tol=0.0, seed=seed)
        if weights is not None:
            trainer.setInitialWeights(weights)
        model = trainer.fit(learned)
        weights = model.weights
        found = predicted(model, valid).withColumn("y", (F.col("label") == names[-1]).cast("int"))
        value = METRICS[metric](found).first()[0]
        value = float("nan") if value is None else float(value)
        if best is None or value > history[at - 1][1]:
            best, at = model, number
        history.append((number, value))
        if number - at >= patience:
            break
    told = rows.sparkSession.createDataFrame([(n, v, n == at) for n, v in history], "burst int, value double, best boolean")
    return told, predicted(best, whole)
