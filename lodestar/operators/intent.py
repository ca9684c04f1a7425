"""EXTENSION: the type of a query by a trained model, beside the rules of operators/query.py.

Multinomial logistic regression over hashed words, pairs of words and the query's form, by Spark's own learner: gradients
are summed over the executors by a tree, and the driver holds the coefficients (types x features) and nothing else."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def features(query: Column) -> Column:
    """Words, neighbouring words, and marks of form: of a query of any length, null counts as empty."""
    q = F.coalesce(query, F.lit(""))
    plain = words(F.lower(q))
    pairs = F.zip_with(F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0))), F.slice(plain, F.lit(2), F.size(plain)), lambda a, b: F.concat(F.lit("2:"), a, F.lit(" "), b))
    shapes = F.transform(words(q), lambda w: F.concat(F.lit("s:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")))
    ends = F.transform(plain, lambda w: F.concat(F.lit("e:"), F.right(w, F.lit(4))))
    return F.concat(plain, pairs, shapes, ends, F.array(F.concat(F.lit("n:"), F.least(F.size(plain), F.lit(6)).cast("string"))))


def train(labelled: DataFrame, dims: int = 1 << 14, iterations: int = 60, regularisation: float = 1e-4) -> PipelineModel:
    """Fit on (query, type). Rows without a type are left out."""
    rows = labelled.where("type is not null").select("type", features(F.col("query")).alias("_words"))
    stages = [StringIndexer(inputCol="type", outputCol="_label", stringOrderType="alphabetAsc"), HashingTF(inputCol="_words", outputCol="_features", numFeatures=dims, binary=True), LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_at", family="multinomial", maxIter=iterations, regParam=regularisation)]
    return Pipeline(stages=stages).fit(rows)


def classify(model: PipelineModel, queries: DataFrame, name: str = "type") -> DataFrame:
    """queries (query, ...) with the likeliest type and its probability."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    rows = queries.withColumn("_words", features(F.col("query")))
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    from pyspark.ml.functions import vector_to_array

    best = F.array_max(vector_to_array("probability"))
    return rows.select(*queries.columns, F.element_at(labels, F.col("_at").cast("int") + 1).alias(name), best.alias("likelihood"))
