"""High-value customers: features, stratified split, random forest and its scores.

The tier is itself computed from recency, frequency and value, which are among
the features, so good scores are expected here and say little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ledgerlake.errors import NotEnoughData
from ledgerlake.functions.values import is_high_value, zero_if_null
from ledgerlake.operators.ranking import rows_at
from ledgerlake.staging import stage

BASE_FEATURES = ["recency_days", "frequency", "monetary_value", "avg_order_sales", "avg_discount", "avg_profit"]
_MIN_CUSTOMERS, _MIN_PER_CLASS = 20, 3
#: A column with more values than this is not a category.
MOST_CATEGORIES = 500


def customer_averages(facts: DataFrame) -> DataFrame:
    """Mean sales, discount and profit per customer."""

    def mean(column: str):
        return F.try_divide(F.sum(column).cast("double"), F.count(column))

    return facts.groupBy("customer_key").agg(
        mean("sales").alias("avg_order_sales"),
        mean("discount").alias("avg_discount"),
        mean("profit").alias("avg_profit"),
    )


def one_hot(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns ``<column>_<value>`` for all values but the alphabetically first."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"'{column}' has more than {MOST_CATEGORIES} values, too many for a column each")
    values = sorted(r[0] for r in found)
    names = [f"{column}_{value}" for value in values[1:]]
    flags = {n: F.coalesce((F.col(column) == x).cast("int"), F.lit(0)) for n, x in zip(names, values[1:])}
    return (df.withColumns(flags) if flags else df), names


def customer_features(dim_customers: DataFrame, facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Customers having sales, with target ``is_high_value`` and numeric features."""
    joined = dim_customers.join(customer_averages(facts), "customer_key").withColumn(
        "is_high_value", is_high_value(F.col("customer_tier"))
    )
    encoded, dummies = one_hot(joined, "segment")
    features = BASE_FEATURES + dummies
    return encoded.withColumns({f: zero_if_null(F.col(f"`{f}`").cast("double")) for f in features}), features


def stratified_split(df: DataFrame, label: str, key: str, train_part: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly the given part of each label's rows, rounded.

    Rows are ordered by a hash of their key within each label; the last row
    that still trains is looked up by its position, so no label is gathered
    in one task.
    """
    ordered = df.select(label, F.xxhash64(key, F.lit(seed)).alias("_draw"), key)
    sizes = sorted((r[label], r["rows"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).collect())
    last, base = {}, 0
    for value, rows in sizes:
        taken = int(rows * train_part + 0.5)
        if taken:
            last[base + taken] = value
        base += rows
    is_train = F.lit(False)
    draw = F.xxhash64(key, F.lit(seed))
    for row in rows_at(ordered, [label, "_draw", key], list(last)):
        before = (draw < F.lit(row["_draw"])) | ((draw == F.lit(row["_draw"])) & (F.col(key) <= F.lit(row[key])))
        is_train = is_train | ((F.col(label) == F.lit(row[label])) & before)
    return df.withColumn("is_train", is_train)


@dataclass(frozen=True)
class CustomerModel:
    scored: DataFrame
    features: list[str]
    forest: RandomForestClassificationModel

    def confusion(self) -> DataFrame:
        """(actual, predicted, customers) on the held-out part, all four cells."""
        test = self.scored.filter("not is_train")
        cells = test.agg(
            *[
                F.count_if((F.col("is_high_value") == a) & (F.col("predicted_high_value") == p)).alias(f"_{a}{p}")
                for a in (0, 1)
                for p in (0, 1)
            ]
        )
        rows = [
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{a}{p}").alias("customers"))
            for a in (0, 1)
            for p in (0, 1)
        ]
        return cells.select(F.inline(F.array(*rows)))

    def metrics(self) -> DataFrame:
        """Accuracy, and precision, recall and F1 of the high-value class."""
        return classification_metrics(self.confusion())

    def importance(self) -> DataFrame:
        """(feature, importance), strongest first."""
        weights = self.forest.featureImportances.toArray().tolist()
        rows = [(f, round(x, 4)) for f, x in zip(self.features, weights)]
        table = self.scored.sparkSession.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")

    def predictions(self, count: int = 100) -> DataFrame:
        return (
            self.scored.orderBy("customer_key")
            .limit(count)
            .select(
                "customer_key",
                "customer_id",
                "customer_name",
                "customer_tier",
                "high_value_probability",
                "predicted_high_value",
            )
        )


def classification_metrics(confusion: DataFrame) -> DataFrame:
    def cell(*pairs):
        wanted = F.lit(False)
        for a, p in pairs:
            wanted = wanted | ((F.col("actual") == a) & (F.col("predicted") == p))
        return F.sum(F.when(wanted, F.col("customers")).otherwise(0))

    def share(part, whole):
        return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)

    hit = cell((1, 1))
    return confusion.agg(
        share(cell((0, 0), (1, 1)), F.sum("customers")).alias("accuracy"),
        share(hit, cell((1, 1), (0, 1))).alias("precision"),
        share(hit, cell((1, 1), (1, 0))).alias("recall"),
        share(hit * 2, hit * 2 + cell((0, 1), (1, 0))).alias("f1_score"),
    )


def fit_customer_model(dim_customers: DataFrame, facts: DataFrame, seed: int = 42) -> CustomerModel:
    if dim_customers.count() < _MIN_CUSTOMERS:
        raise NotEnoughData(f"the classifier needs {_MIN_CUSTOMERS} customers")
    prepared, features = customer_features(dim_customers, facts)
    prepared = stage(prepared, "customer-features")
    sizes = [r["count"] for r in prepared.groupBy("is_high_value").count().collect()]
    if len(sizes) < 2 or min(sizes) < _MIN_PER_CLASS:
        raise NotEnoughData(f"the classifier needs {_MIN_PER_CLASS} customers of either class")
    split = stratified_split(prepared, "is_high_value", "customer_key", seed=seed)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(split)
    forest = RandomForestClassifier(
        labelCol="is_high_value", featuresCol="features", numTrees=100, maxDepth=5, seed=seed
    ).fit(vectors.filter("is_train"))
    scored = forest.transform(vectors).select(
        *split.columns,
        vector_to_array("probability")[1].alias("high_value_probability"),
        F.col("prediction").cast("int").alias("predicted_high_value"),
    )
    return CustomerModel(stage(scored, "customer-scores"), features, forest)
