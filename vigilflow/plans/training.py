"""Jobs that chain the operators: dataset preparation and model training."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow import fixed_values as V
from vigilflow.operators import cleaning, evaluation, fitting, forest, isolation, versions
from vigilflow.operators.analytics import counts_with_share
from vigilflow.session import settle

#: Parts of the saved models and their types.
PARTS = {"params": "FittedParams", "anomaly": "IsolationModel", "threat": "ThreatModel"}


def prepare_dataset(raw: DataFrame, scaler: str = "robust") -> tuple[DataFrame, fitting.FittedParams]:
    """(feature matrix with the three label columns, fitted parameters)."""
    unique = cleaning.exact_dedup(cleaning.normalize_columns(raw))
    # read by every pass of the fit and by the matrix
    labelled = settle(cleaning.normalize_labels(unique), "unique")
    labels = [c for c in ("original_label", "normalized_label", "is_intrusion") if c in labelled.columns]
    params = fitting.fit(labelled.drop(*labels), scaler)
    matrix = fitting.transform(labelled, params, keep=labels)
    return matrix, params


def write_processed(raw: DataFrame, path: str, as_csv: bool = False) -> fitting.FittedParams:
    matrix, params = prepare_dataset(raw)
    if as_csv:
        matrix.write.option("header", True).csv(path)
    else:
        matrix.write.parquet(path)
    return params


def dataset_metadata(raw: DataFrame, name: str, is_sample: bool) -> DataFrame:
    """One governance row: sizes, repairs, removed and fitted columns, labels."""
    spark = raw.sparkSession
    named = cleaning.normalize_columns(raw)
    label = cleaning.label_column(named)
    seen = cleaning.inspect_infinite(named)
    original = seen.rows
    unique = settle(cleaning.exact_dedup(named), "unique")
    params = fitting.fit(unique.drop(label) if label else unique)
    processed = unique.count()
    row = spark.createDataFrame(
        [
            (
                name, is_sample, original, processed, len(raw.columns), len(params.feature_names()),
                original - processed, seen.replacements, params.removed, params.engineered,
                [p.column for p in params.numeric], [p.column for p in params.categorical],
            )
        ],
        """dataset_name string, is_sample_dataset boolean, original_row_count long, processed_row_count long, original_column_count int,
        processed_feature_count int, duplicates_removed long, infinite_values_imputed long, removed_columns map<string,string>,
        engineered_features array<string>, fitted_numerical_features array<string>, fitted_categorical_features array<string>""",
    )
    if not label:
        return row
    shares = counts_with_share(named, label, "label").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("label", F.lit("nan")).alias("k"), F.struct("count", "percentage").alias("v"))))).alias("m")
    )
    return row.withColumn("label_distribution", shares.scalar())


@dataclass
class Models:
    """Everything scoring needs, with the evaluation of the held-out rows."""

    params: fitting.FittedParams
    anomaly: isolation.IsolationModel
    threat: forest.ThreatModel
    train_rows: int = 0
    test_rows: int = 0
    stratified: bool = False
    metrics: dict = field(default_factory=dict)

    def catalog(self, spark: SparkSession, version: str = "1.0.0") -> DataFrame:
        """One row: version, split, settings, classes, metrics, top features."""
        importance = forest.feature_importance(spark, self.threat)
        top = [r["feature"] for r in importance.limit(10).collect()]
        row = {
            "model_version": version,
            "train_samples": self.train_rows,
            "test_samples": self.test_rows,
            "stratified": self.stratified,
            "total_features": len(self.threat.features),
            "top_features": ",".join(top),
            "anomaly_trees": int(self.anomaly.nodes["tree"].nunique()),
            "anomaly_sample": self.anomaly.sample,
            "anomaly_contamination": V.FOREST_CONTAMINATION,
            "classifier_trees": self.threat.trees,
            "classifier_depth": self.threat.depth,
            "random_state": V.SEED,
            "classes": ",".join(self.threat.classes),
            **{k: float(v) for k, v in self.metrics.items()},
        }
        return spark.createDataFrame([row])

    def save(self, spark: SparkSession, path: str) -> str:
        """Publishes a new version below ``path``; until all of it is written the one before stays current."""

        def write(folder: str) -> None:
            for part in PARTS:
                getattr(self, part).save(spark, f"{folder}/{part}")

        return versions.publish(spark, path, PARTS, write)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Models":
        """The current version, its files checked against the manifest."""
        folder = versions.current(spark, path, PARTS)
        return cls(
            fitting.FittedParams.load(spark, f"{folder}/params"),
            isolation.IsolationModel.load(spark, f"{folder}/anomaly"),
            forest.ThreatModel.load(spark, f"{folder}/threat"),
        )


def train(raw: DataFrame, key: list[str], scaler: str = "robust", depth: int = V.CLASSIFIER_DEPTH) -> Models:
    """Clean, label, split, fit on the training part only, grow both models and
    evaluate them on the test part.

    Each stage that is read more than once is written to the scratch folder.
    """
    labelled = cleaning.normalize_labels(cleaning.exact_dedup(cleaning.normalize_columns(raw)))
    if "normalized_label" not in labelled.columns:
        raise ValueError("training needs a label column")
    labelled = settle(labelled, "labelled")
    split = settle(fitting.train_test_split(labelled, "normalized_label", key), "split")
    labels = ["original_label", "normalized_label", "is_intrusion"]
    # with the key, as rows that differ in it alone are no duplicates; fit removes identifiers by name
    inputs = [c for c in split.columns if c not in (*labels, "is_test")]
    params = fitting.fit(split.filter("NOT is_test").select(*inputs), drop=key)
    matrix = settle(fitting.transform(split, params, keep=[*key, "normalized_label", "is_intrusion", "is_test"]), "matrix")
    features = params.feature_names()
    seen, held = matrix.filter("NOT is_test"), matrix.filter("is_test")
    anomaly = isolation.fit(seen, features, key)
    threat = forest.fit(seen, features, "normalized_label", depth=depth)
    scored = forest.score(isolation.score(held, anomaly), threat).select(
        "normalized_label", "predicted_threat", "is_intrusion", "is_anomaly", "anomaly_score"
    )
    scored = settle(scored, "held-out")
    quality = evaluation.classifier_metrics(scored, "normalized_label", "predicted_threat", threat.classes).first()
    outliers = evaluation.anomaly_metrics(scored).first()
    agreement = evaluation.anomaly_validation(scored, "is_intrusion").first()
    sizes = matrix.groupBy("is_test").count().collect()
    rows = {r["is_test"]: r["count"] for r in sizes}
    smallest = min(forest.classes_of(matrix, "normalized_label").values())
    return Models(
        params, anomaly, threat, rows.get(False, 0), rows.get(True, 0), smallest >= 2,
        {**quality.asDict(), **outliers.asDict(), **agreement.asDict()},
    )


def write_evaluation(path: str, **frames: DataFrame) -> None:
    """Tables as CSV, reports and metrics as JSON."""
    for name, frame in frames.items():
        small = frame.coalesce(1)  # class counts only
        if name in ("confusion_matrix", "feature_importance"):
            small.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        else:
            small.write.mode("overwrite").json(f"{path}/{name}")
