"""Attrition risk: features, stratified split, boosted trees, cross-validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.functions import lookups as L
from kpiloom.models import boosting
from kpiloom.models.boosting import BoostingParams
from kpiloom.operators.keys import stratified_number
from kpiloom.operators.quantiles import exact_auc
from kpiloom.plans.kpi import Star, staff_by_department

# The twelve features of the published model.
FEATURES = [
    "age",
    "gender",
    "monthly_income",
    "job_satisfaction",
    "years_at_company",
    "overtime",
    "distance_from_home",
    "education",
    "environment_satisfaction",
    "performance_rating",
    "department_name",
    "job_role",
]
CATEGORICAL = ["gender", "overtime", "department_name", "job_role"]
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5


# -- features ---------------------------------------------------------------

def feature_frame(star: Star, keep: tuple[str, ...] = ()) -> DataFrame:
    """Twelve features and the attrition value, from the three-way star join."""
    return staff_by_department(star).select(*keep, *FEATURES, "attrition")


def binary_target(attrition: Column) -> Column:
    return F.when(attrition == "Yes", 1).otherwise(0)


def label_encoder() -> StringIndexer:
    """Alphabetical codes; a value not seen in training gets the next code."""
    return StringIndexer(
        inputCols=CATEGORICAL,
        outputCols=[f"{c}_idx" for c in CATEGORICAL],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )


def label_encode(df: DataFrame) -> DataFrame:
    """Replace each categorical column by its alphabetical code."""
    encoded = label_encoder().fit(df).transform(df)
    others = [c for c in df.columns if c not in CATEGORICAL]
    return encoded.select(
        *others, *[F.col(f"{c}_idx").cast("int").alias(c) for c in CATEGORICAL]
    )


def encode_for_scoring(df: DataFrame) -> DataFrame:
    """The fixed codes a single-record request is encoded with."""
    return df.select(
        "*",
        C.map_values(F.col("gender"), L.GENDER_CODE, 0).alias("gender_code"),
        C.map_values(F.col("overtime"), L.OVERTIME_CODE, 0).alias("overtime_code"),
        C.map_values(
            F.col("department_name"), L.DEPARTMENT_CODE, L.DEFAULT_DEPARTMENT_CODE
        ).alias("department_code"),
        C.map_values(F.col("job_role"), L.ROLE_CODE, L.DEFAULT_ROLE_CODE).alias("role_code"),
    )


def request_numbers(requests: DataFrame) -> DataFrame:
    """Add the twelve ``*_num`` inputs of the model to request records, by the fixed codes.

    A missing number stays missing: the trees have learned a side for it.
    """
    coded = encode_for_scoring(requests)
    short = {"department_name": "department_code", "job_role": "role_code"}
    source = {c: short.get(c, f"{c}_code") if c in CATEGORICAL else c for c in FEATURES}
    return coded.select(
        "*",
        *[F.col(src).cast("double").alias(f"{c}_num") for c, src in source.items()],
    )


def score_requests(model: AttritionModel, requests: DataFrame, keep: list[str]) -> DataFrame:
    """Score records of the twelve raw fields as a scoring service would, in one batch.

    Departments, roles, gender and overtime go through the fixed codes, with the
    defaults for unknown values, and not through the codes learned in training.
    """
    return _scored(model, request_numbers(requests), keep)


# -- split and folds --------------------------------------------------------

def numbered_by_class(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add the 0/1 target and a repeatable random rank inside each class."""
    targeted = df.withColumn("target", binary_target(F.col("attrition")))
    return stratified_number(targeted, "target", key, seed)


def stratified_split(
    df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Mark ``is_test`` for an exact share of each class."""
    numbered = numbered_by_class(df, key, seed)
    sizes = numbered.groupBy(F.col("target").alias("_class")).agg(
        F.round(F.count(F.lit(1)) * F.lit(test_share), 0).alias("_take")
    )
    # one row per class, two classes
    return (
        numbered.join(F.broadcast(sizes), F.col("target") == F.col("_class"))
        .withColumn("is_test", F.col("rn") <= F.col("_take"))
        .drop("_class", "_take")
    )


def fold_of(rank: Column, folds: int = FOLDS) -> Column:
    return ((rank - 1) % folds).cast("int")


def class_weight(train: DataFrame) -> DataFrame:
    """One row: negatives, positives and their ratio."""
    neg, pos = F.count_if(F.col("target") == 0), F.count_if(F.col("target") == 1)
    return train.agg(
        neg.alias("negatives"),
        pos.alias("positives"),
        F.try_divide(neg.cast("double"), pos.cast("double")).alias("class_weight"),
    )


# -- training ---------------------------------------------------------------

@dataclass(frozen=True)
class AttritionModel:
    """The label codes and one of the boosted models fitted together."""

    encoder: StringIndexerModel
    boosted: boosting.Boosted
    number: int = 0


def model_numbers(encoder: StringIndexerModel, rows: DataFrame) -> DataFrame:
    """Add the twelve ``*_num`` inputs of the model: codes and numbers, null where missing.

    Codes are ordered numbers to the trees, so the number of job roles is not limited.
    """
    source = {c: f"{c}_idx" if c in CATEGORICAL else c for c in FEATURES}
    coded = encoder.transform(rows)
    return coded.select(*rows.columns, *[F.col(src).cast("double").alias(f"{c}_num") for c, src in source.items()])


def fit_models(
    rows: DataFrame, learns: Sequence[Column], ratio: float, params: BoostingParams, key: str = "source_key"
) -> list[AttritionModel]:
    """One model for each condition of ``learns``, of the rows that meet it; all are grown in one pass."""
    encoder = label_encoder().fit(rows)
    members = sum((F.when(c, F.lit(1 << m)).otherwise(0) for m, c in enumerate(learns)), F.lit(0))
    inputs = [f"{c}_num" for c in FEATURES]
    coded = model_numbers(encoder, rows.withColumn("members", members))
    table = coded.select(F.col(key).alias("key"), "target", "members", *inputs)
    fitted = boosting.fit(table, inputs, len(learns), ratio, params)
    return [AttritionModel(encoder, fitted, m) for m in range(len(learns))]


def train(train_rows: DataFrame, ratio: float, params: BoostingParams, key: str = "source_key") -> AttritionModel:
    return fit_models(train_rows, [F.lit(True)], ratio, params, key)[0]


def _scored(model: AttritionModel, numbers: DataFrame, keep: list[str]) -> DataFrame:
    chance = model.boosted.probability([F.col(f"{c}_num") for c in FEATURES], model.number)
    return numbers.select(*keep, chance.alias("probability")).withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int")
    )


def score(model: AttritionModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Probability of leaving and the 0/1 prediction for a batch of rows."""
    return _scored(model, model_numbers(model.encoder, rows), keep)


def save_model(spark: SparkSession, model: AttritionModel, path: str) -> None:
    """The label codes and the model's nodes as a table."""
    model.encoder.write().overwrite().save(f"{path}/codes")
    nodes = model.boosted.nodes(spark).where(F.col("model") == model.number)
    nodes.withColumn("model", F.lit(0)).write.mode("overwrite").parquet(f"{path}/nodes")


def load_model(spark: SparkSession, path: str) -> AttritionModel:
    nodes = spark.read.parquet(f"{path}/nodes")
    boosted = boosting.Boosted.from_nodes(nodes, [f"{c}_num" for c in FEATURES])
    return AttritionModel(StringIndexerModel.load(f"{path}/codes"), boosted)


def feature_importance(spark: SparkSession, model: AttritionModel) -> DataFrame:
    """One row per feature (twelve) with its share of gain, largest first."""
    weights = model.boosted.importance(model.number)
    rows = [(name, float(w)) for name, w in zip(FEATURES, weights, strict=True)]
    ranked = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return ranked.orderBy(F.desc("importance"), "feature")


def tree_summary(spark: SparkSession, model: AttritionModel) -> DataFrame:
    """One row per tree: largest leaf weight, depth and number of nodes."""
    nodes = model.boosted.nodes(spark).where(F.col("model") == model.number)
    leaf = F.when(F.col("feature") < 0, F.abs("value"))
    level = F.floor(F.log2(F.col("node") + 1.0) + 1e-9).cast("int")
    return nodes.groupBy("tree").agg(
        F.max(leaf).alias("weight"), F.max(level).alias("depth"), F.count(F.lit(1)).cast("int").alias("nodes")
    )


def fold_auc(
    spark: SparkSession, rows: DataFrame, models: Sequence[AttritionModel], folds: int = FOLDS
) -> DataFrame:
    """Per-fold ROC-AUC: ``fold, auc`` of the k-th model on the k-th fold."""
    folded = rows.withColumn("fold", fold_of(F.col("rn"), folds))

    @inheritable_thread_target(spark)
    def one(k: int) -> tuple[int, float]:
        scored = score(models[k], folded.where(F.col("fold") == k), ["target"])
        return k, exact_auc(scored, "probability", "target").first()["auc"]

    # each fold's scoring is jobs of its own, which share the cluster
    with ThreadPool(max(len(models), 1)) as pool:
        results = pool.map(one, range(len(models)))
    return spark.createDataFrame(results, "fold INT, auc DOUBLE")


def outside_fold(folds: int = FOLDS) -> list[Column]:
    """For each fold, the rows that are not in it."""
    return [fold_of(F.col("rn"), folds) != k for k in range(folds)]


def cross_validated_auc(
    spark: SparkSession, rows: DataFrame, ratio: float, params: BoostingParams, folds: int = FOLDS, key: str = "source_key"
) -> DataFrame:
    """Per-fold ROC-AUC: ``fold, auc``. ``rows`` carry ``target`` and ``rn``; all folds are grown in one pass."""
    return fold_auc(spark, rows, fit_models(rows, outside_fold(folds), ratio, params, key), folds)


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds, four digits."""
    return per_fold.agg(
        F.round(F.avg("auc"), 4).alias("cv_roc_auc_mean"),
        F.round(F.stddev_pop("auc"), 4).alias("cv_roc_auc_std"),
        F.count(F.lit(1)).alias("folds"),
    )


def metrics_row(
    accuracy: DataFrame, auc: DataFrame, cv: DataFrame, importance: DataFrame
) -> DataFrame:
    """All metrics and the importance map in one row, ready for JSON."""
    packed = importance.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
    )  # twelve entries
    return accuracy.select(
        "accuracy",
        auc.select("roc_auc").scalar().alias("roc_auc"),
        cv.select("cv_roc_auc_mean").scalar().alias("cv_roc_auc_mean"),
        cv.select("cv_roc_auc_std").scalar().alias("cv_roc_auc_std"),
        packed.scalar().alias("feature_importance"),
    )


def training_rows(star: Mapping[str, DataFrame], key: str = "source_key") -> DataFrame:
    """Features, target, rank and split mark: what the training jobs read."""
    return stratified_split(feature_frame(star, keep=(key,)), key)
