"""Classifiers over feature tables, all trained by Spark ML.

What the steps compute is this package's own definition. The loops run over
folds, models and feature groups, whose number is fixed by the caller; every
pass over the rows is a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.operators.ranking import row_index
from wavelead.storage import materialize, new_path, remove

SEED = 42
# Fits that run at the same time, and the most folds that a table may have.
PARALLEL = 4
MAX_FOLDS = 50


def logistic(reg: float = 0.01) -> list[Estimator]:
    # The estimator scales the features itself, which saves a pass over the rows.
    return [LogisticRegression(featuresCol="assembled", regParam=reg, maxIter=50)]


def forest(trees: int = 50, depth: int = 5) -> list[Estimator]:
    return [
        RandomForestClassifier(
            featuresCol="assembled", numTrees=trees, maxDepth=depth, seed=SEED
        )
    ]


MODELS = {"logistic": logistic, "forest": forest}


def _fit(train: DataFrame, features: list[str], stages: list[Estimator]):
    # Gaps (null or NaN) are filled by the mean of the rows that are learned from.
    filled = [f"_filled_{name}" for name in features]
    imputer = Imputer(inputCols=features, outputCols=filled, strategy="mean")
    assembler = VectorAssembler(inputCols=filled, outputCol="assembled", handleInvalid="error")
    *before, model = Pipeline(stages=[imputer, assembler, *stages]).fit(train).stages
    return PipelineModel([*before, _without_summary(train.sparkSession, model)])


def _without_summary(spark: SparkSession, model):
    """The model as it is read back from a file.

    A fitted model goes to the tasks with the summary of its training, and that
    with the session, which can't be sent once a query of it has been observed.
    """
    path = new_path(spark, "model")
    model.write().session(spark).save(path)
    read = type(model).read().session(spark).load(path)
    remove(spark, path)
    return read


def _score(model, rows: DataFrame) -> DataFrame:
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).withColumn("p", p)


def _fold_numbers(rows: DataFrame) -> list:
    """The folds of a table; more than ``MAX_FOLDS`` of them are an error, as each is a fit."""
    folds = [r["fold"] for r in rows.select("fold").distinct().limit(MAX_FOLDS + 1).collect()]
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds")
    return sorted(folds)


def _in_parallel(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of several fits; a few at a time keep the cluster busy between their short stages."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(PARALLEL) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def out_of_fold(
    rows: DataFrame,
    features: list[str],
    models: tuple[str, ...] = ("logistic", "forest"),
    key: str = "id",
) -> DataFrame:
    """Score every row by a model that was trained on the other folds.

    ``rows`` has ``key``, ``label``, ``fold`` and the feature columns. The
    result has a row per model and row of the input.
    """
    # The rows are read once per fold and model; a table spares recomputing the
    # features each time, and scoring a fold reads that fold only.
    rows = materialize(rows.select(key, "label", "fold", *features), "features", ("fold",))
    return _cross_validate(rows, [(features, models)], key)[0]


def _cross_validate(
    rows: DataFrame, runs: list[tuple[list[str], tuple[str, ...]]], key: str
) -> list[DataFrame]:
    """Out-of-fold scores of every run, a list of features and the models to fit on them."""
    folds = _fold_numbers(rows)

    def job(features: list[str], name: str, fold) -> DataFrame:
        model = _fit(rows.where(F.col("fold") != fold), features, MODELS[name]())
        held_out = _score(model, rows.where(F.col("fold") == fold))
        return held_out.select(
            F.lit(name).alias("model"), key, "fold", F.col("label").cast("int"), "p"
        )

    jobs = [
        (n, partial(job, features, name, fold))
        for n, (features, models) in enumerate(runs)
        for name in models
        for fold in folds
    ]
    parts = _in_parallel(rows.sparkSession, [j for _, j in jobs])
    return [
        reduce(DataFrame.unionByName, [p for (n, _), p in zip(jobs, parts) if n == run])
        for run in range(len(runs))
    ]


def fit_gaps(rows: DataFrame, features: list[str], reg: float = 0.01) -> DataFrame:
    """How far the logistic regression of every fold is from its optimum, on the rows it learned from.

    At the optimum the mean score equals the share of ones, and the gradient of
    the loss, penalty included, is 0 for every feature (``max_gradient`` is the
    largest, in units of a feature's standard deviation; as the mean score agrees,
    features may be centred for it). ``rows`` is as for
    :func:`out_of_fold`, without gaps.
    """
    rows = materialize(rows.select("label", "fold", *features), "fit-gaps", ("fold",))

    def job(fold) -> DataFrame:
        train = rows.where(F.col("fold") != fold)
        model = _fit(train, features, logistic(reg))
        weights = model.stages[-1].coefficients.toArray().tolist()
        error = F.col("p") - F.col("label")
        found = _score(model, train).agg(
            F.count(F.lit(1)).alias("n_train"),
            F.avg(F.col("label").cast("double")).alias("rate"),
            F.avg("p").alias("mean_score"),
            *[F.covar_pop(error, c).alias(f"_g{k}") for k, c in enumerate(features)],
            *[F.stddev_samp(c).alias(f"_s{k}") for k, c in enumerate(features)],
            *[F.max(F.abs(c)).alias(f"_m{k}") for k, c in enumerate(features)],
        )
        # What varies in its last digits only is a constant.
        gradient = [
            F.when(
                F.col(f"_s{k}") > 1e-9 * F.col(f"_m{k}"), F.abs(F.col(f"_g{k}") / F.col(f"_s{k}") + reg * w * F.col(f"_s{k}"))
            ).otherwise(0.0)
            for k, w in enumerate(weights)
        ]
        return found.select(
            F.lit(fold).alias("fold"), "n_train", "rate", "mean_score", F.array_max(F.array(*gradient)).alias("max_gradient")
        )

    jobs = [partial(job, fold) for fold in _fold_numbers(rows)]
    return reduce(DataFrame.unionByName, _in_parallel(rows.sparkSession, jobs))


def stack_scores(scores: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Score tables ``(key, p)`` side by side, one column per model."""
    named = [df.select(key, F.col("p").alias(name)) for name, df in scores.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def stacking(
    scores: dict[str, DataFrame], truth: DataFrame, key: str = "id"
) -> DataFrame:
    """Out-of-fold scores of a logistic regression over the scores of other models.

    ``truth`` has ``key``, ``label`` and ``fold``.
    """
    rows = stack_scores(scores, key).join(truth.select(key, "label", "fold"), key)
    return out_of_fold(rows, list(scores), ("logistic",), key)


def accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share of right calls at 0.5 and mean log loss, per ``by``."""
    hit = F.when(F.col("p") >= 0.5, 1).otherwise(0) == F.col("label")
    right = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("int")).alias("accuracy"),
        F.avg(-F.ln(F.greatest(right, F.lit(1e-15)))).alias("log_loss"),
    )


def ablation(
    rows: DataFrame,
    groups: dict[str, list[str]],
    models: tuple[str, ...] = ("logistic",),
    key: str = "id",
) -> DataFrame:
    """Out-of-fold quality with all features, with each group left out, and with each alone."""
    everything = [name for columns in groups.values() for name in columns]
    runs = {("all", "all"): everything}
    for name, columns in groups.items():
        rest = [c for c in everything if c not in columns]
        if rest:
            runs["without", name] = rest
        runs["only", name] = columns
    rows = materialize(rows.select(key, "label", "fold", *everything), "ablation", ("fold",))
    scored = _cross_validate(rows, [(columns, models) for columns in runs.values()], key)
    results = [
        accuracy(table, ["model"]).select(
            F.lit(mode).alias("mode"),
            F.lit(name).alias("feature_group"),
            F.lit(len(columns)).alias("n_features"),
            "*",
        )
        for ((mode, name), columns), table in zip(runs.items(), scored)
    ]
    return reduce(DataFrame.unionByName, results)


# Rounds of the network and the most steps of a walk: of numbers out of range, three
# quarters at worst, so many steps in a row leave one in 10**16 there.
ROUNDS = 4
WALK = 128
# Fixed factor and shift of a round.
FACTOR, SHIFT = 1103515245, 12


def round_keys(seed: int) -> list[int]:
    return [(seed * 40503 + (k + 1) * 2654435761) % 2**31 for k in range(ROUNDS)]


def shuffled(number: Column, n: int, seed: int = SEED) -> Column:
    """Another number below ``n`` for every number below it: a bijection given by ``seed``.

    A balanced Feistel network over the even number of bits that hold ``n - 1``;
    a result that is not below ``n`` goes through it again until it is. Integer
    functions of Spark only, so no row has to know of any other.
    """
    half = max(1, -(-(max(n - 1, 1).bit_length()) // 2))
    mask = (1 << half) - 1
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def turn(s: Column, key: Column) -> Column:
        mixed = F.shiftright(s["r"] * F.lit(FACTOR) + key, SHIFT).bitwiseAND(F.lit(mask).cast("long"))
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed).alias("r"))

    def through(x: Column) -> Column:
        start = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(F.lit(mask).cast("long")).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        through(number.cast("long")),
        lambda x, _: F.when(x < n, x).otherwise(through(x)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("walk out of range")).cast("long"))


def permute_column(rows: DataFrame, column: str, key: str = "id", seed: int = SEED) -> DataFrame:
    """Deal the values of a column out anew over all rows.

    The rows are numbered once, by ``key``; :func:`shuffled` says to which
    number a row gives its value.
    """
    return _with_donors(rows, [column], key, seed).select(
        *[F.col(f"_of_{c}" if c == column else c).alias(c) for c in rows.columns]
    )


def _with_donors(rows: DataFrame, columns: list[str], key: str, seed: int) -> DataFrame:
    """Rows beside the ``columns`` of another row each, as ``_of_<name>``: one join for all of them."""
    numbered = row_index(rows, [], [key], "_n", count="_size")
    size = numbered.select("_size").first()
    to = shuffled(F.col("_n"), size["_size"] if size else 1, seed)
    donors = numbered.select(to.alias("_n"), *[F.col(c).alias(f"_of_{c}") for c in columns])
    return numbered.drop("_size").join(donors, "_n").drop("_n")


def permutation_importance(
    rows: DataFrame,
    features: list[str],
    model: str = "logistic",
    columns: list[str] | None = None,
    key: str = "id",
    seed: int = SEED,
) -> DataFrame:
    """Loss of out-of-fold quality when one column is permuted, per column.

    ``rows`` has a ``fold``: every row is scored, with its own value and with
    that of another row, by a model that was trained on the other folds.
    """
    columns = columns or features
    rows = rows.select(key, "label", "fold", *features)
    both = materialize(_with_donors(rows, columns, key, seed), "importance", ("fold",))

    def variant(column: str | None) -> Column:
        """The features with the donor's value in place of one of them."""
        values = [F.col(f"_of_{c}" if c == column else c).alias(c) for c in features]
        return F.struct(F.lit(column).cast("string").alias("feature"), *values)

    def job(fold) -> DataFrame:
        fitted = _fit(both.where(F.col("fold") != fold), features, MODELS[model]())
        # All variants of a row go through the model together, in one pass over the fold.
        variants = F.explode(F.array(*[variant(c) for c in (None, *columns)]))
        held_out = both.where(F.col("fold") == fold).select("label", variants.alias("v")).select("label", "v.*")
        return _score(fitted, held_out).select("feature", "label", "p")

    jobs = [partial(job, fold) for fold in _fold_numbers(both)]
    parts = _in_parallel(rows.sparkSession, jobs)
    quality = accuracy(reduce(DataFrame.unionByName, parts), ["feature"])
    # A row per column and one for the values as they are.
    quality = materialize(quality, "quality")
    base = quality.where("feature IS NULL").first()
    return quality.where("feature IS NOT NULL").select(
        "feature",
        "n",
        (base["accuracy"] - F.col("accuracy")).alias("accuracy_drop"),
        (F.col("log_loss") - base["log_loss"]).alias("log_loss_rise"),
    )
