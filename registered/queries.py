"""Spark side: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Numbers that come out of floating-point work are rounded to six places so that
they can be compared by value; array results are exploded to one row per value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registered.standins import (
    EVENT_CHUNK,
    EVENT_WINDOW,
    HALO,
    LONG_CHUNK,
    N_LEADS,
    SHAPE,
    TYPE,
    USER,
    event_samples,
    labelled_leads,
    leads,
    long_record_files,
    long_samples,
    metadata,
    odd_headers,
    record_files,
    segment_files,
    table,
    vectors,
)
from wavelead.functions.columns import (
    binarize_label,
    is_junk,
    noise_sigma,
    sample_major,
    soft_threshold,
    threshold_bands,
    to_float,
    universal_threshold,
)
from wavelead.functions.wavelet import denoise, wavedec, waverec
from wavelead.operators.dataset import Observed, collate, dataset_report, dataset_rows, shape_rejects
from wavelead.operators.denoising import clean_leads, denoise_chunks, denoise_samples
from wavelead.operators.evaluation import confusion, late_fusion, misses
from wavelead.operators.features import FEATURES, lead_features, record_features
from wavelead.operators.folds import assign_folds, group_folds
from wavelead.operators.layout import LEAD, arrays_to_samples, samples_to_arrays
from wavelead.operators.models import (
    ablation,
    accuracy,
    fit_gaps,
    out_of_fold,
    permutation_importance,
    permute_column,
    stack_scores,
    stacking,
)
from wavelead.operators.names import parse_names, readable, unreadable
from wavelead.operators.records import (
    cohort_summary,
    completeness,
    correct_labels,
    head_profile,
    label_metadata,
    missing_recordings,
    recording_profile,
    with_metadata,
)
from wavelead.operators.segment import segment_leads, segment_samples, unsegmentable
from wavelead.plans.prepare import build_dataset, matrices_of_decoded, preprocess
from wavelead.sources.metadata import read_metadata
from wavelead.sources.recordings import (
    decode_chunks,
    decode_recordings,
    lead_rows,
    match_signals,
    parse_headers,
)
from wavelead.sources.signals import locate_recordings, read_stretches
from wavelead.sources.tables import (
    publish,
    read_dataset,
    read_published,
    read_segments,
    write_dataset,
    write_segments,
)
from wavelead.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]


def rounded(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def values_of(df: DataFrame, keys: list[str], array: str, position: str = "i") -> DataFrame:
    """One row per array element."""
    return df.select(*keys, F.posexplode(array).alias(position, "value")).withColumn(
        "value", rounded("value")
    )


# -- Layout and windows -----------------------------------------------------


def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).select("event_id", "user_id", "i")


def sample_index_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every event within its type: a handful of groups hold all rows."""
    return long_samples(spark, sf_dir).select("event_type", "event_id", "i")


def array_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays_to_samples(vectors(spark, sf_dir), ["vec_id"]).withColumn(
        "value", rounded("value")
    )


def long_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = samples_to_arrays(event_samples(spark, sf_dir), EVENT_CHUNK, by=USER)
    return values_of(arrays, ["user_id", "chunk_idx", "start"], "signal", "pos")


def segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = segment_samples(event_samples(spark, sf_dir), EVENT_WINDOW, USER)
    return values_of(segments, ["user_id", "seg_idx"], "samples", "pos")


def segment_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = segment_leads(leads(spark, sf_dir))
    return values_of(segments, ["patient_id", "lead_idx", "seg_idx"], "samples", "pos")


def rate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates too slow, negative, endless, too large to count with, and no number at all."""
    rate = (
        F.when(F.col("lead_idx") == 7, F.lit(float("nan")))
        .when(F.col("lead_idx") == 8, F.lit(float("inf")))
        .when(F.col("lead_idx") == 9, F.lit(1e10))
        .when(F.col("lead_idx") == 10, F.lit(-8.0))
        .otherwise(F.col("lead_idx") * F.lit(0.1))
    )
    return unsegmentable(leads(spark, sf_dir).withColumn("fs", rate)).select(*LEAD, "reason")


def float_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    thirds = vectors(spark, sf_dir).withColumn("signal", F.transform("signal", lambda v: v / 3))
    return values_of(
        thirds.withColumn("samples", to_float(F.col("signal"))), ["vec_id"], "samples"
    )


# -- Labels, metadata and checks --------------------------------------------


def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", binarize_label(F.col("label")).alias("label")
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_summary(table(spark, sf_dir, "embeddings"), "label")


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_profile(metadata(spark, sf_dir), leads(spark, sf_dir)).withColumn(
        "leads", F.concat_ws(",", "leads")
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording_profile(leads(spark, sf_dir)).withColumn("leads", F.concat_ws(",", "leads"))


def meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return with_metadata(documents, labels, "doc_id")


def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return missing_recordings(documents, table(spark, sf_dir, "labels"), "doc_id")


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(table(spark, sf_dir, "events"), "user_id")


def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(parse_names(segment_files(spark, sf_dir), suffix=".npy"))


def bad_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreadable(parse_names(segment_files(spark, sf_dir), suffix=".npy"))


def junk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(
        F.when(F.col("label") == 1, "__MACOSX/").otherwise("raw/"),
        F.when(F.col("label") == 2, "._").otherwise(""),
        F.when(F.col("label") == 3, ".DS_Store").otherwise(F.concat("vec_id", F.lit(".hea"))),
    )
    files = table(spark, sf_dir, "embeddings").select("vec_id", name.alias("path"))
    return files.where(~is_junk(F.col("path")))


def label_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patient_id"), binarize_label(F.col("label")).alias("brugada")
    )
    corrections = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("patient_id"), F.col("quality").alias("brugada")
    )
    return correct_labels(meta, corrections)


# -- Wavelet ----------------------------------------------------------------


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("bands", wavedec(F.col("signal")))


def wavelet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_band = bands(spark, sf_dir).select("vec_id", F.posexplode("bands").alias("band", "values"))
    return values_of(by_band, ["vec_id", "band"], "values", "k")


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = noise_sigma(F.element_at("bands", -1))
    return bands(spark, sf_dir).select("vec_id", rounded(sigma).alias("sigma"))


def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = universal_threshold(noise_sigma(F.element_at("bands", -1)), F.size("signal"))
    return bands(spark, sf_dir).select("vec_id", rounded(limit).alias("threshold"))


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    shrunk = soft_threshold(F.col("signal"), F.lit(0.1))
    return values_of(vectors(spark, sf_dir).withColumn("shrunk", shrunk), ["vec_id"], "shrunk")


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bands(spark, sf_dir).withColumn("signal", waverec(F.col("bands"), F.size("signal")))
    return values_of(back, ["vec_id"], "signal")


def threshold_all_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denoiser step by step: bands, threshold, shrinking, and back."""
    limit = universal_threshold(noise_sigma(F.element_at("bands", -1)), F.size("signal"))
    shrunk = bands(spark, sf_dir).withColumn("limit", limit)
    shrunk = shrunk.withColumn("bands", threshold_bands(F.col("bands"), F.col("limit")))
    back = shrunk.withColumn("signal", waverec(F.col("bands"), F.size("signal")))
    return values_of(back, ["vec_id"], "signal")


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = vectors(spark, sf_dir).withColumn("signal", denoise(F.col("signal")))
    return values_of(cleaned, ["vec_id"], "signal")


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_of(clean_leads(leads(spark, sf_dir)), LEAD, "signal")


def denoise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in the long layout, longer than a chunk and what is fetched around it."""
    samples = long_samples(spark, sf_dir)
    cleaned = denoise_samples(samples, TYPE, chunk=LONG_CHUNK, halo=HALO)
    return cleaned.withColumn("value", rounded("value"))


def preprocess_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = preprocess(leads(spark, sf_dir))
    return values_of(segments, [*LEAD, "seg_idx"], "samples", "pos")


# -- Data set ---------------------------------------------------------------


def collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate(segment_leads(labelled_leads(spark, sf_dir)), N_LEADS)


def shape_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_rows(collated(spark, sf_dir), SHAPE).drop("x")


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_rejects(collated(spark, sf_dir), SHAPE)


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dataset(labelled_leads(spark, sf_dir), shape=SHAPE)


def _matrix_values(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    keys = ["group", "label", "seg_idx"]
    by_row = rows.select(*keys, F.posexplode("x").alias(outer, "values"))
    return values_of(by_row, [*keys, outer], "values", inner)


def dataset_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_values(dataset(spark, sf_dir), "lead_idx", "pos")


def dataset_sample_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset(spark, sf_dir).withColumn("x", sample_major(F.col("x")))
    return _matrix_values(rows, "pos", "lead_idx")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_report(dataset_rows(collated(spark, sf_dir), SHAPE), SHAPE)


# -- Sources and sinks ------------------------------------------------------


def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "metadata")
    metadata(spark, sf_dir).withColumn("site", F.lit("a, b")).write.option("header", True).csv(path)
    return read_metadata(spark, path)


def decoded_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, signals = record_files(spark, sf_dir)
    decoded = lead_rows(decode_recordings(match_signals(parse_headers(headers), signals)))
    return values_of(decoded, ["patient_id", "fs", "lead_idx", "lead"], "signal")


def decoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples decoded in chunks of five, in the long layout."""
    headers, signals = record_files(spark, sf_dir)
    chunks = decode_chunks(match_signals(parse_headers(headers), signals), chunk=5)
    samples = arrays_to_samples(chunks, ["patient_id", "fs", "lead_idx", "lead"], start="start")
    return samples.withColumn("value", rounded("value"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, length and reason of headers of which some cannot be read."""
    parsed = parse_headers(odd_headers(spark, sf_dir))
    return parsed.select("patient_id", "fs", "n_samples", "reason")


def decode_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signal files read in stretches by the tasks, in the long layout."""
    located = locate_recordings(spark, long_record_files(spark, sf_dir))
    chunks = read_stretches(located, chunk=LONG_CHUNK)
    samples = arrays_to_samples(chunks, ["patient_id", "lead_idx", "lead"], start="start")
    return samples.withColumn("value", rounded("value"))


def equal_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of which some are there again, as they are or with other samples: which of them count."""
    folder = long_record_files(spark, sf_dir, size=24, copies=True)
    located = locate_recordings(spark, folder, equal_copies=True)
    return located.select("patient_id", F.substring("folder", -1, 1).alias("place"), "reason")


def denoise_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files denoised from their stretches, without a row per sample."""
    chunks = read_stretches(locate_recordings(spark, long_record_files(spark, sf_dir)), chunk=LONG_CHUNK)
    cleaned = denoise_chunks(chunks, LEAD, chunk=LONG_CHUNK, halo=HALO)
    return arrays_to_samples(cleaned, LEAD, start="start").withColumn("value", rounded("value"))


def dataset_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the bytes of signal files to data set values, in windows of one second."""
    return _dataset_of_files(spark, sf_dir, *record_files(spark, sf_dir))


def _dataset_of_files(
    spark: SparkSession, sf_dir: str, headers: DataFrame, signals: DataFrame
) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patient_id"), F.array(binarize_label(F.col("label"))).alias("labels")
    )
    parsed = parse_headers(headers).join(labels, "patient_id", "left")
    decoded = decode_recordings(match_signals(parsed, signals))
    rows = dataset_rows(matrices_of_decoded(decoded, 1, 4), (8, 4))
    return _matrix_values(rows, "lead_idx", "pos")


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "segments")
    write_segments(segment_leads(labelled_leads(spark, sf_dir)).drop("fs"), path)
    keys = ["patient_id", "label", "lead_idx", "lead", "seg_idx"]
    return values_of(read_segments(spark, path), keys, "samples", "pos")


def dataset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dataset")
    write_dataset(dataset(spark, sf_dir), path)
    return _matrix_values(read_dataset(spark, path), "lead_idx", "pos")


# -- Features, folds, scores ------------------------------------------------


def features_of_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = lead_features(leads(spark, sf_dir))
    return features.select(*LEAD, "n", *[rounded(c).alias(c) for c in FEATURES])


def features_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = record_features(lead_features(leads(spark, sf_dir)), N_LEADS)
    return wide.select("patient_id", *[rounded(c).alias(c) for c in wide.columns[1:]])


def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_leads(spark, sf_dir).select("patient_id", "label", "lead_idx")
    return assign_folds(rows, group="patient_id")


def group_kfold_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of the groups themselves; two labels hold all of them."""
    rows = labelled_leads(spark, sf_dir).select("patient_id", "label")
    return group_folds(rows, group="patient_id")


def _score(k: int) -> Column:
    """A number between 0 and 1 made of all values of a vector."""
    parts = F.transform("signal", lambda v, i: F.abs(v) * ((i + k) % 4 + 1) / 4)
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size("signal")


def _scores(spark: SparkSession, sf_dir: str, position: int) -> DataFrame:
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"), _score(position).alias("p")
    )


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = late_fusion(_scores(spark, sf_dir, 0), _scores(spark, sf_dir, 1))
    return both.withColumn("p", rounded("p"))


def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = confusion(table(spark, sf_dir, "labels"), "quality", "toxic")
    rates = ["sensitivity", "specificity", "accuracy"]
    return counts.select("tp", "fn", "fp", "tn", "n_unknown", *[rounded(c).alias(c) for c in rates])


def _odd_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and prediction with values outside 0 and 1, and gaps."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(label < 8, label - 1).cast("double").alias("label"),
        F.when(label == 5, float("nan")).when(label != 6, F.col("vec_id") % 3).alias("prediction"),
    )


def error_analysis_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_odd_labels(spark, sf_dir)).select("tp", "fn", "fp", "tn", "n_unknown")


def error_list_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misses(_odd_labels(spark, sf_dir), "id").select("id", "error")


def error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misses(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"s{k}" for k in range(4)]
    wide = stack_scores({name: _scores(spark, sf_dir, k) for k, name in enumerate(names)})
    return wide.select("id", *[rounded(name).alias(name) for name in names])


def score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and log loss of a score, by the raw label."""
    scored = vectors(spark, sf_dir).select(
        F.col("label").alias("source"),
        (F.col("vec_id") % 2).cast("int").alias("label"),
        F.least(_score(0) * 8, F.lit(0.99)).alias("p"),
    )
    return accuracy(scored, ["source"]).select(
        "source", "n", rounded("accuracy").alias("accuracy"), rounded("log_loss").alias("log_loss")
    )


def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return permute_column(rows, "label")


# -- Models -----------------------------------------------------------------


def _model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """A row per lead with its features, the label of the recording and the fold."""
    features = lead_features(leads(spark, sf_dir)).drop("n")
    meta = label_metadata(metadata(spark, sf_dir)).select("patient_id", "label")
    rows = assign_folds(features.join(meta, "patient_id"), group="patient_id")
    key = F.col("patient_id") * N_LEADS + F.col("lead_idx")
    return rows.withColumn("id", key), FEATURES


def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _model_rows(spark, sf_dir)
    return out_of_fold(rows, features)


def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _model_rows(spark, sf_dir)
    scores = {f"s{k}": _scores(spark, sf_dir, k) for k in range(4)}
    return stacking(scores, rows)


def ablation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _model_rows(spark, sf_dir)
    energy = [c for c in features if c.startswith("energy")]
    shape = [c for c in features if c not in energy]
    return ablation(rows, {"shape": shape, "energy": energy})


def oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once per model, with its fold and label and a score that is a probability."""
    return oof_scores(spark, sf_dir).select(
        "model", "id", "fold", "label", F.col("p").between(0, 1).alias("in_range")
    )


def stacking_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked_scores(spark, sf_dir).select(
        "model", "id", "fold", "label", F.col("p").between(0, 1).alias("in_range")
    )


def ablation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation_runs(spark, sf_dir).select("mode", "feature_group", "n_features", "model", "n")


def importance_of_a_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealing out the values of a constant column anew changes nothing."""
    rows, features = _model_rows(spark, sf_dir)
    rows = rows.withColumn("constant", F.lit(1.0))
    found = permutation_importance(rows, [*features, "constant"], columns=["constant"])
    return found.select(
        "feature", "n", *[rounded(c).alias(c) for c in ("accuracy_drop", "log_loss_rise")]
    )


def fit_at_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold learned from, and whether its model fulfils the conditions of an optimum."""
    rows, features = _model_rows(spark, sf_dir)
    return _optimum(fit_gaps(rows, features))


def stacking_at_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the model over other models' scores."""
    rows, _ = _model_rows(spark, sf_dir)
    scores = stack_scores({f"s{k}": _scores(spark, sf_dir, k) for k in range(4)})
    return _optimum(fit_gaps(scores.join(rows.select("id", "label", "fold"), "id"), [f"s{k}" for k in range(4)]))


def _optimum(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "fold",
        "n_train",
        rounded("rate").alias("rate"),
        (F.abs(F.col("mean_score") - F.col("rate")) < 1e-3).alias("mean_agrees"),
        (F.col("max_gradient") < 1e-3).alias("gradient_is_zero"),
    )


def _known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature that is the label itself and one that says nothing."""
    rows, _ = _model_rows(spark, sf_dir)
    return rows.select("id", "label", "fold", F.col("label").cast("double").alias("answer"), F.lit(1.0).alias("nothing"))


def ablation_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose result is known: trees on the answer alone, a regression on a constant alone."""
    runs = ablation(_known_rows(spark, sf_dir), {"answer": ["answer"], "nothing": ["nothing"]}, ("logistic", "forest"))
    sees_answer = ((F.col("mode") == "only") & (F.col("feature_group") == "answer")) | (
        (F.col("mode") == "without") & (F.col("feature_group") == "nothing")
    )
    known = runs.where((F.col("mode") != "all") & (sees_answer == (F.col("model") == "forest")))
    return known.select(
        "mode", "feature_group", "model", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("accuracy", "log_loss")]
    )


def importance_of_the_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that know the answer are wrong exactly where the donor's label is another one."""
    found = permutation_importance(_known_rows(spark, sf_dir), ["answer"], model="forest")
    return found.select(
        "feature", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("accuracy_drop", "log_loss_rise")]
    )


def report_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the data set from what is observed while it is written."""
    watched, path = Observed(), new_path(spark, "dataset")
    rows = dataset_rows(collated(spark, sf_dir), SHAPE)
    write_dataset(watched.watch(rows), path)
    return watched.report(read_dataset(spark, path), SHAPE)


def published_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of three runs: all patients, every third one again, and then some that have no rows any more."""
    root = new_path(spark, "published")
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 97).alias("group"), "vec_id", "label")
    publish(rows, root, "group")
    third = rows.where(F.col("group") % 3 == 0)
    publish(third.withColumn("label", F.col("label") + 100), root, "group")
    again = third.where(F.col("group") % 2 == 1).withColumn("label", F.col("label") + 200)
    publish(again, root, "group", keys=third.where("group < 30"))
    return read_published(spark, root, "group")


def dataset_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files in which every seventh recording occurs in a second folder: those give no rows."""
    headers, signals = record_files(spark, sf_dir)
    again = F.regexp_replace("path", "^files/", "copy/")
    seventh = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long") % 7 == 0
    headers = headers.unionByName(headers.where(seventh).withColumn("path", again))
    signals = signals.unionByName(signals.where(seventh).withColumn("path", again))
    return _dataset_of_files(spark, sf_dir, headers, signals)


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _model_rows(spark, sf_dir)
    return permutation_importance(rows, features)


QUERIES: dict[str, Query] = {
    "sample_index": sample_index,
    "sample_index_hot": sample_index_hot,
    "array_to_long": array_to_long,
    "long_to_array": long_to_array,
    "segment_events": segment_events,
    "segment_arrays": segment_arrays,
    "rate_rejects": rate_rejects,
    "float_cast": float_cast,
    "binarize_label": binarize,
    "cohort_summary": cohort,
    "head_profile": head,
    "record_profile": profile,
    "meta_join": meta_join,
    "missing_records": missing_records,
    "completeness": complete,
    "parse_segment_name": segment_names,
    "reject_bad_names": bad_names,
    "junk_files": junk_files,
    "label_fix": label_fix,
    "wavedec": wavelet_bands,
    "noise_sigma": noise,
    "universal_threshold": threshold,
    "soft_threshold": soft,
    "waverec": reconstruct,
    "denoise": denoised,
    "denoise_in_steps": threshold_all_bands,
    "clean_records": clean_records,
    "denoise_events": denoise_events,
    "preprocess": preprocess_records,
    "shape_valid": shape_valid,
    "shape_rejects": rejects,
    "dataset_rows": dataset_values,
    "dataset_sample_major": dataset_sample_major,
    "dataset_report": report,
    "metadata_scan": metadata_scan,
    "decode_recordings": decoded_recordings,
    "decode_chunks": decoded_chunks,
    "header_fields": header_fields,
    "decode_stretches": decode_stretches,
    "denoise_stretches": denoise_stretches,
    "equal_copies": equal_copies,
    "dataset_from_files": dataset_from_files,
    "dataset_with_copies": dataset_with_copies,
    "segment_table": segment_table,
    "dataset_table": dataset_table,
    "lead_features": features_of_leads,
    "record_features": features_of_records,
    "group_kfold": group_kfold,
    "group_kfold_hot": group_kfold_hot,
    "late_fusion": fused,
    "error_analysis": error_analysis,
    "error_list": error_list,
    "error_analysis_odd": error_analysis_odd,
    "error_list_odd": error_list_odd,
    "score_columns": score_columns,
    "score_quality": score_quality,
    "permute_column": permuted,
    "fit_at_optimum": fit_at_optimum,
    "stacking_at_optimum": stacking_at_optimum,
    "ablation_of_known": ablation_of_known,
    "importance_of_the_answer": importance_of_the_answer,
    "report_on_write": report_on_write,
    "published_patients": published_patients,
    "out_of_fold": oof_scores,
    "stacking": stacked_scores,
    "ablation": ablation_runs,
    "permutation_importance": importance,
    "out_of_fold_coverage": oof_coverage,
    "stacking_coverage": stacking_coverage,
    "ablation_sizes": ablation_sizes,
    "importance_of_a_constant": importance_of_a_constant,
}
