"""The driver's tables seen as recordings, metadata, samples and file names.

Every view covers its whole table: twelve consecutive vectors form a recording
of twelve leads, the events of a user form a recording of one lead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.functions.columns import whole_div
from wavelead.operators.layout import index_samples
from wavelead.operators.records import label_metadata
from wavelead.sources.signals import file_system
from wavelead.storage import new_path

N_LEADS = 12
RATE = 8.0
# Three seconds at this rate.
WINDOW = 24
SHAPE = (WINDOW, N_LEADS)
EVENT_WINDOW = 30
EVENT_CHUNK = 64
USER = ["user_id"]
# Long leads: all events of a type, in chunks much shorter than the lead.
TYPE = ["event_type"]
LONG_CHUNK = 1024
HALO = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("signal"), "label"
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead_idx = (F.col("vec_id") % N_LEADS).cast("int")
    return vectors(spark, sf_dir).select(
        whole_div(F.col("vec_id"), N_LEADS).alias("patient_id"),
        F.lit(RATE).alias("fs"),
        lead_idx.alias("lead_idx"),
        F.concat(F.lit("lead_"), lead_idx).alias("lead"),
        "signal",
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording; its diagnosis is the label of its first lead."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(whole_div(F.col("vec_id"), N_LEADS).alias("patient_id"))
        .agg(F.min_by("label", "vec_id").alias("brugada"))
    )


def labelled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = label_metadata(metadata(spark, sf_dir)).select("patient_id", "label")
    return leads(spark, sf_dir).join(meta, "patient_id")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples ``(user_id, i, value)`` in the order of time."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return index_samples(events, ["ts", "event_id"], USER)


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples ``(event_type, i, value)``: few leads of many samples each."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return index_samples(events, ["ts", "event_id"], TYPE)


def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name per vector; some names and folders are not what they should be."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("string")
    patient = whole_div(vec_id, N_LEADS).cast("string")
    suffix = F.when(F.col("label") == 9, ".txt").otherwise(".npy")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") == 8, "unknown").otherwise(patient).alias("folder"),
        F.when(F.col("label") == 7, F.concat(patient, F.lit("-seg"), vec_id, suffix))
        .when(F.col("label") == 6, F.concat(patient, F.lit("_x_seg"), vec_id, suffix))
        .otherwise(F.concat(patient, F.lit("_"), label, F.lit("_seg"), vec_id, suffix))
        .alias("name"),
    )


def record_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Header files and signal files holding every vector as a record of four leads."""
    stem = F.concat(F.lit("files/"), "vec_id", F.lit("/"), "vec_id")
    files = vectors(spark, sf_dir)
    line = F.concat("vec_id", F.lit(".dat 16 1000(50)/mV 16 0 0 0 0 "))
    content = F.concat_ws(
        "\n",
        F.lit("# derived"),
        F.concat("vec_id", F.lit(" 4 8 "), F.floor(F.size("signal") / 4)),
        *[F.concat(line, F.lit(name)) for name in ("I", "II", "V1", "V2")],
    )
    headers = files.select(
        F.concat(stem, F.lit(".hea")).alias("path"), F.encode(content, "UTF-8").alias("content")
    )
    signals = files.select(
        F.concat(stem, F.lit(".dat")).alias("path"),
        F.unhex(F.array_join(_words(F.col("signal")), "")).alias("content"),
    ).withColumn("length", F.length("content").cast("long"))
    return headers, signals


def _words(signal: Column) -> Column:
    """Values as little-endian 16-bit words in hexadecimal, at a gain of 1000 and a baseline of 50."""
    return F.transform(
        F.transform(signal, lambda v: (F.round(v * 1000) + 50).cast("int")),
        lambda d: F.format_string(
            "%02x%02x", F.pmod(d, F.lit(256)), F.floor(F.pmod(d, F.lit(65536)) / 256)
        ),
    )


def odd_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of ``record_files``, of which some have a field that cannot be read."""
    headers, _ = record_files(spark, sf_dir)
    text = F.decode("content", "UTF-8")
    rest = F.regexp_extract("path", r"(\d+)\.hea$", 1).cast("long") % 11

    def changed(old: str, new: str) -> Column:
        return F.regexp_replace(text, old, new)

    odd = (
        F.when(rest == 1, changed(r"1000\(50\)", "1-000(50)"))
        .when(rest == 2, changed(r"1000\(50\)", "1000(5x)"))
        .when(rest == 3, changed(r" 4 8 ", " 4 8.0.0 "))
        .when(rest == 4, changed(r" 4 8 (\d)\d*", " 4 8 $1e1"))
        .when(rest == 5, changed(r"\.dat 16 ", ".dat 16+99999999999 "))
        .when(rest == 6, changed(r"1000\(50\)/mV 16 0", "1000/mV 16 99999999999"))
        .when(rest == 7, changed(r"1000\(50\)", "high(50)"))
        .otherwise(text)
    )
    return headers.withColumn("content", F.encode(odd, "UTF-8"))


# Vectors in a long recording; their values one after another are its interleaved samples.
LONG_VECTORS = 768


def long_record_files(spark: SparkSession, sf_dir: str, size: int = LONG_VECTORS, copies: bool = False) -> str:
    """A folder of headers and signal files that hold ``size`` vectors each; the path.

    With ``copies`` every second recording is there once more as it is, and every
    third with other samples.
    """
    long = (
        vectors(spark, sf_dir)
        .groupBy(whole_div(F.col("vec_id"), size).alias("patient"))
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", _words(F.col("signal")).alias("words")))).alias("v"))
        .select("patient", F.flatten("v.words").alias("words"), F.lit("a").alias("place"))
    )
    if copies:
        other = F.concat(F.slice("words", 2, F.size("words")), F.slice("words", 1, 1))
        long = (
            long.unionByName(long.where("patient % 2 = 0").withColumn("place", F.lit("b")))
            .unionByName(long.where("patient % 3 = 0").withColumn("place", F.lit("c")).withColumn("words", other))
        )
    lines = [
        F.concat("patient", F.lit(f" {N_LEADS} 8 "), whole_div(F.size("words"), N_LEADS)),
        *[F.concat("patient", F.lit(f".dat 16 1000(50)/mV 16 0 0 0 0 lead_{j}")) for j in range(N_LEADS)],
    ]
    files = long.select(
        F.explode(
            F.array(
                F.struct(F.lit("hea").alias("kind"), F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("content")),
                F.struct(F.lit("dat").alias("kind"), F.unhex(F.array_join("words", "")).alias("content")),
            )
        ).alias("f"),
        "patient",
        "place",
    ).select(F.concat("place", F.lit("/"), "patient", F.lit("."), "f.kind").alias("name"), "f.content")
    folder = new_path(spark, "recordings")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = file_system(f"{folder}/{name}")
                system.create_dir(place.rpartition("/")[0])
                with system.open_output_stream(place) as file:
                    file.write(content)
            yield batch.select(["name"])

    files.mapInArrow(write, "name string").count()
    return folder
