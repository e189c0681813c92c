"""Recordings: a text header and an interleaved 16-bit signal file each.

The header is read with Spark's string functions; only turning the bytes of a
signal file into numbers runs in Python, through Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.functions.columns import whole_div
from wavelead.operators.layout import CHUNK

# Fixed values of the header format: defaults for fields that are left out,
# and the 16-bit value that stands for a missing sample.
DEFAULT_RATE = 250.0
DEFAULT_GAIN = 200.0
MISSING_SAMPLE = -32768

# Fixed patterns of the header format.
RECORD_LINE = r"^\s*(\S+?)(/\d+)?\s+(\d+)(?=\s|$)"
RATE = r"^([0-9.eE+-]+)(/\S*)?$"
GAIN = r"^([0-9.eE+-]+)(\((-?\d+)\))?(/\S+)?$"
SIGNAL_LINE = (
    r"^(\S+)\s+(\d+)(x\d+)?(:\d+)?(?:\+(\d+))?"
    r"(?:\s+([0-9.eE+-]+)(?:\((-?\d+)\))?(?:/\S+)?)?"
    r"(?:\s+-?\d+)?(?:\s+(-?\d+))?(?:\s+-?\d+){0,3}(?:\s+(.*\S))?\s*$"
)


def _field(line: Column, pattern: str, group: int) -> Column:
    """A field of a line; null where it is left out."""
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def _word(line: Column, position: int) -> Column:
    """A word of a line, null if it has fewer."""
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(position))


def _unreadable(text: Column, number: Column) -> Column:
    """Whether a field is there but gives no number; one that is left out has a default."""
    return text.isNotNull() & (number.isNull() | F.isnan(number.cast("double")))


def _signal(line: Column, position: Column) -> Column:
    # What follows the format is the gain; a word that is none leaves the scale of the lead unknown.
    scale = _word(line, 2)
    gain = _field(scale, GAIN, 1).try_cast("double")
    gain = F.when(F.abs(gain) < float("inf"), gain)
    baseline, zero = _field(scale, GAIN, 3), _field(line, SIGNAL_LINE, 8)
    offset = _field(line, SIGNAL_LINE, 5)
    return F.struct(
        position.cast("int").alias("lead_idx"),
        _field(line, SIGNAL_LINE, 1).alias("file"),
        _field(line, SIGNAL_LINE, 2).alias("format"),
        F.concat(
            F.regexp_extract(line, SIGNAL_LINE, 3), F.regexp_extract(line, SIGNAL_LINE, 4)
        ).alias("layout"),
        F.coalesce(offset.try_cast("int"), F.lit(0)).alias("offset"),
        F.when(gain != 0, gain).otherwise(DEFAULT_GAIN).alias("gain"),
        F.coalesce(baseline.try_cast("int"), zero.try_cast("int"), F.lit(0)).alias("baseline"),
        _field(line, SIGNAL_LINE, 9).alias("lead"),
        F.when(_unreadable(offset, offset.try_cast("int")), "offset not understood")
        .when(
            _unreadable(baseline, baseline.try_cast("int")) | scale.rlike(r"\((?!-?\d+\)(/|$))"),
            "baseline not understood",
        )
        .when(_unreadable(scale, gain), "gain not understood")
        .when(_unreadable(zero, zero.try_cast("int")), "zero not understood")
        .alias("problem"),
    )


def parse_headers(headers: DataFrame) -> DataFrame:
    """One row per header file ``(path, content)``, with ``reason`` where it cannot be used.

    A field that is left out has its default. One that is there and cannot be
    read makes the recording unusable, as its samples or its time would be wrong.
    """
    lines = F.filter(
        F.split(F.decode("content", "ISO-8859-1"), r"\r?\n"),
        lambda line: ~line.rlike(r"^\s*(#|$)"),
    )
    first = F.get("lines", F.lit(0))
    rate, samples = _word(first, 2), _word(first, 3)
    rate_number = _field(rate, RATE, 1).try_cast("double")
    samples_number = F.when(samples.rlike(r"^\d+$"), samples.try_cast("long"))
    return (
        headers.select("path", lines.alias("lines"))
        .select(
            F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
            F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("record"),
            _field(first, RECORD_LINE, 2).alias("parts"),
            _field(first, RECORD_LINE, 3).try_cast("int").alias("n_leads"),
            F.when(rate.isNull(), F.lit(DEFAULT_RATE)).otherwise(rate_number).alias("fs"),
            F.nullif(samples_number, F.lit(0)).alias("n_samples"),
            F.when(_unreadable(rate, rate_number), "sampling rate not understood")
            .when(_unreadable(samples, samples_number), "number of samples not understood")
            .alias("problem"),
            F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), _signal).alias(
                "signals"
            ),
        )
        .withColumn("patient_id", F.col("record").try_cast("long"))
        .withColumn(
            "reason",
            F.when(F.col("patient_id").isNull(), "record name is not a patient number")
            .when(F.col("n_leads").isNull(), "record line not understood")
            .when(F.col("parts").isNotNull(), "recording in several parts")
            .when(
                (F.size("signals") != F.col("n_leads"))
                | (F.col("n_leads") == 0)
                | F.exists("signals", lambda s: s["file"].isNull()),
                "signal lines not understood",
            )
            .when(
                F.exists("signals", lambda s: (s["format"] != "16") | (s["layout"] != "")),
                "sample format not supported",
            )
            .otherwise(
                F.coalesce("problem", F.get(F.filter("signals.problem", lambda p: p.isNotNull()), F.lit(0)))
            ),
        )
        .drop("parts", "n_leads", "problem")
    )


def reject_repeated(headers: DataFrame) -> DataFrame:
    """Headers with a reason for all recordings of a patient who has more than one.

    Which of them counts can't be told; only the small header table is counted.
    """
    usable = headers.where(F.col("reason").isNull())
    repeated = usable.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = headers.join(repeated, "patient_id", "left")
    again = F.when(F.col("_n").isNotNull(), "patient has several recordings")
    return marked.select(
        *[c for c in headers.columns if c != "reason"], F.coalesce("reason", again).alias("reason")
    )


def match_signals(headers: DataFrame, signal_files: DataFrame) -> DataFrame:
    """One row per signal file of a recording, with ``content`` and ``reason``.

    ``signal_files`` has ``path``, ``length`` and, where Spark is to read it, ``content``.
    """
    headers = reject_repeated(headers)
    usable = F.col("reason").isNull()
    names = F.array_distinct(F.transform("signals", lambda s: s["file"]))
    expected = (
        headers.withColumn("n_files", F.size(names))
        .withColumn("file", F.explode_outer(F.when(usable, names)))
        .withColumn(
            "signals",
            F.when(usable, F.filter("signals", lambda s: s["file"] == F.col("file"))),
        )
        .withColumn("signal_path", F.concat_ws("/", "folder", "file"))
    )
    found = signal_files.withColumnRenamed("path", "signal_path")
    offset = F.get("signals", F.lit(0))["offset"]
    room = whole_div(F.col("length") - offset, 2 * F.size("signals"))
    return (
        expected.join(found, "signal_path", "left")
        .withColumn("offset", offset)
        .withColumn("n_samples", F.coalesce("n_samples", room))
        .withColumn(
            "reason",
            F.coalesce(
                "reason",
                F.when(F.col("length").isNull(), "signal file is missing").when(
                    room < F.col("n_samples"), "signal file is too short"
                ),
            ),
        )
    )


def physical_values(
    content: Column, offset: Column, n_samples: Column, gain: Column, baseline: Column
) -> Column:
    """Samples of every lead in physical units from the bytes of a signal file."""

    @F.arrow_udf("array<array<double>>")
    def run(
        content: pa.Array, offset: pa.Array, n_samples: pa.Array, gain: pa.Array, baseline: pa.Array
    ) -> pa.Array:
        leads, per_row = [], []
        columns = (offset, n_samples, gain, baseline)
        for data, first, n, gains, zeros in zip(content, *(c.to_pylist() for c in columns)):
            digital = np.frombuffer(
                data.as_buffer(), dtype="<i2", count=n * len(gains), offset=first
            ).reshape(n, len(gains))
            values = (digital - np.array(zeros, dtype=float)) / np.array(gains)
            leads.extend(np.where(digital == MISSING_SAMPLE, np.nan, values).T)
            per_row.append(len(gains))
        flat = np.concatenate(leads) if leads else np.empty(0)
        inner = pa.ListArray.from_arrays(_offsets([len(lead) for lead in leads]), pa.array(flat))
        return pa.ListArray.from_arrays(_offsets(per_row), inner)

    return run(content, offset, n_samples, gain, baseline)


def _offsets(lengths: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def decode_recordings(matched: DataFrame) -> DataFrame:
    """One row per signal file from the usable rows of :func:`match_signals`.

    ``lead_idx``, ``lead`` and ``signals`` are aligned arrays; ``n_files`` tells
    whether the row holds the recording as a whole. ``labels`` is passed on if
    the headers came with it.
    """
    passed = [c for c in ("labels",) if c in matched.columns]
    # Asking for the length makes the join an inner one, so that a small table
    # of headers may be broadcast and the signal files stay where they are read.
    usable = F.col("reason").isNull() & F.col("length").isNotNull()
    return matched.where(usable).select(
        "patient_id",
        "fs",
        "n_files",
        *passed,
        F.col("signals.lead_idx").alias("lead_idx"),
        F.col("signals.lead").alias("lead"),
        physical_values(
            F.col("content"),
            F.col("offset"),
            F.col("n_samples"),
            F.col("signals.gain"),
            F.col("signals.baseline"),
        ).alias("signals"),
    )


def decode_chunks(matched: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Long recordings: rows of up to ``chunk`` samples of a lead, ``signal``, from sample ``start`` on.

    No row holds a whole lead. ``arrays_to_samples`` turns the rows into the long
    layout, whose denoiser and windows take leads of any length.
    """
    usable = F.col("reason").isNull() & F.col("length").isNotNull()
    files = matched.where(usable).select(
        "patient_id",
        "fs",
        F.col("offset").cast("long").alias("offset"),
        F.col("n_samples").cast("long").alias("n_samples"),
        "signals.lead_idx",
        "signals.lead",
        "signals.gain",
        "signals.baseline",
        "content",
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *fields, contents = batch.columns
            rows = zip(*(c.to_pylist() for c in fields), contents)
            for patient, fs, offset, n, lead_idx, lead, gains, zeros, content in rows:
                width = len(lead_idx)
                digital = np.frombuffer(content.as_buffer(), "<i2", n * width, offset).reshape(n, width)
                for start in range(0, n, chunk):
                    part = digital[start : start + chunk]
                    values = (part - np.array(zeros, dtype=float)) / np.array(gains)
                    values = np.where(part == MISSING_SAMPLE, np.nan, values).T
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([patient] * width, pa.int64()),
                            pa.array([fs] * width, pa.float64()),
                            pa.array(lead_idx, pa.int32()),
                            pa.array(lead, pa.string()),
                            pa.array([start] * width, pa.int64()),
                            pa.array(list(values), pa.list_(pa.float64())),
                        ],
                        names=["patient_id", "fs", "lead_idx", "lead", "start", "signal"],
                    )

    return files.mapInArrow(
        decode, "patient_id long, fs double, lead_idx int, lead string, start long, signal array<double>"
    )


def lead_rows(decoded: DataFrame) -> DataFrame:
    """``lead_signal`` rows, one per lead, with the other columns passed on."""
    arrays = ["lead_idx", "lead", "signals"]
    kept = [c for c in decoded.columns if c not in (*arrays, "n_files")]
    return decoded.select(*kept, F.explode(F.arrays_zip(*arrays)).alias("s")).select(
        *kept,
        F.col("s.lead_idx").alias("lead_idx"),
        F.col("s.lead").alias("lead"),
        F.col("s.signals").alias("signal"),
    )


def recording_rejects(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("reason").isNotNull()).select(
        "folder", "record", "file", "reason"
    )


def whole_recordings(decoded: DataFrame) -> DataFrame:
    """One row per recording with all its leads, from one row per signal file.

    A recording kept in one file passes without a shuffle. The files of the
    others come together in one row: no more than the header names, as repeated
    recordings have been rejected. Rows of ``signals.read_whole`` hold whole
    recordings already.
    """
    if "n_files" not in decoded.columns:
        return decoded
    arrays = ["lead_idx", "lead", "signals"]
    keys = [c for c in decoded.columns if c not in arrays]
    spread = (
        decoded.where(F.col("n_files") > 1)
        .groupBy(*keys)
        .agg(F.flatten(F.collect_list(F.arrays_zip(*arrays))).alias("_leads"))
        .withColumn("_leads", F.array_sort("_leads"))
        .select(*keys, *[F.col(f"_leads.{c}").alias(c) for c in arrays])
    )
    return decoded.where(F.col("n_files") == 1).select(*keys, *arrays).unionByName(spread)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed headers anywhere below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return parse_headers(files.option("pathGlobFilter", "*.hea").load(path))


def match_recordings(
    spark: SparkSession,
    path: str,
    signal_glob: str = "*.dat",
    labels: DataFrame | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Headers and signal files anywhere below ``path``, matched.

    ``labels`` has one row per ``patient_id`` with the array ``labels``. It is
    joined to the headers, which are small, so that the signals need no join
    with the metadata later on. ``headers`` are those of :func:`read_headers`,
    if they have been read before.

    Spark leaves out files and folders whose name starts with ``.`` or ``_``,
    which covers what archives of other systems leave behind. Files of zero
    bytes are left out as well, so an empty header counts as a missing recording.
    """
    signals = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", signal_glob)
        .load(path)
        .drop("modificationTime")
    )
    parsed = read_headers(spark, path) if headers is None else headers
    if labels is not None:
        parsed = parsed.join(labels, "patient_id", "left")
    return match_signals(parsed, signals)


def read_recordings(spark: SparkSession, path: str, signal_glob: str = "*.dat") -> DataFrame:
    """``lead_signal`` rows of all usable recordings below ``path``."""
    return lead_rows(decode_recordings(match_recordings(spark, path, signal_glob)))
