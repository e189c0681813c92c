"""Signal files read where their header points.

Tasks over the rows of headers open the signal files themselves and read the
bytes that they need: all files of a recording for :func:`read_whole`, stretches
of whole samples for :func:`read_stretches`. So no bytes are joined or shuffled,
every byte is read once, and a file may be larger than what a row holds.

The paths have to open on the executors with ``pyarrow.fs`` (local and mounted
folders, ``hdfs``, ``s3``, ``gs``); for other schemes pass a reader of your own.
``match_recordings`` in :mod:`recordings`, which has Spark read the contents,
needs no such access.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.functions.columns import whole_div
from wavelead.operators.layout import CHUNK
from wavelead.sources.recordings import MISSING_SAMPLE, match_signals, read_headers
from wavelead.storage import materialize

# Reads ``size`` bytes of a file from ``start`` on.
Reader = Callable[[str, int, int], bytes]
# Bytes that a task reads before it hands on what it has, and bytes for one task.
BATCH_BYTES = 16 << 20
TASK_BYTES = 128 << 20

_WHOLE = "patient_id long, fs double, lead_idx array<int>, lead array<string>, signals array<array<double>>"
_STRETCH = "patient_id long, fs double, lead_idx int, lead string, start long, signal array<double>"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def read_bytes(path: str, start: int, size: int) -> bytes:
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        return file.read_at(size, start)


def list_signals(spark: SparkSession, path: str, signal_glob: str = "*.dat") -> DataFrame:
    """Path and length of the signal files below ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return files.option("pathGlobFilter", signal_glob).load(path).select("path", "length")


def locate_recordings(
    spark: SparkSession,
    path: str,
    signal_glob: str = "*.dat",
    labels: DataFrame | None = None,
    headers: DataFrame | None = None,
    equal_copies: bool = False,
    read: Reader = read_bytes,
) -> DataFrame:
    """Headers below ``path`` with the place of their signals: one row per signal file, or with a ``reason``.

    The same table as ``recordings.match_recordings`` gives, but with the path
    of a signal file in place of its content. With ``equal_copies`` a patient's
    recordings that are the same byte for byte count once (:func:`keep_one_copy`);
    otherwise all recordings of a patient who has several are rejected.
    """
    parsed = read_headers(spark, path) if headers is None else headers
    files = list_signals(spark, path, signal_glob)
    if equal_copies:
        parsed = keep_one_copy(parsed, files, read)
    if labels is not None:
        parsed = parsed.join(labels, "patient_id", "left")
    return match_signals(parsed, files)


def keep_one_copy(headers: DataFrame, files: DataFrame, read: Reader = read_bytes) -> DataFrame:
    """Headers with a reason for all but one of the equal recordings of a patient.

    Only the recordings of patients who have several are looked at: tasks read
    their signal files in stretches and take a hash of what the header says of a
    file and of its samples. If all recordings of a patient have the same hashes,
    the one in the first folder counts. If they contradict each other, or one
    cannot be read, all are left to be rejected.
    """
    usable = headers.where("reason IS NULL")
    several = usable.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("patient_id")
    # Each recording by itself, so that match_signals does not reject them for being several.
    alone = usable.join(several, "patient_id", "left_semi").withColumn("real_id", F.col("patient_id"))
    alone = alone.withColumn("patient_id", F.xxhash64("folder", "record"))
    located = materialize(match_signals(alone, files), "copies")
    said = F.to_json(F.struct("fs", "n_samples", "offset", F.transform("signals", lambda s: s.dropFields("file"))))
    names = ["real_id", "folder", "record", "reason"]
    parts = (
        located.select(
            *names,
            F.col("signals.lead_idx").alias("leads"),
            said.alias("said"),
            "signal_path",
            F.col("offset").cast("long").alias("start"),
            (2 * F.col("n_samples").cast("long") * F.size("signals")).alias("size"),
        )
    )

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for row in batch.to_pylist():
                whole = hashlib.sha256((row["said"] or "").encode())
                if row["reason"] is None:
                    for at in range(0, row["size"], BATCH_BYTES):
                        whole.update(_exactly(read, row["signal_path"], row["start"] + at, min(BATCH_BYTES, row["size"] - at)))
                prints.append(whole.hexdigest() if row["reason"] is None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("real_id", "folder", "record", "leads")] + [pa.array(prints, pa.string())],
                names=["real_id", "folder", "record", "leads", "print"],
            )

    prints = _spread(parts, "size").mapInArrow(
        fingerprint, "real_id long, folder string, record string, leads array<int>, print string"
    )
    # A few hashes for each recording, in the order of their leads.
    recordings = prints.groupBy("real_id", "folder", "record").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("leads", "print")))).alias("prints"),
        F.max(F.col("print").isNull()).alias("unread"),
    )
    verdicts = recordings.groupBy("real_id").agg(
        F.min("prints").alias("low"),
        F.max("prints").alias("high"),
        F.max("unread").alias("unread"),
        F.min(F.struct("folder", "record")).alias("first"),
    )
    equal = verdicts.where("low = high AND NOT unread").select(F.col("real_id").alias("patient_id"), "first")
    kept = headers.join(equal, "patient_id", "left")
    copy = F.col("first").isNotNull() & (F.struct("folder", "record") != F.col("first"))
    reason = F.coalesce("reason", F.when(copy, "copy of another recording"))
    return kept.select(*[c for c in headers.columns if c != "reason"], reason.alias("reason"))


def _physical(data: bytes, gains: list[float], zeros: list[int]) -> np.ndarray:
    """Leads x samples in physical units, from whole interleaved samples."""
    digital = np.frombuffer(data, "<i2").reshape(-1, len(gains))
    values = (digital - np.array(zeros, dtype=float)) / np.array(gains)
    return np.where(digital == MISSING_SAMPLE, np.nan, values).T


def _exactly(read: Reader, path: str, start: int, size: int) -> bytes:
    data = read(path, start, size)
    if len(data) != size:
        raise OSError(f"{path} has changed: {len(data)} of {size} bytes from {start} on")
    return data


def _spread(rows: DataFrame, size: str) -> DataFrame:
    """Small rows dealt so that a task has about ``TASK_BYTES`` to read; the column ``size`` has their bytes."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(max(1, -(-total // TASK_BYTES), min(total, rows.sparkSession.sparkContext.defaultParallelism)))


def read_whole(located: DataFrame, read: Reader = read_bytes) -> DataFrame:
    """One row per recording with all its leads in ``signals``; ``labels`` is passed on if there.

    A task reads all files of a recording, so recordings that are kept in
    several files need no join. A recording of which any file has a ``reason``
    is left out as a whole: it is among the rejects.
    """
    passed = [c for c in ("labels",) if c in located.columns]
    file = F.struct(
        "signal_path",
        F.col("offset").cast("long").alias("offset"),
        F.col("n_samples").cast("long").alias("n_samples"),
        F.col("signals.lead_idx").alias("lead_idx"),
        F.col("signals.lead").alias("lead"),
        F.col("signals.gain").alias("gain"),
        F.col("signals.baseline").alias("baseline"),
    )
    # No more rows than signal files, each with a few numbers for a lead.
    recordings = (
        located.groupBy("folder", "record", "patient_id", "fs", *passed)
        .agg(
            F.max("reason").alias("reason"),
            F.collect_list(file).alias("files"),
            F.sum(2 * F.col("n_samples") * F.size("signals")).alias("size"),
        )
        .where("reason IS NULL")
        .select("patient_id", "fs", *passed, "files", "size")
    )
    # What is passed on keeps its Arrow type.
    n = 2 + len(passed)
    schema = _WHOLE + "".join(f", {c} {recordings.schema[c].dataType.simpleString()}" for c in passed)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(n).to_pylist()
            held, first, size = [], 0, 0
            for k, files in enumerate(rows):
                leads = []
                for f in files:
                    part = 2 * f["n_samples"] * len(f["gain"])
                    data = _exactly(read, f["signal_path"], f["offset"], part)
                    leads += zip(f["lead_idx"], f["lead"], _physical(data, f["gain"], f["baseline"]))
                    size += part
                held.append(sorted(leads, key=lambda lead: lead[0]))
                if size >= BATCH_BYTES or k == len(rows) - 1:
                    yield whole(batch.slice(first, k + 1 - first), held)
                    held, first, size = [], k + 1, 0

    def whole(batch: pa.RecordBatch, recordings: list[list[tuple]]) -> pa.RecordBatch:
        flat = [lead for leads in recordings for lead in leads]
        values = pa.array(np.concatenate([np.zeros(0), *(lead[2] for lead in flat)]))
        signals = pa.ListArray.from_arrays(_offsets(len(lead[2]) for lead in flat), values)
        of_recording = _offsets(map(len, recordings))
        columns = [
            batch.column(0),
            batch.column(1),
            *(
                pa.ListArray.from_arrays(of_recording, c)
                for c in (
                    pa.array([lead[0] for lead in flat], pa.int32()),
                    pa.array([lead[1] for lead in flat], pa.string()),
                    signals,
                )
            ),
            *(batch.column(k) for k in range(2, n)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["patient_id", "fs", "lead_idx", "lead", "signals", *passed])

    return _spread(recordings, "size").mapInArrow(decode, schema)


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(list(sizes))]).astype(np.int32))


def read_stretches(located: DataFrame, chunk: int = CHUNK, read: Reader = read_bytes) -> DataFrame:
    """Rows of up to ``chunk`` samples of a lead, ``signal``, from sample ``start`` on, whatever the length of a file.

    A file is cut into stretches before anything is read, and the stretches are
    dealt over the tasks, so many tasks read a long file. They are whole
    multiples of ``chunk`` samples but for the last one of a file.
    """
    usable = located.where("reason IS NULL").select(
        "patient_id",
        "fs",
        F.col("offset").cast("long").alias("offset"),
        F.col("n_samples").cast("long").alias("n_samples"),
        "signals.lead_idx",
        "signals.lead",
        "signals.gain",
        "signals.baseline",
        "signal_path",
    )
    width = 2 * F.size("lead_idx")
    step = chunk * F.greatest(F.lit(1), whole_div(F.lit(BATCH_BYTES), chunk * width))
    count = whole_div(F.col("n_samples") + step - 1, step)
    first = F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)))
    stretches = (
        usable.withColumn("k", first)
        .withColumn("first", F.col("k") * step)
        .withColumn("n", F.least(step, F.col("n_samples") - F.col("first")))
        .withColumn("size", F.col("n") * width)
        .select("patient_id", "fs", "lead_idx", "lead", "gain", "baseline", "signal_path", "offset", "first", "n", "size")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leads = len(row["lead_idx"])
                start = row["offset"] + 2 * leads * row["first"]
                data = _exactly(read, row["signal_path"], start, row["size"])
                values = _physical(data, row["gain"], row["baseline"])
                for at in range(0, row["n"], chunk):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["patient_id"]] * leads, pa.int64()),
                            pa.array([row["fs"]] * leads, pa.float64()),
                            pa.array(row["lead_idx"], pa.int32()),
                            pa.array(row["lead"], pa.string()),
                            pa.array([row["first"] + at] * leads, pa.int64()),
                            pa.array(list(values[:, at : at + chunk]), pa.list_(pa.float64())),
                        ],
                        names=["patient_id", "fs", "lead_idx", "lead", "start", "signal"],
                    )

    return _spread(stretches, "size").mapInArrow(decode, _STRETCH)
