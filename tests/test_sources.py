import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelead.functions.wavelet import denoise_block
from wavelead.plans.prepare import judged_windows, prepare
from wavelead.sources.metadata import CORRUPT, read_metadata, split_metadata
from wavelead.operators.denoising import denoise_samples
from wavelead.operators.layout import arrays_to_samples
from wavelead.sources.recordings import (
    decode_chunks,
    decode_recordings,
    match_recordings,
    parse_headers,
    read_recordings,
    recording_rejects,
)
from wavelead.sources.tables import (
    read_dataset,
    read_segments,
    write_segments,
)


def write_record(folder, name, digital, gains, baselines=None, fs=100, lead_names=None, extra=""):
    """A header and one 16-bit signal file; ``digital`` is samples x leads."""
    folder.mkdir(parents=True, exist_ok=True)
    n, k = len(digital), len(digital[0])
    lines = [f"{name} {k} {fs} {n}"]
    for j in range(k):
        base = f"({baselines[j]})" if baselines else ""
        lead = lead_names[j] if lead_names else f"L{j}"
        lines.append(f"{name}.dat 16 {gains[j]}{base}/mV 16 0 {digital[0][j]} 0 0 {lead}")
    (folder / f"{name}.hea").write_text("\n".join(lines) + "\n" + extra)
    flat = [v for row in digital for v in row]
    (folder / f"{name}.dat").write_bytes(struct.pack(f"<{len(flat)}h", *flat))


def test_metadata(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text('site,brugada,patient_id\n"a, b",1,7\nc,,8\nd,2.0,9\ne,x,10\n')
    narrow = read_metadata(spark, str(path)).select("patient_id", "brugada")
    rows = narrow.orderBy("patient_id").collect()
    assert [tuple(r) for r in rows] == [(7, 1.0), (8, None), (9, 2.0), (10, None)]
    wide = read_metadata(spark, str(path), corrupt="_bad")
    rows = {r["patient_id"]: r for r in wide.collect()}
    assert rows[7]["site"] == "a, b" and rows[7]["_bad"] is None
    assert rows[10]["_bad"] == "e,x,10"
    path.write_text("age,patient_id,brugada\n50,1,0\n")
    typed = read_metadata(spark, str(path), extra="age int")
    assert [r.asDict() for r in typed.collect()] == [{"age": 50, "patient_id": 1, "brugada": 0.0}]
    path.write_text("patient_id\n1\n")
    with pytest.raises(ValueError):
        read_metadata(spark, str(path))


def test_metadata_of_several_headers(spark, tmp_path):
    folder = tmp_path / "meta data"
    folder.mkdir()
    (folder / "a.csv").write_text("patient_id,brugada\n1,0\n")
    (folder / "b.csv").write_text("brugada,site,patient_id\n1,x,2\ntype1,y,3\n,z,4\n1,q,\n")
    (folder / "c.csv").write_text("patient_id,brugada\n5,2\n")
    good, bad = split_metadata(read_metadata(spark, str(folder), corrupt=CORRUPT))
    rows = {r["patient_id"]: (r["brugada"], r["site"]) for r in good.collect()}
    assert rows == {1: (0.0, None), 2: (1.0, "x"), 4: (None, "z"), 5: (2.0, None)}
    assert {(r["line"], r["reason"]) for r in bad.collect()} == {
        ("type1,y,3", "line not understood"),
        (None, "patient number is missing"),
    }


def test_recordings(spark, tmp_path):
    write_record(tmp_path / "1", "1", [[100, -5], [-32768, 7], [0, 1]], [200, 10], [10, 0])
    write_record(tmp_path / "2", "2", [[1], [2]], [0], fs="50/1(0)", lead_names=["aVR x"])
    rows = {(r["patient_id"], r["lead_idx"]): r for r in read_recordings(spark, str(tmp_path)).collect()}
    assert len(rows) == 3
    first = rows[1, 0]["signal"]
    assert first[0] == (100 - 10) / 200 and math.isnan(first[1]) and first[2] == -10 / 200
    assert rows[1, 1]["signal"] == [-0.5, 0.7, 0.1]
    assert rows[1, 0]["fs"] == 100.0 and rows[1, 1]["lead"] == "L1"
    # No gain means the default gain.
    assert rows[2, 0]["signal"] == [1 / 200, 2 / 200]
    assert rows[2, 0]["fs"] == 50.0 and rows[2, 0]["lead"] == "aVR x"


def test_header_fields(spark):
    text = (
        "# made by hand\r\n"
        "5 3\r\n"
        "a.dat 16\r\n"
        "a.dat 16+24 100.5(-3)/uV 12 7 1 2 3 lead two\r\n"
        "a.dat 16 5/mV 12 7\r\n"
        "# more\r\n"
    )
    df = spark.createDataFrame([("d/5.hea", text.encode())], "path string, content binary")
    row = parse_headers(df).first()
    assert row["reason"] is None and row["fs"] == 250.0 and row["n_samples"] is None
    plain, full, zero = row["signals"]
    assert (plain["gain"], plain["baseline"], plain["offset"], plain["lead"]) == (200.0, 0, 0, None)
    assert (full["gain"], full["baseline"], full["offset"]) == (100.5, -3, 24)
    assert full["lead"] == "lead two"
    # Without a baseline the zero of the converter stands in.
    assert zero["baseline"] == 7


def test_unusable_recordings_have_a_reason(spark, tmp_path):
    write_record(tmp_path / "1", "1", [[1, 2], [3, 4]], [1, 1])
    write_record(tmp_path / "2", "2", [[1, 2], [3, 4]], [1, 1])
    (tmp_path / "2" / "2.dat").write_bytes(b"\0" * 6)
    write_record(tmp_path / "x", "x", [[1], [2]], [1])
    write_record(tmp_path / "3", "3", [[1], [2]], [1])
    (tmp_path / "3" / "3.dat").rename(tmp_path / "3" / "other.dat")
    for name, header in {
        "4": "4 1 100 2\n4.dat 212 1 16 0 0 0 0 I\n",
        "5": "5 2 100 2\n5.dat 16 1 16 0 0 0 0 I\n",
        "6": "6/2 1 100 2\n6a 2\n6b 2\n",
        "7": "# nothing\n",
        "8": "8 1 100 2\n8.dat 16x2 1 16 0 0 0 0 I\n",
    }.items():
        (tmp_path / f"{name}.hea").write_text(header)
    matched = match_recordings(spark, str(tmp_path))
    assert {r["record"]: r["reason"] for r in recording_rejects(matched).collect()} == {
        "2": "signal file is too short",
        "x": "record name is not a patient number",
        "3": "signal file is missing",
        "4": "sample format not supported",
        "5": "signal lines not understood",
        "6": "recording in several parts",
        "7": "record line not understood",
        "8": "sample format not supported",
    }
    assert [r["patient_id"] for r in read_recordings(spark, str(tmp_path)).collect()] == [1, 1]


def test_left_over_files_are_not_read(spark, tmp_path):
    write_record(tmp_path / "1", "1", [[1], [2]], [1])
    write_record(tmp_path / "__MACOSX", "2", [[1], [2]], [1])
    (tmp_path / "1" / "._1.hea").write_text("junk")
    (tmp_path / "1" / ".DS_Store").write_text("junk")
    assert match_recordings(spark, str(tmp_path)).count() == 1


def test_several_signal_files(spark, tmp_path):
    (tmp_path / "9.hea").write_text(
        "9 3 100 2\na.dat 16 1 16 0 0 0 0 I\na.dat 16 1 16 0 0 0 0 II\nb.dat 16 2 16 0 0 0 0 III\n"
    )
    (tmp_path / "a.dat").write_bytes(struct.pack("<4h", 1, 2, 3, 4))
    (tmp_path / "b.dat").write_bytes(struct.pack("<2h", 10, 20))
    rows = read_recordings(spark, str(tmp_path)).orderBy("lead_idx").collect()
    assert [(r["lead_idx"], r["lead"], r["signal"]) for r in rows] == [
        (0, "I", [1.0, 3.0]),
        (1, "II", [2.0, 4.0]),
        (2, "III", [5.0, 10.0]),
    ]


def test_segment_table_ignores_other_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, 0, 0, "I", [1.0, 2.0])],
        "patient_id long, label int, seg_idx int, lead_idx int, lead string, samples array<float>",
    )
    path = tmp_path / "segments"
    write_segments(df, str(path / "1"))
    (path / "note.txt").write_text("not a segment")
    assert read_segments(spark, str(path)).collect() == df.collect()
    # Writing again replaces, it does not add.
    write_segments(df.withColumn("label", F.lit(1)), str(path / "1"))
    assert [r["label"] for r in read_segments(spark, str(path)).collect()] == [1]


def test_the_whole_way(spark, tmp_path):
    """Files in, data set out, against a plain calculation."""
    rng = np.random.default_rng(4)
    raw, out = tmp_path / "raw", tmp_path / "out"
    signals = {p: rng.integers(-900, 900, size=(n, 12)) for p, n in {1: 700, 2: 601, 3: 299}.items()}
    signals[4] = rng.integers(-900, 900, size=(650, 11))
    for p, digital in signals.items():
        write_record(raw / "files" / str(p), str(p), digital.tolist(), [200] * digital.shape[1])
    # Patient 5: the same kind of recording spread over two signal files.
    digital = rng.integers(-900, 900, size=(300, 12))
    folder = raw / "files" / "5"
    folder.mkdir()
    names = ["a.dat"] * 8 + ["b.dat"] * 4
    lines = ["5 12 100 300"] + [f"{f} 16 200/mV 16 0 0 0 0 L{j}" for j, f in enumerate(names)]
    (folder / "5.hea").write_text("\n".join(lines))
    (folder / "a.dat").write_bytes(digital[:, :8].astype("<i2").tobytes())
    (folder / "b.dat").write_bytes(digital[:, 8:].astype("<i2").tobytes())
    signals[5] = digital
    (raw / "metadata.csv").write_text("patient_id,brugada\n1,0\n2,2\n3,1\n4,0\n5,1\n")

    report = prepare(
        spark, str(raw / "metadata.csv"), str(raw / "files"), str(out), keep_segments=True
    ).first()
    assert report["n_rows"] == 5 and report["ok"]
    dataset = read_dataset(spark, str(out / "windows" / "kind=dataset"))
    rows = {(r["group"], r["seg_idx"]): r for r in dataset.collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (2, 0), (2, 1), (5, 0)]
    for (p, k), row in rows.items():
        clean = denoise_block(signals[p].T / 200.0)
        expected = clean[:, 300 * k : 300 * (k + 1)].astype("float32")
        assert np.allclose(np.array(row["x"]), expected, atol=1e-6)
        assert row["label"] == {1: 0, 2: 1, 5: 1}[p]
    rejects = spark.read.parquet(str(out / "shape_rejects")).collect()
    assert {(r["patient_id"], r["reason"]) for r in rejects} == {(4, "shape (300, 11)")}
    profile = {r["patient_id"]: r for r in spark.read.parquet(str(out / "profile")).collect()}
    assert profile[3]["n_segments"] == 0 and profile[2]["n_samples"] == 601
    assert read_segments(spark, str(out / "segments")).count() == (2 + 2) * 12 + 2 * 11 + 12

    def reasons(table):
        return {tuple(r) for r in spark.read.parquet(str(out / table)).collect()}

    # A copied folder, a diagnosis that is no number, a recording without metadata, an endless rate.
    write_record(raw / "files" / "copy" / "1", "1", signals[1].tolist(), [200] * 12)
    write_record(raw / "files" / "6", "6", signals[2].tolist(), [200] * 12, fs="1e10")
    (raw / "metadata.csv").write_text("patient_id,brugada\n1,0\n2,2\n3,type1\n4,0\n5,1\n6,0\n")
    report = prepare(spark, str(raw / "metadata.csv"), str(raw / "files"), str(out)).first()
    assert report["ok"] and report["n_rows"] == report["n_segments"] == 3
    assert {(r[1], r[3]) for r in reasons("recording_rejects")} == {("1", "patient has several recordings")}
    assert {r[-1] for r in reasons("metadata_rejects")} == {"line not understood"}
    assert {r[0] for r in reasons("unlabelled_recordings")} == {3}
    assert {r[0] for r in reasons("rate_rejects")} == {6}
    assert {r["patient_id"] for r in spark.read.parquet(str(out / "profile")).collect()} == {2, 3, 4, 5, 6}

    (raw / "metadata.csv").write_text("patient_id,brugada\n1,0\n77,1\n")
    with pytest.raises(FileNotFoundError):
        prepare(spark, str(raw / "metadata.csv"), str(raw / "files"), str(out))


def test_signals_are_cleaned_once(spark, tmp_path):
    """One step of Python functions in the plan of all windows: decoding with cleaning."""
    write_record(tmp_path / "1", "1", [[1] * 12] * 700, [200] * 12)
    labels = spark.createDataFrame([(1, [0])], "patient_id long, labels array<int>")
    decoded = decode_recordings(match_recordings(spark, str(tmp_path), labels=labels))
    windows = judged_windows(decoded.where("n_files = 1"))
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert windows.where("kind = 'dataset'").count() == 2


def test_long_recordings_in_chunks(spark, tmp_path):
    """Decoded and denoised chunk by chunk, a lead comes out as if it were one row."""
    rng = np.random.default_rng(3)
    digital = rng.integers(-500, 500, size=(2600, 2)).cumsum(axis=0) // 40
    digital[1700, 1] = -32768
    write_record(tmp_path / "1", "1", digital.tolist(), [200, 100], [5, 0])
    chunks = decode_chunks(match_recordings(spark, str(tmp_path)), chunk=1000)
    assert sorted(len(r["signal"]) for r in chunks.collect()) == [600, 600, 1000, 1000, 1000, 1000]
    samples = arrays_to_samples(chunks, start="start")
    found = denoise_samples(samples, chunk=1024, halo=512).toPandas()
    whole = {r["lead_idx"]: r["signal"] for r in read_recordings(spark, str(tmp_path)).collect()}
    for lead, signal in whole.items():
        part = found[found.lead_idx == lead].sort_values("i")
        expected = denoise_block(np.array(signal)[None])[0]
        assert np.allclose(part.value.to_numpy(), expected, atol=1e-9, equal_nan=True)
