"""Signal files read by their headers, long leads from stretches, and medians by selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import write_record

from wavelead.functions.wavelet import denoise_block
from wavelead.operators.denoising import chunk_medians, denoise_chunks
from wavelead.plans.prepare import judged_windows, prepare
from wavelead.sources.recordings import parse_headers, read_recordings, recording_rejects
from wavelead.sources.signals import locate_recordings, read_bytes, read_stretches, read_whole


def logging_reader(log):
    """A reader that notes in the file ``log`` what it is asked for."""

    def read(path, start, size):
        with open(log, "a") as file:
            file.write(f"{path.rpartition('/')[2]} {start} {size}\n")
        return read_bytes(path, start, size)

    return read


def two_file_record(folder, digital):
    folder.mkdir(parents=True)
    names = ["b c.dat"] * 3 + ["a.dat"] * (digital.shape[1] - 3)
    lines = [f"9 {len(names)} 100 {len(digital)}"] + [f"{f} 16+4 200/mV 16 0 0 0 0 L{j}" for j, f in enumerate(names)]
    (folder / "9.hea").write_text("\n".join(line.replace("b c", "b%c") for line in lines))
    (folder / "b%c.dat").write_bytes(b"head" + digital[:, :3].astype("<i2").tobytes())
    (folder / "a.dat").write_bytes(b"head" + digital[:, 3:].astype("<i2").tobytes())


def test_whole_recordings_equal_those_that_spark_reads(spark, tmp_path):
    rng = np.random.default_rng(1)
    write_record(tmp_path / "1", "1", rng.integers(-99, 99, (50, 4)).tolist(), [200, 10, 1, 3], [1, 2, 3, 4])
    two_file_record(tmp_path / "the ninth", rng.integers(-99, 99, (40, 5)))
    write_record(tmp_path / "2", "2", [[1], [2]], [1])
    (tmp_path / "2" / "2.dat").unlink()
    located = locate_recordings(spark, str(tmp_path))
    rows = {r["patient_id"]: r for r in read_whole(located).collect()}
    expected = {(r["patient_id"], r["lead_idx"]): r for r in read_recordings(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 9]
    for patient, row in rows.items():
        assert row["lead_idx"] == list(range(len(row["lead_idx"])))
        for j, (lead, signal) in enumerate(zip(row["lead"], row["signals"])):
            assert (lead, signal) == (expected[patient, j]["lead"], expected[patient, j]["signal"])
    assert [r["reason"] for r in recording_rejects(located).collect()] == ["signal file is missing"]


def test_stretches_equal_the_whole_and_are_read_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    digital = rng.integers(-99, 99, (1000, 3))
    write_record(tmp_path / "raw" / "1", "1", digital.tolist(), [200, 10, 1])
    two_file_record(tmp_path / "raw" / "9", rng.integers(-99, 99, (130, 5)))
    (tmp_path / "raw" / "7").mkdir()
    (tmp_path / "raw" / "7" / "7.hea").write_text("7 1 100\n7.dat 16\n")
    (tmp_path / "raw" / "7" / "7.dat").write_bytes(b"\1\0")
    log = tmp_path / "log"
    located = locate_recordings(spark, str(tmp_path / "raw"))
    rows = read_stretches(located, chunk=64, read=logging_reader(str(log))).collect()
    whole = {(r["patient_id"], r["lead_idx"]): r["signal"] for r in read_recordings(spark, str(tmp_path / "raw")).collect()}
    found = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == len(found.setdefault((r["patient_id"], r["lead_idx"]), [])) and len(r["signal"]) <= 64
        found[r["patient_id"], r["lead_idx"]] += r["signal"]
    assert found == whole
    read = [line.split() for line in log.read_text().splitlines()]
    assert sum(int(size) for *_, size in read) == 1000 * 3 * 2 + 130 * 5 * 2 + 2


def test_a_file_cut_into_ranges(spark, tmp_path, monkeypatch):
    from wavelead.sources import signals

    monkeypatch.setattr(signals, "BATCH_BYTES", 4096)
    digital = np.random.default_rng(2).integers(-99, 99, (5000, 2))
    write_record(tmp_path / "raw" / "1", "1", digital.tolist(), [200, 10])
    log = tmp_path / "log"
    rows = read_stretches(locate_recordings(spark, str(tmp_path / "raw")), chunk=256, read=logging_reader(str(log))).collect()
    ranges = sorted((int(a), int(b)) for _, a, b in (line.split() for line in log.read_text().splitlines()))
    assert len(ranges) == 5 and [a for a, _ in ranges[1:]] == [a + b for a, b in ranges[:-1]]
    lead = np.concatenate([r["signal"] for r in sorted(rows, key=lambda r: r["start"]) if r["lead_idx"] == 0])
    assert np.array_equal(lead, digital[:, 0] / 200)


def test_equal_copies_count_once(spark, tmp_path):
    digital = np.random.default_rng(7).integers(-99, 99, (30, 2)).tolist()
    for folder, name, values, gain in (
        ("x", "1", digital, 200), ("y", "1", digital, 200), ("z", "1", digital, 200),  # equal
        ("x", "2", digital, 200), ("y", "2", digital[::-1], 200),  # other samples
        ("x", "3", digital, 200), ("y", "3", digital, 100),  # another gain
        ("x", "4", digital, 200), ("y", "4", digital, 200),  # one without its signals
        ("x", "5", digital, 200),
    ):
        write_record(tmp_path / folder / name, name, values, [gain] * 2)
    (tmp_path / "y" / "4" / "4.dat").unlink()
    located = locate_recordings(spark, str(tmp_path), equal_copies=True)
    found = {(r["patient_id"], r["folder"].split("/")[-2]): r["reason"] for r in located.collect()}
    copy, several = "copy of another recording", "patient has several recordings"
    assert found == {
        (1, "x"): None, (1, "y"): copy, (1, "z"): copy, (2, "x"): several, (2, "y"): several,
        (3, "x"): several, (3, "y"): several, (4, "x"): several, (4, "y"): several, (5, "x"): None,
    }
    assert sorted(r["patient_id"] for r in read_whole(located).collect()) == [1, 5]
    strict = locate_recordings(spark, str(tmp_path))
    assert sorted(r["patient_id"] for r in read_whole(strict).collect()) == [5]


def test_a_file_that_has_changed_is_an_error(spark, tmp_path):
    write_record(tmp_path / "1", "1", [[1], [2]], [1])
    located = locate_recordings(spark, str(tmp_path))
    with pytest.raises(Exception, match="has changed"):
        read_whole(located, lambda path, start, size: b"").collect()


def test_prepare_reads_every_byte_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    for p in (1, 2):
        write_record(tmp_path / "raw" / str(p), str(p), rng.integers(-900, 900, (650, 12)).tolist(), [200] * 12)
    two_file_record(tmp_path / "raw" / "9", rng.integers(-900, 900, (300, 12)))
    (tmp_path / "meta.csv").write_text("patient_id,brugada\n1,0\n2,2\n9,1\n")
    log = tmp_path / "log"
    report = prepare(
        spark, str(tmp_path / "meta.csv"), str(tmp_path / "raw"), str(tmp_path / "out"), read=logging_reader(str(log))
    ).first()
    assert report["ok"] and (report["n_rows"], report["n_groups"], report["n_positive"]) == (5, 3, 3)
    read = [line.split() for line in log.read_text().splitlines()]
    assert len({tuple(r) for r in read}) == len(read) == 4
    assert sum(int(size) for *_, size in read) == 2 * (2 * 650 * 12 + 300 * 12)


def test_no_contents_in_the_plan(spark, tmp_path):
    write_record(tmp_path / "1", "1", [[1] * 12] * 700, [200] * 12)
    labels = spark.createDataFrame([(1, [0])], "patient_id long, labels array<int>")
    located = locate_recordings(spark, str(tmp_path), labels=labels)
    windows = judged_windows(read_whole(located))
    plan = windows._jdf.queryExecution().executedPlan().toString()
    scans = [line.partition("ReadSchema")[2] for line in plan.splitlines() if "FileScan binaryFile" in line]
    # Of the signal files, the only ones whose length is asked for, the contents are not scanned.
    assert [scan for scan in scans if "length" in scan] == [": struct<path:string,length:bigint>"]
    assert windows.where("kind = 'dataset'").count() == 2


def test_unreadable_fields_have_a_reason(spark):
    first, line = "5 1 100 20", "5.dat 16 200(3)/mV 16 0 0 0 0 I"
    cases = {
        "5 1 1.0.0 20": (line, "sampling rate not understood"),
        "5 1 fast 20": (line, "sampling rate not understood"),
        "5 1 100 2x": (line, "number of samples not understood"),
        "5 1 100 99999999999999999999": (line, "number of samples not understood"),
        "5 1 100 20 ": ("5.dat 16 1-000(0)/mV 16 0", "gain not understood"),
        "5 1 100 20  ": ("5.dat 16 1e999 16 0", "gain not understood"),
        "5 1 100 20   ": ("5.dat 16 high/mV 16 0", "gain not understood"),
        "5 1 100 20    ": ("5.dat 16 200(x)/mV 16 0", "baseline not understood"),
        "5 1 100 20     ": ("5.dat 16 200(99999999999)/mV 16 0", "baseline not understood"),
        "5 1 100 20      ": ("5.dat 16+99999999999 200/mV 16 0", "offset not understood"),
        "5 1 100 20       ": ("5.dat 16 200/mV 16 99999999999", "zero not understood"),
        first: (line, None),
        "5 1": ("5.dat 16", None),
        "5 1 360/100(0) 20 10:00:00": ("5.dat 16 0(-5)/mV 12 -7 1 2 3 the lead", None),
    }
    frame = spark.createDataFrame(
        [(f"{k}/5.hea", f"{a}\n{b}\n".encode()) for k, (a, (b, _)) in enumerate(cases.items())],
        "path string, content binary",
    )
    found = {int(r["folder"]): r["reason"] for r in parse_headers(frame).collect()}
    assert found == {k: reason for k, (_, reason) in enumerate(cases.values())}


def chunk_rows(signals, chunk):
    return [(p, 0, a, x[a : a + chunk].tolist()) for p, x in signals.items() for a in range(0, len(x), chunk)]


SCHEMA = "patient_id long, lead_idx int, start long, signal array<double>"


def test_chunks_are_denoised_as_whole_leads(spark):
    rng = np.random.default_rng(8)
    lengths = {1: 2000, 2: 1025, 3: 1024, 4: 1023, 5: 300, 6: 2049, 7: 1, 8: 5000, 9: 1500, 10: 2048}
    signals = {p: rng.normal(size=n).cumsum() for p, n in lengths.items()}
    signals[9][700] = np.nan
    signals[10][:] = 3.0
    cleaned = denoise_chunks(spark.createDataFrame(chunk_rows(signals, 1024), SCHEMA), chunk=1024, halo=512)
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.replace("Generate explode(sequence", "")  # only starts of chunks are generated
    rows = cleaned.collect()
    for p, x in signals.items():
        parts = sorted((r["start"], r["signal"]) for r in rows if r["patient_id"] == p)
        assert [a for a, _ in parts] == list(range(0, len(x), 1024))
        assert np.allclose(np.concatenate([s for _, s in parts]), denoise_block(x[None])[0], atol=1e-9, equal_nan=True), p


def test_halo_and_chunk_must_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for chunk, halo in ((1000, 512), (1024, 256), (512, 1024)):
        with pytest.raises(ValueError):
            denoise_chunks(empty, chunk=chunk, halo=halo)
    assert denoise_chunks(empty, chunk=1024, halo=512).count() == 0


def test_medians_by_selection(spark):
    rng = np.random.default_rng(5)
    values = {
        1: rng.normal(size=1001),
        2: rng.normal(size=1000) * 10.0 ** rng.integers(-300, 300, 1000),
        3: np.zeros(64),
        4: np.array([1.0]),
        5: np.array([-1.0, 1.0 + 2**-52]),
        6: np.repeat([0.5, -2.0], 50),
        7: np.array([5e-324, 0.0, -0.0, 1.0]),
        8: rng.integers(-3, 3, 777).astype(float),
    }
    frame = spark.createDataFrame(chunk_rows(values, 64), SCHEMA)
    starts = frame.groupBy("patient_id", "lead_idx").agg(F.collect_list("start").alias("starts"))
    found = {r["patient_id"]: r["median"] for r in chunk_medians(frame, ["patient_id", "lead_idx"], "signal", starts).collect()}
    assert found == {p: np.median(np.abs(x)) for p, x in values.items()}
