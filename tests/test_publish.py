"""Tables in versions, reports taken while writing, and headers of many files."""

import pytest
from pyspark.sql import functions as F

from wavelead.operators.dataset import Observed, dataset_report
from wavelead.sources.metadata import read_metadata
from wavelead.sources.tables import DATASET_SCHEMA, compact, publish, read_published


def rows_of(spark, root):
    return sorted(map(tuple, read_published(spark, root, "group").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "group long, value int")


def test_a_run_replaces_the_patients_it_holds(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        read_published(spark, root, "group")
    publish(frame(spark, [(1, 10), (1, 11), (2, 20), (None, 0)]), root, "group")
    assert rows_of(spark, root) == sorted([(1, 10), (1, 11), (2, 20), (None, 0)], key=str)
    publish(frame(spark, [(1, 12), (3, 30)]), root, "group")
    assert rows_of(spark, root) == sorted([(1, 12), (2, 20), (3, 30), (None, 0)], key=str)
    # Patient 3 has no rows any more, but the run stands for it; a null is a key too.
    keys = spark.createDataFrame([(3,), (None,), (4,)], "group long")
    publish(frame(spark, [(4, 40), (None, 1)]), root, "group", keys=keys)
    expected = sorted([(1, 12), (2, 20), (4, 40), (None, 1)], key=str)
    assert rows_of(spark, root) == expected
    compact(spark, root, "group")
    assert rows_of(spark, root) == expected
    publish(frame(spark, [(9, 9)]), root, "group", replace_all=True)
    assert rows_of(spark, root) == [(9, 9)]


def test_a_failed_job_leaves_the_table_readable(spark, tmp_path):
    root = str(tmp_path / "table")
    publish(frame(spark, [(1, 10), (2, 20)]), root, "group")

    @F.udf("int")
    def fails(value):
        if value > 15:
            raise RuntimeError("half way")
        return value

    bad = frame(spark, [(1, 11), (2, 21)]).repartition(2).withColumn("value", fails("value"))
    with pytest.raises(Exception, match="half way"):
        publish(bad, root, "group")
    assert rows_of(spark, root) == [(1, 10), (2, 20)]

    def refuse(written):
        assert written.count() == 1
        raise ValueError("not as it should be")

    with pytest.raises(ValueError):
        publish(frame(spark, [(1, 12)]), root, "group", check=refuse)
    assert rows_of(spark, root) == [(1, 10), (2, 20)]
    publish(frame(spark, [(1, 13)]), root, "group")
    assert rows_of(spark, root) == [(1, 13), (2, 20)]


def dataset(spark, rows):
    return spark.createDataFrame(rows, DATASET_SCHEMA)


ROWS = [(1, 0, 0, 3, 2, [[1.0] * 3] * 2), (1, 0, 1, 3, 2, [[1.0] * 3] * 2), (2, 1, 0, 3, 2, [[1.0] * 3] * 2)]


@pytest.mark.parametrize(
    "rows, ok",
    [
        (ROWS, True),
        ([], False),
        ([*ROWS, ROWS[0]], False),
        ([*ROWS, (3, 1, 0, 3, 2, [[1.0] * 3, [1.0] * 2])], False),
        ([*ROWS, (3, None, 0, 3, 2, [[1.0] * 3] * 2)], False),
        ([*ROWS, (None, 1, 0, 3, 2, [[1.0] * 3] * 2)], False),
    ],
)
def test_the_observed_report_is_that_of_a_second_look(spark, tmp_path, rows, ok):
    watched = Observed()
    watched.watch(dataset(spark, rows)).write.parquet(str(tmp_path / "d"))
    written = spark.read.schema(DATASET_SCHEMA).parquet(str(tmp_path / "d"))
    report = watched.report(written, (3, 2)).first()
    assert report == dataset_report(written, (3, 2)).first()
    assert report["ok"] == ok and report["n_rows"] == len(rows)
    assert report["n_groups"] == len({r[0] for r in rows if r[0] is not None})
    assert report["n_segments"] == len({r[:3] for r in rows})
    if not ok:
        with pytest.raises(ValueError):
            watched.report(written, (3, 2), strict=True)


def test_only_rows_of_a_kind_are_reported(spark, tmp_path):
    watched = Observed("label = 0")
    watched.watch(dataset(spark, ROWS)).write.parquet(str(tmp_path / "d"))
    written = spark.read.schema(DATASET_SCHEMA).parquet(str(tmp_path / "d")).where("label = 0")
    assert watched.report(written, (3, 2)).first()["n_rows"] == 2


def jobs(spark, tmp_path, n):
    folder = tmp_path / f"m{n}"
    folder.mkdir()
    for k in range(n):
        header, row = ("patient_id,brugada", f"{k},1") if k % 2 else ("brugada,site,patient_id", f"0,x,{k}")
        (folder / f"a+{k} b.csv").write_text(f"{header}\n{row}\n")
    (folder / "empty.csv").write_text("\n  \n")
    spark.sparkContext.setJobGroup(f"headers-{n}", "")
    try:
        frame = read_metadata(spark, str(folder))
        started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{n}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["patient_id"] for r in frame.collect()) == list(range(n))
    return started


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    assert jobs(spark, tmp_path, 4) == jobs(spark, tmp_path, 12)
