"""Connection files of a folder, each by its own header."""

from pyspark.sql import functions as F


def test_files_with_other_headers_are_read_by_their_own(spark, tmp_path):
    from penumbra.sources import conn

    (tmp_path / "a.txt").write_text("# time: 2020-03-04\n# proj: x\n# caster_X caster_Y azimuth\n1.0 2.0 30\nnan 5.0 40\n")
    (tmp_path / "b.txt").write_text("# time: 2021-05-06\n# azimuth caster_Y caster_X zenith\n50 8.0 7.0 60\n")
    got = conn.read(spark, str(tmp_path))
    assert set(got.columns) == {"caster_X", "caster_Y", "azimuth", "zenith", "timestamp"}
    rows = sorted((tuple(r) for r in got.select("caster_X", "caster_Y", "azimuth", "zenith", F.col("timestamp").cast("string")).collect()), key=lambda r: r[1])
    assert rows == [(1.0, 2.0, 30.0, None, "2020-03-04"), (None, 5.0, 40.0, None, "2020-03-04"), (7.0, 8.0, 50.0, 60.0, "2021-05-06")]


def test_overlapping_boxes_come_once_from_one_cell(spark):
    from penumbra.sources import vectors

    ddl = "id int, west double, east double, south double, north double"
    first = spark.createDataFrame([(1, 0.0, 35.0, -12.0, 25.0), (2, 50.0, 51.0, 0.0, 1.0)], ddl)
    second = spark.createDataFrame([(7, 5.0, 40.0, -30.0, 30.0), (8, 35.0, 36.0, 0.0, 1.0)], ddl)
    out = vectors.boxes_overlap(first, second, 10.0)
    assert [tuple(r) for r in out.collect()] == [(1, 7)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
