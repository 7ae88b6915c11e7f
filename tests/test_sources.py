"""Files: scenes and cameras; raster, lineage and window functions without SQL counterparts."""

import json

import numpy as np
import pytest

from vantage.functions import capture, geo
from vantage.operators import captures, gaussians, lineage, neighbours, raster, stations
from vantage.sources import cameras, ply
from vantage.streaming import windows

NAMES = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def scene_bytes(n=5, names=NAMES, fmt="binary_little_endian 1.0", tail=b"", seed=0):
    data = np.random.default_rng(seed).standard_normal((n, len(names))).astype("<f4")
    head = "\n".join(["ply", f"format {fmt}", "comment c", f"element vertex {n}", *(f"property float {x}" for x in names), "end_header", ""])
    return head.encode() + data.tobytes() + tail, data


def test_scene_round_trip(spark, tmp_path):
    raw, data = scene_bytes(7)
    (tmp_path / "a.ply").write_bytes(raw)
    df = ply.read_ply(spark, f"file://{tmp_path}/a.ply")
    assert df.columns == ["row_id", *NAMES] and df.count() == 7
    assert ply.write_ply(df.where("row_id % 2 = 0").repartition(3), f"file://{tmp_path}/b.ply") == 4
    h, got = ply.rows_of((tmp_path / "b.ply").read_bytes())
    assert h.names == tuple(NAMES) and got.tobytes() == data[::2].tobytes()
    with pytest.raises(ValueError):
        ply.write_ply(df.where("row_id < 0"), f"file://{tmp_path}/c.ply")
    assert ply.write_ply(df, f"file://{tmp_path}/d.ply", normalise=True, comments=("one", "two")) == 7
    _, unit = ply.rows_of((tmp_path / "d.ply").read_bytes())
    assert np.allclose(np.linalg.norm(unit[:, 13:17], axis=1), 1, atol=1e-6) and not unit[:, 3:6].any()


def test_scene_of_several_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for k in range(3):
        (tmp_path / "s" / f"{k}.ply").write_bytes(scene_bytes(4, seed=k)[0])
    df = ply.read_ply(spark, f"file://{tmp_path}/s")
    assert sorted(r.row_id for r in df.collect()) == list(range(12))
    assert np.isclose(df.where("row_id = 9").first().x, scene_bytes(4, seed=2)[1][1, 0])


@pytest.mark.parametrize(
    "raw",
    [
        b"", scene_bytes(fmt="ascii 1.0")[0], scene_bytes(tail=b"x")[0], scene_bytes(names=NAMES[:-1])[0], scene_bytes(names=[*NAMES, "f_rest_0"])[0], scene_bytes(names=[*NAMES, "x"])[0],
        scene_bytes()[0].replace(b"element vertex 5", b"element face 5"), scene_bytes()[0].replace(b"property float x", b"property double x"), scene_bytes()[0][:-4] + b"\0\0\xc0\x7f",
    ],
)
def test_damaged_scenes(raw):
    with pytest.raises(ValueError):
        ply.rows_of(raw)


def test_modes():
    raw, data = scene_bytes()
    zero = raw[: -5 * 4 * len(NAMES)] + np.where(np.isin(np.arange(len(NAMES)), [13, 14, 15, 16]), 0, data).astype("<f4").tobytes()
    with pytest.raises(ValueError):
        ply.rows_of(zero)
    assert ply.rows_of(zero, "serialization")[0].rows == 5
    assert ply.rows_of(raw[:-4] + b"\0\0\xc0\x7f", "inspect")[0].rows == 5
    with pytest.raises(ValueError):
        ply.rows_of(raw, "sh2")


def test_cameras(spark, tmp_path):
    eye = [[1, 0, 0, 2], [0, 1, 0, 3], [0, 0, 1, 4], [0, 0, 0, 1]]
    doc = {"units": "metres", "w": 8, "h": 4, "fl_x": 2.0, "fl_y": 2.0, "cx": 4.0, "cy": 2.0, "frames": [{"file_path": "a", "station_id": "s", "transform_matrix": eye}, {"file_path": "b", "w": 16, "transform_matrix": [[2, 0, 0, 0]] * 3}, {"file_path": "c"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = {r.file_path: r for r in cameras.read_cameras(spark, f"file://{tmp_path}/c.json").collect()}
    assert got["a"].valid and (got["a"].w, got["a"].tx, got["a"].tz) == (8, 2, 4) and got["b"].w == 16 and not got["b"].valid and not got["c"].valid
    turned = cameras.to_opencv(cameras.read_cameras(spark, f"file://{tmp_path}/c.json")).where("file_path = 'a'").first()
    assert (turned.r00, turned.r11, turned.r22) == (1, -1, -1)


def test_size_filter_is_strict_and_scale_free(spark):
    for s in (1e-4, 1.0, 1000.0):
        cams = spark.createDataFrame([(1, -2.0 * s, 0.0, 0.0), (2, 2.0 * s, 0.0, 0.0), (3, 0.0, 0.0, 1.0 * s)] + [(1, -2.0 * s, 0.0, 0.0)] * 37, "station_id long, cx double, cy double, cz double")
        r = stations.scene(cams).first().radius
        rows = [(i, 0.0, 0.0, 0.0, float(np.log(v * r)), -99.0, -99.0) for i, v in enumerate((0.1, 0.6, 50.0, 0.1))] + [(4, 0.0, 0.0, 0.0, float(np.log(0.5 * r)), -99.0, -99.0)]
        g = spark.createDataFrame(rows, "row_id long, x double, y double, z double, scale_0 double, scale_1 double, scale_2 double")
        removed = sorted(r.row_id for r in gaussians.marked(g, cams, (0.0, -1.0, 0.0), crop_ratio=100.0).where("NOT keep_size").collect())
        assert removed[:2] == [1, 2] and set(removed) <= {1, 2, 4}
    with pytest.raises(ValueError):
        gaussians.marked(g, cams, (0.0, -1.0, 0.0), size_ratio=11)


def test_lengths(spark):
    cams = spark.createDataFrame([(i, 2.0 * i, 0.0, 0.0) for i in range(5)] * 2, "station_id long, cx double, cy double, cz double")
    assert stations.characteristic_length(cams).first().length == 2.0
    assert np.isclose(stations.characteristic_length(cams.withColumn("cx", cams.cx * 100)).first().length, 200)


def test_complete_link_never_chains(spark):
    step = 0.2 / 6371008.8 * 180 / np.pi
    rows = [(i, 10.0 + i * step, 20.0) for i in range(6)]
    got = {r.id: r.group_id for r in stations.complete_link(spark.createDataFrame(rows, "id long, lat double, lng double").repartition(3)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-20, 20, (80, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {(r.id, r["rank"]): r.other for r in neighbours.nearest(df, df, 3, 1.0, apart=True).collect()}
    for i in range(80):
        order = [j for j in np.lexsort((np.arange(80), d[i])) if j != i][:3]
        assert [got[i, k] for k in (1, 2, 3)] == order
    counts = {r.id: r["count"] for r in neighbours.ball_count(df, df, 5.0).collect()}
    assert counts == {i: int((d[i] <= 5).sum()) for i in range(80)}
    unit = p / np.linalg.norm(p, axis=1)[:, None]
    s = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(unit)], "id long, x double, y double, z double")
    feather = {r.id: r for r in neighbours.sphere_nearest(s, s.where("id < 5"), 20.0).collect()}
    for i in range(80):
        a = np.degrees(np.arccos(np.clip(unit[:5] @ unit[i], -1, 1))).min()
        t = min(1, a / 20)
        assert np.isclose(feather[i].weight, 1 - t * t * (3 - 2 * t), atol=1e-5)


def test_capture_times(spark):
    rows = [("2020-02-30",), ("2020-02-29 10:11:12",), ("2020-02",), ("2020-02-28",), (None,), ("soon",)]
    df = captures.dated(spark.createDataFrame(rows, "captured_at string"))
    assert [(r.capture_precision, r.month, r.day, r.clock) for r in df.collect()] == [("unknown", None, None, None), ("second", "2020-02", "2020-02-29", "10:11"), ("month", "2020-02", None, None), ("day", "2020-02", "2020-02-28", None), ("unknown", None, None, None), ("unknown", None, None, None)]
    bad = ["2020-01-01junk", "2020-01-01 25:99:00", "2020-01-01 10:30", "2020-1-1", "2020-13", "2020-", "0000-01-01", "2020-01-01 10:30:60", "2020-01-01  10:30:00", ""]
    good = [(" 2020-01-01T23:59:59.123456 ", "second", "23:59"), ("2020-01-01 00:00:00", "second", "00:00"), ("2020-01\t", "month", None)]
    got = captures.dated(spark.createDataFrame([(x,) for x in bad] + [(x,) for x, _, _ in good], "captured_at string")).collect()
    assert {(r.capture_precision, r.capture_date, r.month, r.day, r.clock) for r in got[: len(bad)]} == {("unknown", None, None, None, None)}
    assert [(r.capture_precision, r.clock) for r in got[len(bad) :]] == [x[1:] for x in good]
    for bound in ("9:30", "24:00", "09:30\n"):
        with pytest.raises(ValueError):
            captures.by_policy(captures.dated(spark.createDataFrame([("2020-01",)], "captured_at string")), "any", None, bound)
    with pytest.raises(ValueError):
        captures.by_policy(captures.dated(spark.createDataFrame([("2020-01",)], "captured_at string")), "same_month", "2020-13")
    with pytest.raises(Exception, match="no clock"):
        df.where(capture.clock_between(df.clock, "09:00", None, strict=True)).collect()


def test_box_never_cuts(spark):
    from pyspark.sql import functions as F

    for lat, lng in ((0.0, 179.99), (89.9, 10.0), (-60.0, -179.995)):
        places = spark.range(400).select(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat + (F.col("id") % 20 - 10) / 500)).alias("lat"), ((F.lit(lng) + F.floor(F.col("id") / 20) / 300 + 180) % 360 - 180).alias("lng"))
        far = geo.haversine(lat, lng, F.col("lat"), F.col("lng")) <= 1500
        assert places.where(far).count() == places.where(far & geo.box(F.col("lat"), F.col("lng"), lat, lng, 1500.0)).count()


def test_lineage(spark, tmp_path):
    assert lineage.digest({"b": 1, "a": [1.5, None]}) == lineage.digest({"a": [1.5, None], "b": 1})
    with pytest.raises(ValueError):
        lineage.digest({"a": float("nan")})
    (tmp_path / "f").write_bytes(b"x")
    own = lineage.inventory(spark, f"file://{tmp_path}")
    assert lineage.manifest_faults(own, own).count() == 0
    assert lineage.replayed(own, own.limit(0)).count() == 1
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("a", "9"), ("b", None)], "key string, value string")
    assert {r.key: r.value for r in lineage.merged_recipe(base, new).collect()} == {"a": "9", "b": "2"}
    with pytest.raises(ValueError):
        lineage.merged_recipe(base, spark.createDataFrame([("c", "1")], "key string, value string"))


def test_composite(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(raster.composite(F.lit(255), F.lit(7), F.lit(0.0)).alias("a"), raster.composite(F.lit(255), F.lit(7), F.lit(1.0)).alias("b"), raster.composite(F.lit(255), F.lit(0), F.lit(0.5)).alias("c")).first()
    assert (r.a, r.b, r.c) == (7, 255, 188)


def test_streams(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(500)
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "1 day", ["event_type"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(120)
    assert spark.table("w").selectExpr("sum(rows)").first()[0] == 500
    assert windows.sessions(df, "ts", "6 hours", ["event_type"]).selectExpr("sum(rows)").first()[0] == 500
