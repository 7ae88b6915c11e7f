"""Projection, alignment, gates, samples, array sources and the command line, against plain computations."""

import io
import json
import math

import numpy as np
import pytest

from vantage.operators import alignment, gates, projection, sampling, sky
from vantage.sources import ply, tables

TERMS = [f"r{i}{j}" for i in range(3) for j in range(3)]


def turn(axis, degrees):
    a = math.radians(degrees)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    r = np.eye(3)
    r[i, i] = r[j, j] = math.cos(a)
    r[i, j], r[j, i] = -math.sin(a), math.sin(a)
    return r


def cube(size=8):
    turns = {"F": np.eye(3), "R": turn(1, 90), "B": turn(1, 180), "L": turn(1, -90), "U": turn(0, 90), "D": turn(0, -90)}
    return {f: (k, r) for k, (f, r) in enumerate(turns.items())}, size


def cube_cameras(spark, faces, size, stations=("s",)):
    rows = [(s, f, k, size, size, size / 2, size / 2, size / 2, size / 2, *map(float, r.ravel())) for s in stations for f, (k, r) in faces.items()]
    return spark.createDataFrame(rows, ["station_id", "face", "face_index", "w", "h", "fl_x", "fl_y", "px", "py", *TERMS])


def test_faces_to_panorama_and_back(spark):
    faces, size = cube()
    width = 32
    cameras = cube_cameras(spark, faces, size, ("s", "t"))
    rng = np.random.default_rng(1)
    pictures = {(s, f): rng.random((size, size)) < 0.5 for s in "st" for f in faces}
    pixels = spark.createDataFrame([(s, f, x, y, bool(m[y, x])) for (s, f), m in pictures.items() for y in range(size) for x in range(size)], "station_id string, face string, x long, y long, flag boolean")
    got = {(r.station_id, r.x, r.y): (r.face, r.flag) for r in projection.faces_to_erp(pixels, cameras, width, ["flag"]).collect()}
    assert len(got) == 2 * width * width // 2
    for (s, x, y), (face, flag) in got.items():
        lng, lat = ((x + 0.5) / width - 0.5) * 2 * math.pi, ((y + 0.5) / (width // 2) - 0.5) * math.pi
        ray = np.array([math.cos(lat) * math.sin(lng), math.sin(lat), math.cos(lat) * math.cos(lng)])
        depth = {f: (ray @ r)[2] for f, (_, r) in faces.items()}
        assert depth[face] >= max(depth.values()) - 1e-9
        p = ray @ faces[face][1]
        u, v = (size / 2 * p[i] / p[2] + size / 2 for i in (0, 1))
        if min(abs(u - round(u)), abs(v - round(v))) > 1e-9:
            assert flag == pictures[s, face][int(v), int(u)]
    assert {(r.uncovered, r.faces) for r in projection.uncovered(projection.erp_owners(cameras, width)).collect()} == {(0, 6)}

    erp = rng.random((width // 2, width)) < 0.3
    mask = spark.createDataFrame([(s, x, y, bool(erp[y, x])) for s in "st" for y in range(width // 2) for x in range(width)], "station_id string, x long, y long, flag boolean")
    for nearest in (True, False):
        back = projection.erp_to_faces(mask, cameras, width, nearest).collect()
        assert len(back) == 2 * 6 * size * size
        for r in back:
            p = faces[r.face][1] @ np.array([(r.x + 0.5) / (size / 2) - 1, (r.y + 0.5) / (size / 2) - 1, 1.0])
            mx = (math.atan2(p[0], p[2]) / (2 * math.pi) + 0.5) % 1 * width
            my = (math.asin(p[1] / np.linalg.norm(p)) / math.pi + 0.5) * width / 2
            if nearest:
                want = erp[min(int(my), width // 2 - 1), int(mx) % width]
            else:
                xs = {math.floor(mx - 0.5) % width, math.ceil(mx - 0.5) % width}
                ys = {min(max(f(my - 0.5), 0), width // 2 - 1) for f in (math.floor, math.ceil)}
                if min(abs(mx - 0.5 - round(mx - 0.5)), abs(my - 0.5 - round(my - 0.5))) < 1e-9:
                    continue
                want = any(erp[b, a] for a in xs for b in ys)
            assert r.flag == want


def test_bilinear(spark):
    rng = np.random.default_rng(2)
    v = rng.random((5, 6))
    pixels = spark.createDataFrame([("a", x, y, float(v[y, x]), True) for y in range(5) for x in range(6)], "image string, x long, y long, value double, flag boolean")
    at = [(-0.5, 2.0), (2.25, 3.5), (5.0, 4.0), (5.5, 0.0), (-3.0, 1.0)]
    points = spark.createDataFrame([("a", i, *p) for i, p in enumerate(at)], "image string, id long, mx double, my double")
    padded = np.pad(v, 4)
    want = {}
    for i, (x, y) in enumerate(at):
        a, b = math.floor(x), math.floor(y)
        f, g = x - a, y - b
        want[i] = sum(padded[b + j + 4, a + k + 4] * (g if j else 1 - g) * (f if k else 1 - f) for j in (0, 1) for k in (0, 1))
    got = {r.id: r.value for r in projection.bilinear(points, pixels, ["id"], ["value"]).collect()}
    assert got == pytest.approx(want)
    ok = lambda size: {r.id: r.supported for r in projection.bilinear_support(points, pixels, ["id"], size).collect()}
    assert ok(None) == {0: False, 1: True, 2: True, 3: False, 4: False} and all(ok((6, 5)).values())


def test_view_agreement(spark):
    side, focal = 12, 12.0
    centres = {"t": (0.0, 0.0), "a": (0.4, 0.0), "b": (-0.4, 0.1), "c": (0.0, 0.4), "own": (0.3, 0.3)}
    station = {"t": 1, "a": 2, "b": 3, "c": 3, "own": 1}
    cams, pixels = [], []
    for f, (x, y) in centres.items():
        cams.append((f, station[f], side, side, focal, focal, side / 2, side / 2, *map(float, np.eye(3).ravel()), x, y, 0.0))
        # A plane at z = 4, grey; b's left half holds another depth, and a's upper half another colour.
        for v in range(side):
            for u in range(side):
                grey = 0.9 if f == "a" and v < 6 else 0.5
                pixels.append((f, u, v, 3.0 if f == "b" and u < 6 else 4.0, (u + v) % 5 != 0 or f != "t", 1.0, grey, grey, grey))
    cameras = spark.createDataFrame(cams, ["frame", "station_id", "w", "h", "fl_x", "fl_y", "px", "py", *TERMS, "tx", "ty", "tz"])
    p = spark.createDataFrame(pixels, "frame string, x long, y long, depth_z double, valid boolean, confidence double, red double, green double, blue double")
    pairs = spark.createDataFrame([("t", s) for s in "abc"] + [("t", "own")], ["frame", "source"])
    got = {(r.x, r.y): (r.support, r.accepted) for r in projection.view_agreement(p, cameras, pairs).where("frame = 't'").collect()}
    assert len(got) == sum((u + v) % 5 != 0 for u in range(side) for v in range(side))
    for (x, y), (support, accepted) in got.items():
        X, Y = (x + 0.5 - 6) / focal * 4, (y + 0.5 - 6) / focal * 4
        stations = set()
        for s in "abc":
            u, v = focal * (X - centres[s][0]) / 4 + 6, focal * (Y - centres[s][1]) / 4 + 6
            if not (1 <= u < side - 1 and 1 <= v < side - 1) or (s == "b" and u < 6):
                continue
            total = 0.0
            for j in (-1, 0, 1):
                for i in (-1, 0, 1):
                    if 0 <= x + i < side and 0 <= y + j < side:
                        su, sv = u + i - 0.5, v + j - 0.5
                        a, b = math.floor(su), math.floor(sv)
                        colour = 0.0
                        for q in (0, 1):
                            for r in (0, 1):
                                if 0 <= a + r < side and 0 <= b + q < side:
                                    colour += (0.9 if s == "a" and b + q < 6 else 0.5) * (sv - b if q else 1 - sv + b) * (su - a if r else 1 - su + a)
                        # The neighbour at its own depth of 4 projects one pixel further.
                        total += abs(colour - 0.5)
            if abs(total / 9 - 0.1) < 1e-9:
                break
            if total / 9 <= 0.1:
                stations.add(station[s])
        else:
            assert (x, y, support, accepted) == (x, y, len(stations), len(stations) >= 2)
    assert {0, 1, 2} >= {s for s, _ in got.values()} and any(a for _, a in got.values()) and not all(a for _, a in got.values())


def test_similarity_and_rotation(spark):
    rng = np.random.default_rng(3)
    s = rng.standard_normal((40, 3)) * 20
    a, k = 0.7, 1.8
    r = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    t = np.column_stack([k * s[:, :2] @ r.T + [5, -3], k * s[:, 2] + 11])
    t[0, :2] += 400
    rows = [("x", *map(float, p), *map(float, q)) for p, q in zip(s, t)] + [("two", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)] * 2 + [("same", 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)] * 4
    got = {x.scene: x for x in alignment.similarity(spark.createDataFrame(rows, ["scene", "sx", "sy", "sz", "tx", "ty", "tz"]), "scene").collect()}
    x = got["x"]
    assert x.scale == pytest.approx(k, abs=0.02) and x.angle == pytest.approx(a, abs=0.02) and x.shift_z == pytest.approx(11, abs=0.2)
    assert got["two"].scale is None and got["same"].scale is None
    base = turn(0, 20) @ turn(1, 40)
    many = [("g", *map(float, (turn(i, d) @ base).ravel())) for i in range(3) for d in (-4, 4)]
    df = spark.createDataFrame(many, ["g", *TERMS])
    mean = alignment.mean_rotation(df, "g")
    m = mean.first()
    assert np.allclose([m[n] for n in TERMS], base.ravel()) and m.samples == 6
    out = alignment.rotation_residuals(df, mean, "g").first()
    assert out.median_degrees == pytest.approx(4) and out.max_degrees == pytest.approx(4)


DEPTH = "frame string, station_id string, roster_sha256 string, target_pixels long, confidence_sum double, relative_error_sum double, relative_variance_sum double, relative_moment_sum double, covered_pixels long"


def depth_views(spark, moment=1.0, covered=100, error=0.5, frames="abcd", sha="h"):
    return spark.createDataFrame([(f, f"s{i // 2}", sha, 100, 10.0, error, moment - error, moment, covered) for i, f in enumerate(frames)], DEPTH)


def test_depth_gate(spark):
    before = depth_views(spark)
    roster = before.select("frame", "station_id", "roster_sha256", "target_pixels")
    none = spark.createDataFrame([], "station_id string")
    judge = lambda after, roster=roster, trained=none: gates.depth_gate(before, after, roster, trained).first()
    good = judge(depth_views(spark, moment=0.8))
    assert good.accepted and good.reasons == "" and good.improvement == pytest.approx(0.2)
    assert judge(before).reasons == "no_heldout_geometric_consistency_improvement"
    assert judge(depth_views(spark, moment=0.8, error=0.6)).reasons == "heldout_depth_target_error_regression,local_depth_target_error_regression"
    assert judge(depth_views(spark, moment=0.8, covered=50)).reasons == "heldout_depth_coverage_regression,local_depth_coverage_regression"
    assert judge(depth_views(spark, moment=2.0)).reasons == "local_geometric_consistency_regression,no_heldout_geometric_consistency_improvement"
    assert judge(depth_views(spark, moment=0.8, frames="abcx")).reasons == "depth_target_roster_mismatch,trusted_depth_target_roster_mismatch"
    assert judge(depth_views(spark, moment=0.8, sha="other")).reasons == "depth_target_binding_mismatch"
    assert judge(depth_views(spark, moment=0.8), trained=spark.createDataFrame([("s1",)], ["station_id"])).reasons == "insufficient_or_leaked_physical_station_holdout"
    assert judge(depth_views(spark, moment=float("nan"))).reasons == "invalid_depth_statistics"
    assert "invalid_trusted_depth_target_roster" in judge(before, roster.limit(0)).reasons


def sky_views(spark, sky_after=0.5, holes=0, other=1.0):
    rows = [(f"{s}{c}", s, c, 100, 1.0, sky_after if c == "sky" else other, 90, 95 if c == "sky" else 90, holes) for s in ("s1", "s2") for c in ("all", "foreground", "down", "sky")]
    return spark.createDataFrame(rows, "frame string, station_id string, category string, pixels long, before_sse double, after_sse double, before_covered long, after_covered long, new_holes long")


def test_sky_gate_and_candidate(spark):
    none = spark.createDataFrame([], "station_id string")
    judge = lambda views, found=none, same=True: gates.sky_gate(views, found, same, 2, 0.1, 0.5, 0.1, 0.01, 0.999)
    good = judge(sky_views(spark))
    one = good.first()
    assert one.accepted and one.sky_gain == pytest.approx(10 * math.log10(2)) and one.sky_coverage_gain == pytest.approx(0.05)
    assert judge(sky_views(spark), same=False).first().reasons == "foreground_not_proven_byte_identical"
    assert judge(sky_views(spark), found=spark.createDataFrame([("s2",)], ["station_id"])).first().reasons == "physical_station_holdout_leakage"
    assert judge(sky_views(spark, sky_after=1.0)).first().reasons == "no_measured_sky_rgb_improvement"
    bad = judge(sky_views(spark, other=2.0))
    assert bad.first().reasons == "all_rgb_regression,down_rgb_regression,foreground_rgb_regression"
    assert judge(sky_views(spark, holes=1)).first().reasons == ",".join(f"new_{c}_holes" for c in ("all", "down", "foreground", "sky"))
    assert "insufficient_sky_evaluation" in judge(sky_views(spark).where("category <> 'sky'")).first().reasons
    both = gates.candidate_gate(good, bad, bad).first()
    assert not both.accepted and both.reasons == bad.first().reasons and gates.candidate_gate(good).first().reasons == ""


def test_samples(spark):
    import hashlib

    ids = spark.range(300).withColumnRenamed("id", "p")
    got = {r.p: r.fit for r in ids.select("p", sampling.point_split(ids.p, 9, 0.8).alias("fit")).collect()}
    assert got == {p: int.from_bytes(hashlib.blake2b(f"9:{p}".encode(), digest_size=8).digest(), "big") < int(0.8 * 2**64) for p in range(300)}
    frames = spark.createDataFrame([("a", f"a{i}") for i in range(30)] + [("b", "b0")], ["station_id", "frame"])
    drawn = sampling.station_uniform(frames, 2000, 5)
    rows = drawn.collect()
    assert len(rows) == 2000 and abs(sum(r.station_id == "a" for r in rows) - 1000) < 150 and len({r.frame for r in rows}) == 31
    assert sorted(rows) == sorted(drawn.collect())
    assert sampling.station_uniform(frames.limit(0), 3, 5).count() == 0


def test_empty_tables(spark):
    m = spark.createDataFrame([], "image string, x long, y long, flag boolean")
    assert sky.mask_distance(m, 4, 4).count() == 0
    p = spark.createDataFrame([], "image string, id long, mx double, my double")
    assert projection.bilinear_support(p, m, ["id"]).count() == 0
    s = spark.createDataFrame([], "station_id string, kx double, ky double, kz double, x double, y double, z double")
    assert alignment.baseline_scale(s).first().scale is None


def test_bundles_tiles_and_points(spark, tmp_path):
    for k in (1, 2):
        np.savez(tmp_path / f"{k}.npz", point_id=np.arange(3) * k, xy=np.full((3, 2), k, float), frame=np.array(["f"] * 3))
    df = tables.read_bundle(spark, f"file://{tmp_path}/*.npz", "point_id long, xy array<double>, frame string")
    assert sorted((r.point_id, tuple(r.xy), r.frame) for r in df.collect()) == sorted((i * k, (float(k),) * 2, "f") for i in range(3) for k in (1, 2))
    raw = io.BytesIO()
    np.savez(raw, point_id=np.arange(3), xy=np.zeros((2, 2)), frame=np.array(["f"] * 3))
    (tmp_path / "bad.npz").write_bytes(raw.getvalue())
    with pytest.raises(Exception, match="differ in length"):
        tables.read_bundle(spark, f"file://{tmp_path}/bad.npz", "point_id long, xy array<double>, frame string").collect()

    tiles = spark.createDataFrame([("p", f, x, y, 512, 512) for f in "FR" for x in (0, 1) for y in (0, 1) if f == "F" or x], "pano_id string, face string, tile_x int, tile_y int, width int, height int")
    assert {r.face: r.usable for r in tables.tile_faults(tiles).collect()} == {"F": True, "R": False}
    moved = tables.stitched(tiles.withColumnsRenamed({"width": "x", "height": "y"}).selectExpr("face", "tile_x", "tile_y", "1 AS x", "2 AS y"))
    assert moved.where("face = 'F'").selectExpr("max(x)", "max(y)").first()[:] == (513, 514)

    points = spark.createDataFrame([(i, i + 0.5, 1.0, 2.0, i, 255, 0) for i in range(5)], "point_id long, x float, y float, z float, red short, green short, blue short").repartition(3)
    assert tables.write_points(points, f"file://{tmp_path}/p.ply") == 5
    head, body = (tmp_path / "p.ply").read_bytes().split(b"end_header\n")
    assert b"element vertex 5" in head and len(body) == 5 * 15 and body[12:15] == bytes([0, 255, 0]) and np.frombuffer(body[15:19], "<f4")[0] == 1.5
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "m.jsonl").write_text('{"step": 1, "loss": 0.5}\n{"step": 2, "loss": 0.25}\n')
    assert tables.read_history(spark, f"file://{tmp_path}/h", "step long, loss double").agg({"loss": "min"}).first()[0] == 0.25


def test_command_line(spark, tmp_path, capsys):
    from tests.test_sources import scene_bytes
    from vantage.__main__ import main

    raw, _ = scene_bytes(6)
    (tmp_path / "s.ply").write_bytes(raw)
    pose = lambda x: [[1, 0, 0, x], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    frames = [{"file_path": f"{i}.png", "station_id": f"s{i}", "face": "F", "transform_matrix": pose(60.0 * i)} for i in range(2)]
    (tmp_path / "c.json").write_text(json.dumps({"units": "m", "world_up": [0, -1, 0], "w": 8, "h": 8, "fl_x": 4.0, "fl_y": 4.0, "cx": 4.0, "cy": 4.0, "frames": frames}))
    files = ["--scene", f"file://{tmp_path}/s.ply", "--cameras", f"file://{tmp_path}/c.json"]
    main(["inspect", *files])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 6
    main(["cleanup", *files, "--size", "10", "--crop", "100", "--out", f"file://{tmp_path}/o.ply"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == 6
    assert ply.rows_of((tmp_path / "o.ply").read_bytes())[1].tobytes() == ply.rows_of(raw)[1].tobytes()
    spark.createDataFrame([("0.png", 4, 4, 1e4, 1.0)], ["frame_name", "ix", "iy", "depth", "confidence"]).write.parquet(f"file://{tmp_path}/depths")
    main(["prune", *files, "--depths", f"file://{tmp_path}/depths", "--width", "8", "--height", "8", "--out", f"file://{tmp_path}/k.ply"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"rows": 6, "removed": 0, "out": f"file://{tmp_path}/k.ply"}
    spark.createDataFrame([(1, 37.5, 127.0), (2, 37.5001, 127.0), (3, 38.0, 127.0)], ["pano_id", "lat", "lng"]).write.parquet(f"file://{tmp_path}/captures")
    main(["discover", "--captures", f"file://{tmp_path}/captures", "--lat", "37.5", "--lng", "127.0"])
    assert [c["pano_id"] for c in json.loads(capsys.readouterr().out.splitlines()[-1])["captures"]] == [1, 2]
    inventory = spark.createDataFrame([(0, "a", "h", 5), (1, "b", "h", 7), (2, "c", "h", 9)], "stage_index int, path string, sha256 string, bytes long")
    inventory.write.parquet(f"file://{tmp_path}/i")
    inventory.where("path <> 'c'").write.parquet(f"file://{tmp_path}/now")
    main(["reuse", "--inventory", f"file://{tmp_path}/i", "--present", f"file://{tmp_path}/now"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"reusable_stages": 2, "files": 2, "bytes": 12}


def test_pages_are_replayed(spark, tmp_path):
    from vantage.operators.pages import Pages

    pages = Pages(spark, f"file://{tmp_path}/pages", {"lat": 1.0, "radius": 5})
    token = pages.opened()
    first = sorted(r.id for r in pages.page(token, lambda: spark.range(5)).collect())
    assert first == sorted(r.id for r in pages.page(token, lambda: spark.range(100, 105)).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="scope"):
        Pages(spark, f"file://{tmp_path}/pages", {"lat": 1.0, "radius": 6}).page(token, lambda: spark.range(1))
    with pytest.raises(ValueError, match="expired"):
        pages.page(token, lambda: spark.range(1), now=4e9)
    for bad in ("0" * 32, "../x"):
        with pytest.raises(ValueError):
            pages.page(bad, lambda: spark.range(1))


def test_class_groups_refuse_what_is_unclear(spark):
    from vantage.operators.sky import class_groups

    labels = spark.createDataFrame([(0, "Sky "), (1, "car"), (2, "CAR")], "id int, label string")
    groups = lambda rows: spark.createDataFrame(rows, "group string, name string")
    assert {r.group: r.ids for r in class_groups(labels, groups([("dynamic", "Car"), ("sky", "sky")])).collect()} == {"dynamic": [1, 2], "sky": [0]}
    for rows in ([("dynamic", "bus")], [("dynamic", "car"), ("sky", "car")]):
        with pytest.raises(Exception, match="class"):
            class_groups(labels, groups(rows)).collect()


def test_depth_fields(spark, tmp_path):
    from vantage.sources import depths

    (tmp_path / "d").mkdir()
    turn = np.array([[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]])  # camera to world
    centre = np.array([1.0, 2.0, 3.0])
    pose = np.concatenate([turn.T, (-turn.T @ centre)[:, None]], axis=1)

    def save(name, **changes):
        z = np.arange(8.0).reshape(2, 4)
        d = dict(depth_z=z, valid=z != 5, confidence=np.full((2, 4), 0.5), source_type=np.ones((2, 4), int), source_count=np.where(z == 6, 0, 2), K=np.array([[10.0, 0, 2], [0, 20, 1], [0, 0, 1]]), camera_from_world=pose, h=2, w=4, station="s", world_frame="ENU", depth_convention="camera_z", unit="m", pixel_center_offset=0.5)
        np.savez(tmp_path / "d" / name, **(d | changes))

    save("a.npz")
    path = f"file://{tmp_path}/d"
    got = {(r.ix, r.iy): r.depth for r in depths.read_depths(spark, path).collect()}
    assert got == {(1, 0): 1.0, (2, 0): 2.0, (3, 0): 3.0, (0, 1): 4.0, (3, 1): 7.0}
    fields = depths.read_fields(spark, path)
    where = fields.first().path
    names = ["file_path", "station_id", "cx", "cy", "cz", *(f"r{i}{j}" for i in range(3) for j in range(3)), "fl_x", "fl_y", "pp_x", "pp_y", "w", "h"]
    camera = ["i.png", "s", *centre.tolist(), *turn.ravel().tolist(), 20.0, 80.0, 4.0, 4.0, 8, 8]
    manifest = spark.createDataFrame([(where, "i.png")], ["path", "image"])
    assert depths.bound_fields(fields, manifest, spark.createDataFrame([tuple(camera)], names)).first().image == "i.png"
    for k, value in ((1, "t"), (2, 1.1), (14, 20.1), (0, "other.png")):
        with pytest.raises(Exception, match="a field"):
            depths.bound_fields(fields, manifest, spark.createDataFrame([tuple(camera[:k] + [value] + camera[k + 1 :])], names)).collect()
    for change in ({"unit": "cm"}, {"source_type": np.zeros((2, 4), int)}, {"valid": np.ones((2, 3), bool)}):
        save("a.npz", **change)
        with pytest.raises(Exception):
            depths.read_depths(spark, path).collect()


def test_core_clear_plan_and_edges(spark):
    """Blocks at edges of tiles, negative pixels and holes against a plain lookup; no pixel is dealt to its neighbours."""
    import contextlib
    import io
    import random

    from vantage.operators.observations import core_clear

    rng = random.Random(3)
    mask = {(f, x, y) for f in "ab" for x in range(-17, 33) for y in range(-16, 31) if rng.random() < 0.93}
    seen = [(i, rng.choice("abc"), rng.uniform(-19, 35), rng.uniform(-19, 33)) for i in range(4000)]
    o = spark.createDataFrame([*seen, (9001, "a", None, 3.0), (9002, None, 3.0, 3.0)], "n long, f string, px double, py double")
    m = spark.createDataFrame(sorted(mask), "f string, ix long, iy long")
    got = core_clear(o, m.unionAll(m.limit(50)), ["f"])
    want = {n for n, f, x, y in seen if all((f, math.floor(x) + a, math.floor(y) + b) in mask for a in (-1, 0, 1) for b in (-1, 0, 1))}
    assert got.columns == o.columns and sorted(r.n for r in got.collect()) == sorted(want) and 100 < len(want) < 3900
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain()
    assert "bit_or" in out.getvalue() and "count(1)" not in out.getvalue()


def test_anchors_by_tiles(spark):
    """Anchors go by the packed mask, too."""
    from vantage.operators.observations import anchors

    rows = [(n, "a", 20.5 + n, 13.5, 3.0, 4, 9.0, 0.5) for n in range(12)] + [(99, "a", 14.5, 14.5, -1.0, 4, 9.0, 0.5)]
    o = spark.createDataFrame(rows, "n long, f string, px double, py double, depth_z double, support_station_count long, angle_deg double, reprojection_error_px double")
    m = spark.createDataFrame([("a", x, y) for x in range(13, 30) for y in range(12, 15)], "f string, ix long, iy long")
    got = anchors(o, ["f"], m, 1024, 1024, 3, 4.0, 1.5)
    assert sorted(r.n for r in got.collect()) == list(range(9)) and "bit_or" in got._jdf.queryExecution().toString()


def test_complete_link_dense(spark):
    """One connected patch of many places, against the plain rule by numpy; pairs of places are never made."""
    import random
    import time

    from vantage.operators.stations import complete_link

    rng = random.Random(8)
    rows = [(i, 37.5 + rng.uniform(0, 4e-3), 127 + rng.uniform(0, 4e-3)) for i in range(20000)]
    began = time.time()
    got = {r.id: r.group_id for r in complete_link(spark.createDataFrame(rows, "id long, lat double, lng double"), 5.0).collect()}
    assert len(got) == len(rows) and time.time() - began < 60
    la, lo = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    groups: dict[int, list[int]] = {}
    # Groups meet only places that are near their first member, here found by all distances.
    for i in range(3000):
        h = np.sin((la[:i] - la[i]) / 2) ** 2 + np.cos(la[:i]) * np.cos(la[i]) * np.sin((lo[:i] - lo[i]) / 2) ** 2
        near = set(np.flatnonzero(2 * 6371008.8 * np.arcsin(np.sqrt(h)) <= 5.0).tolist())
        k = next((g for g in sorted(near & groups.keys()) if all(m in near for m in groups[g])), i)
        groups.setdefault(k, []).append(i)
        assert got[i] == k


def test_projected_pairs_stay_in_place(spark):
    """A full cell and far ones against numpy; no pair of a cell or a point with a view goes through a shuffle."""
    import random

    from vantage.operators import evidence

    rng = random.Random(4)
    pts = [(i, rng.gauss(0, 12), rng.gauss(0, 12), rng.gauss(0, 12)) for i in range(300)] + [(300 + i, 1.0 + i / 1e4, 2.0, 9.0) for i in range(700)]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = [(f"v{k}", k, rng.gauss(0, 5), rng.gauss(0, 5), rng.gauss(0, 5), 100.0, 100.0, 128.0, 64.0, 256, 128, *eye) for k in range(20)]
    names = "frame_name string, station_id long, cx double, cy double, cz double, fl_x double, fl_y double, pp_x double, pp_y double, w int, h int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3))
    got = evidence.projected(spark.createDataFrame(pts, "row_id long, x double, y double, z double"), spark.createDataFrame(views, names))
    want = set()
    for v in views:
        for i, x, y, z in pts:
            d = z - v[4]
            if d > 0 and 0 <= 100 * (x - v[2]) / d + 128 < 256 and 0 <= 100 * (y - v[3]) / d + 64 < 128:
                want.add((i, v[0]))
    rows = got.select("row_id", "frame_name").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and plan.index("CartesianProduct") < plan.index("Join")


def test_nearest_stations_in_blocks(spark, monkeypatch):
    """Against all distances: ties, stations at one place, far queries, fewer stations than asked for; only pairs of blocks are joined."""
    import random

    from vantage.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = random.Random(5)
    for n, spread in ((400, 9.0), (300, 0.0), (2, 1.0)):
        stations = [(float(rng.randrange(12)) * spread, rng.uniform(-2, 2), float(rng.randrange(12)) * spread) for _ in range(n)]
        queries = [(i, rng.uniform(-100, 200), 0.0, rng.uniform(-100, 200)) for i in range(150)] + [(1000 + i, float(i), 0.0, 9.0) for i in range(30)] + [(2000, None, 0.0, 1.0)]
        out = neighbours.nearest_stations(spark.createDataFrame(queries, "id long, x double, y double, z double"), spark.createDataFrame(stations, "x double, y double, z double"), 3)
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        want = set()
        for i, x, _, z in queries[:-1]:
            d = sorted((math.sqrt((s[0] - x) * (s[0] - x) + (s[2] - z) * (s[2] - z)), s[1]) for s in stations)
            near = [-y for e, y in d if e <= d[min(3, n) - 1][0] * (1 + 128 * 2.220446049250313e-16)] if n >= 3 else [-y for _, y in d]
            want.add((i, max(near), len(near)))
        assert {tuple(r) for r in out.collect()} == want


def test_anchor_observations_shuffles_no_pixels(spark):
    """Observations go to their station once for the mask and once for the lookup; pixels and tiles of the mask don't."""
    from vantage.plans.queries import QUERIES

    plan = QUERIES["anchor_observations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and all("hashpartitioning(station_id#" in x and "tx" not in x for x in dealt)
