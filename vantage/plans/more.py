"""Further registered queries: functions and operators that other queries don't run on their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import capture, geo
from ..operators import captures, evidence, lineage, neighbours, observations, pages, raster, rig, sampling, sightings, sky, stations
from ..sources.views import table, view
from .queries import _ALONG, _CROSS, _DIST, _PROJ, _SCENE, _SPREAD, _names, _poses, _r, _with_spread, query

_LINEAR = "CASE WHEN {0}<=0.04045::DOUBLE THEN {0}/12.92::DOUBLE ELSE pow(({0}+0.055::DOUBLE)/1.055::DOUBLE,2.4::DOUBLE) END"
_SRGB = "CASE WHEN {0}<=0.0031308::DOUBLE THEN {0}*12.92::DOUBLE ELSE 1.055::DOUBLE*pow({0},1/2.4::DOUBLE)-0.055::DOUBLE END"


@query("v_gaussian", "SELECT row_id, round(abs(opacity)*z/sqrt(x*x+y*y+z*z),6) z FROM v_gaussian")
def radial_depth(spark, sf_dir):
    return view(spark, sf_dir, "v_gaussian").select("row_id", _r("z", geo.radial_to_z(F.abs("opacity"), F.col("x"), F.col("y"), F.col("z"))))


@query("v_gaussian", f"WITH v AS (SELECT row_id, abs(rot_0) a FROM v_gaussian), l AS (SELECT row_id, a, {_SRGB.format('a')} s FROM v) SELECT row_id, round(s,6) encoded, round({_LINEAR.format('s')},5) again FROM l")
def srgb_both_ways(spark, sf_dir):
    own = view(spark, sf_dir, "v_gaussian").select("row_id", geo.linear_to_srgb(F.abs("rot_0")).alias("s"))
    return own.select("row_id", _r("encoded", F.col("s")), _r("again", geo.srgb_to_linear(F.col("s")), 5))


@query("v_gaussian", "SELECT row_id, round(degrees(x)-floor(degrees(x)/360)*360,5) heading FROM v_gaussian")
def headings(spark, sf_dir):
    return view(spark, sf_dir, "v_gaussian").select("row_id", _r("heading", geo.heading_degrees(F.col("x")), 5))


@query("v_capture", "SELECT pano_id FROM v_capture WHERE lat*(1+pano_id%3) BETWEEN -90 AND 90 AND lng*(1+(pano_id%7)/6) BETWEEN -180 AND 180")
def valid_places(spark, sf_dir):
    c = view(spark, sf_dir, "v_capture")
    return c.where(geo.valid_place(F.col("lat") * (1 + F.col("pano_id") % 3), F.col("lng") * (1 + (F.col("pano_id") % 7) / 6))).select("pano_id")


@query("v_link v_capture", """WITH l AS (SELECT src, list(struct_pack(id := CASE WHEN dst%11=0 THEN 'bad id' ELSE CAST(dst AS VARCHAR) END, lat := lat*(1+dst%3), lng := lng) ORDER BY dst) ls FROM v_link JOIN v_capture ON pano_id=dst GROUP BY src)
SELECT src, CAST(len(list_filter(ls, lambda x: x.id<>'bad id' AND abs(x.lat)<=90)) AS BIGINT) links FROM l""")
def clean_links(spark, sf_dir):
    c = view(spark, sf_dir, "v_capture").select(F.col("pano_id").alias("dst"), "lat", "lng")
    one = F.struct(F.when(F.col("dst") % 11 == 0, F.lit("bad id")).otherwise(F.col("dst").cast("string")).alias("id"), (F.col("lat") * (1 + F.col("dst") % 3)).alias("lat"), "lng")
    return view(spark, sf_dir, "v_link").join(c, "dst").groupBy("src").agg(F.size(capture.clean_links(F.collect_list(one))).cast("long").alias("links"))


@query("v_capture", "SELECT pano_id, CAST('0x'||substr(sha256('seed:'||pano_id),1,8) AS BIGINT)%2147483648 seed FROM v_capture")
def station_seeds(spark, sf_dir):
    return view(spark, sf_dir, "v_capture").select("pano_id", capture.seed(F.concat(F.lit("seed:"), F.col("pano_id").cast("string"))).alias("seed"))


@query("v_capture", "WITH g AS (SELECT pano_id%50 k, list(CAST(pano_id AS VARCHAR) ORDER BY CAST(pano_id AS VARCHAR)) m FROM v_capture GROUP BY 1) SELECT k, 'station_'||substr(sha256('[\"'||array_to_string(m,'\",\"')||'\"]'),1,20) station FROM g")
def station_ids(spark, sf_dir):
    members = F.collect_list(F.col("pano_id").cast("string"))
    return view(spark, sf_dir, "v_capture").groupBy((F.col("pano_id") % 50).alias("k")).agg(capture.station_id(members).alias("station"))


@query("", "SELECT p_partkey, trim(substr(regexp_replace(p_name||' / #'||p_partkey||' ..é','[^A-Za-z0-9._-]+','_','g'),1,64)) label FROM part")
def sanitised_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", capture.sanitised(F.concat("p_name", F.lit(" / #"), F.col("p_partkey").cast("string"), F.lit(" ..é"))).alias("label"))


@query("v_camera", f"WITH {_SCENE} SELECT round(1.1::DOUBLE*radius,6) radius FROM scene")
def refine_radius(spark, sf_dir):
    return stations.scene(view(spark, sf_dir, "v_camera"), factor=1.1).select(_r("radius"))


@query("v_gaussian v_pose v_depth", f"WITH {_PROJ} SELECT row_id, s.frame_name, d.depth surface FROM s LEFT JOIN v_depth d ON d.frame_name=s.frame_name AND d.tx=floor(u) AND d.ty=floor(v) WHERE s.depth<60")
def pixel_lookup(spark, sf_dir):
    def make(pts, vws, p, v):
        pixels = sightings.Pixels(vws)

        def columns(e):
            near = np.flatnonzero(e["depth"] < 60)
            e = {n: x[near] for n, x in e.items()}
            of, surface = pixels.under(e["view"], e["u"], e["v"])
            return [*_names(pts, vws, e if of is None else {n: x[of] for n, x in e.items()}), surface]

        return columns

    pixels = view(spark, sf_dir, "v_depth").select("frame_name", F.col("tx").alias("ix"), F.col("ty").alias("iy"), F.col("depth").alias("surface"))
    points = view(spark, sf_dir, "v_gaussian").select("row_id", "x", "y", "z")
    return sightings.pairs(points, sightings.with_pixels(_poses(spark, sf_dir), pixels, "surface"), make, "row_id long, frame_name string, surface double")


@query("v_observation", "SELECT point_id row_id, station_id frame_name, count(*) FILTER (angle_deg>=2) \"valid\", count(*) FILTER (angle_deg>=2)>=2 AND count(*) FILTER (angle_deg>=2 AND depth_z>=30)=0 \"free\" FROM v_observation GROUP BY 1,2")
def footprint_samples(spark, sf_dir):
    o = view(spark, sf_dir, "v_observation").select(F.col("point_id").alias("row_id"), F.col("station_id").alias("frame_name"), (F.col("angle_deg") >= 2).alias("valid"), (F.col("depth_z") < 30).alias("free"))
    return evidence.footprint_samples(o, 2)


_UNIT = "n AS (SELECT row_id id, x/sqrt(x*x+y*y+z*z) x, y/sqrt(x*x+y*y+z*z) y, z/sqrt(x*x+y*y+z*z) z FROM v_gaussian)"


@query("v_gaussian", f"""WITH {_UNIT}, m AS (SELECT a.id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))) d FROM n a JOIN n b ON b.id%25=0 GROUP BY a.id), g AS (SELECT id, CASE WHEN degrees(2*asin(least(1,d/2)))<=20 THEN degrees(2*asin(least(1,d/2))) END angle FROM m)
SELECT id, round(angle,4) angle, round(coalesce(1-pow(angle/20,2)*(3-2*angle/20),0),6) weight FROM g""")
def sphere_nearest(spark, sf_dir):
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    unit = view(spark, sf_dir, "v_gaussian").select(F.col("row_id").alias("id"), *((F.col(c) / n).alias(c) for c in "xyz"))
    return neighbours.sphere_nearest(unit, unit.where("id % 25 = 0"), 20.0).select("id", _r("angle", digits=4), _r("weight"))


@query("v_observation", "SELECT min(source_row) source_row FROM v_observation WHERE angle_deg>=2 GROUP BY point_id, floor(px/64), floor(py/64)")
def unique_pixels(spark, sf_dir):
    o = view(spark, sf_dir, "v_observation").select("point_id", "source_row", (F.col("angle_deg") >= 2).alias("valid"), F.floor(F.col("px") / 64).alias("ix"), F.floor(F.col("py") / 64).alias("iy"))
    return observations.unique_pixels(o, "point_id", ["ix", "iy"], "source_row").select("source_row")


@query("", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) place FROM orders ORDER BY place LIMIT 50")
def newest_first(spark, sf_dir):
    top = lineage.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").limit(50)
    from pyspark.sql.window import Window

    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_orderdate").desc(), "o_orderkey")).cast("long").alias("place"))


@query("v_depth", "SELECT tx x, ty y, max(confidence) score FROM v_depth WHERE confidence>0.5::DOUBLE GROUP BY 1,2")
def score_gate(spark, sf_dir):
    d = view(spark, sf_dir, "v_depth").select(F.lit("a").alias("image"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("confidence").alias("score"))
    return raster.union_masks(d, 0.5).select("x", "y", "score")


@query("v_depth", f"""WITH p AS (SELECT frame_name, tx, ty, depth o, 255-depth u, confidence a FROM v_depth), m AS (SELECT *, ({_LINEAR.format('(o/255)')})*a+({_LINEAR.format('(u/255)')})*(1-a) x FROM p)
SELECT frame_name, tx, ty, CASE WHEN a=0 THEN u ELSE round_even(255*({_SRGB.format('x')}),0) END v FROM m""")
def alpha_composite(spark, sf_dir):
    own = raster.composite(F.col("depth"), 255 - F.col("depth"), F.col("confidence"))
    return view(spark, sf_dir, "v_depth").select("frame_name", "tx", "ty", own.cast("double").alias("v"))


@query("v_pose", "SELECT frame_name, station_id%4<>0 rigid FROM v_pose")
def rigid_poses(spark, sf_dir):
    p = view(spark, sf_dir, "v_pose").withColumn("r00", F.when(F.col("station_id") % 4 == 0, F.col("r00") + 0.01).otherwise(F.col("r00")))
    return p.select("frame_name", geo.rigid([F.col(f"r{i}{j}") for i in range(3) for j in range(3)]).alias("rigid"))


@query("v_capture", "WITH c AS (SELECT row_number() OVER (ORDER BY sha256('7:'||CAST(pano_id AS VARCHAR)), pano_id) n, pano_id FROM v_capture) SELECT pano_id FROM c WHERE n<=30")
def small_subsample(spark, sf_dir):
    return sampling.subsample(view(spark, sf_dir, "v_capture").select("pano_id"), "pano_id", 7, 30)


@query("v_view_metric", """WITH a AS (SELECT frame, category, static_pixels FROM v_view_metric), b AS (SELECT frame, category, CASE WHEN frame%17=0 THEN static_pixels+1 ELSE static_pixels END static_pixels FROM v_view_metric WHERE frame%23<>0)
SELECT *, 'stored' side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'computed' FROM (FROM b EXCEPT ALL FROM a)""")
def replayed_report(spark, sf_dir):
    a = view(spark, sf_dir, "v_view_metric").select("frame", "category", "static_pixels")
    b = a.where("frame % 23 <> 0").withColumn("static_pixels", F.when(F.col("frame") % 17 == 0, F.col("static_pixels") + 1).otherwise(F.col("static_pixels")))
    return lineage.replayed(a, b)


_AX = [[f"r{i}{j}" for i in range(3)] for j in range(3)]


def _tangent(x: str, j: int, sign: str) -> str:
    """x / z at a tangent of the ellipsoid of three deviations, by its quadratic's formula."""
    xx, xz, zz = f"v{j}{j}", f"v{j}2", "v22"
    return f"(({x}*depth-9*{xz}){sign}sqrt(greatest(0,pow({x}*depth-9*{xz},2)-(depth*depth-9*{zz})*({x}*{x}-9*{xx}))))/(depth*depth-9*{zz})"


_VARS = ", ".join([f"{_ALONG.format(*_AX[j])} v{j}{j}" for j in range(3)] + [f"{_CROSS.format(*_AX[j], *_AX[2])} v{j}2" for j in range(2)])


@query("v_gaussian v_pose", f"""WITH {_PROJ}, {_SPREAD}, b AS (SELECT s.row_id, frame_name, depth, xc, yc, fl_x, fl_y, pp_x, pp_y, {_VARS.replace('v0*', 'm3.v0*').replace('v1*', 'm3.v1*').replace('v2*', 'm3.v2*')}
FROM (SELECT s.*, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM s JOIN (SELECT frame_name, r00, r01, r02, r10, r11, r12, r20, r21, r22 FROM v_pose) USING (frame_name)) s JOIN (SELECT * REPLACE (v0/54.598150033144236 AS v0, v1/54.598150033144236 AS v1, v2/54.598150033144236 AS v2) FROM m3) m3 ON m3.row_id=s.row_id)
SELECT row_id, frame_name, round(depth-3*sqrt(v22),4) front, round(fl_x*{_tangent('xc', 0, '-')}+pp_x,2)+0 u_low, round(fl_x*{_tangent('xc', 0, '+')}+pp_x,2)+0 u_high, round(fl_y*{_tangent('yc', 1, '-')}+pp_y,2)+0 v_low, round(fl_y*{_tangent('yc', 1, '+')}+pp_y,2)+0 v_high FROM b WHERE depth>5*sqrt(v22)""")
def perspective_bounds(spark, sf_dir):
    names = ("u_low", "u_high", "v_low", "v_high")

    def make(pts, vws, p, v):
        def at(e):
            return lambda n: e[n] if n in e else p[n][e["point"]] if n in p else v[n][e["view"]]

        def columns(e):
            far = np.flatnonzero(e["depth"] > 5 * np.sqrt(np.maximum(0.0, evidence.depth_variance(at(e)))))
            e = {n: x[far] for n, x in e.items()}
            b = evidence.perspective_bounds(at=at(e), of=evidence.Arrays)
            told = np.flatnonzero(b["numeric"])
            e, b = ({n: x[told] for n, x in d.items()} for d in (e, b))
            return [*_names(pts, vws, e), sightings.rounded(b["front"], 4), *(sightings.rounded(b[n], 2) + 0.0 for n in names)]

        return columns

    return sightings.pairs(_with_spread(spark, sf_dir, 2), _poses(spark, sf_dir), make, "row_id long, frame_name string, front double, " + ", ".join(f"{n} double" for n in names))


@query()
def rig_coverage(spark, sf_dir):
    """A rig and rays of fixed size, which no table holds; tests hold it against numpy."""
    return rig.coverage(rig.sphere_rays(spark, 256, 128), rig.views(spark))


@query("v_observation", """WITH o AS (SELECT *, CAST(floor(px) AS BIGINT) ix, CAST(floor(py) AS BIGINT) iy FROM v_observation), m AS (SELECT DISTINCT station_id, ix+a x, iy+b y FROM o, range(-1,3) r(a), range(-1,2) q(b))
SELECT source_row FROM o WHERE depth_z>0 AND support_station_count>=3 AND angle_deg>=4 AND reprojection_error_px<=1.5::DOUBLE AND ix BETWEEN 1 AND 1022 AND iy BETWEEN 1 AND 1022 AND (SELECT count(*) FROM m WHERE m.station_id=o.station_id AND abs(m.x-o.ix)<=1 AND abs(m.y-o.iy)<=1)=9""")
def anchor_observations(spark, sf_dir):
    # Each station's distinct pixels are dealt out as one array of whole numbers, put together before the shuffle; the mask's pixels, twelve
    # times as many, are made of them after it. Only pixels at most two outside the image can reach an anchor's neighbours.
    o = view(spark, sf_dir, "v_observation").repartition("station_id")
    ix, iy = F.floor("px"), F.floor("py")
    near = view(spark, sf_dir, "v_observation").where(ix.between(-2, 1025) & iy.between(-2, 1025))
    own = near.select("station_id", ((ix + 2) * 2048 + iy + 2).cast("int").alias("_p")).groupBy("station_id").agg(F.collect_set("_p").alias("_p")).select("station_id", F.explode("_p").alias("_p"))
    own = own.select("station_id", (F.floor(F.col("_p") / 2048) - 2).cast("long").alias("x"), (F.col("_p") % 2048 - 2).cast("long").alias("y"))
    at = own.select("station_id", "x", "y", F.explode(F.sequence(F.lit(-1), F.lit(2))).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    mask = at.select("station_id", (F.col("x") + F.col("a")).alias("ix"), (F.col("y") + F.col("b")).alias("iy"))
    return observations.anchors(o, ["station_id"], mask, 1024, 1024, 3, 4.0, 1.5).select("source_row")


@query("v_depth v_pose", "SELECT DISTINCT frame_name, station_id FROM v_depth JOIN v_pose USING (frame_name) WHERE depth>130 AND confidence<0.5::DOUBLE")
def eligible_frames(spark, sf_dir):
    p = view(spark, sf_dir, "v_depth").join(view(spark, sf_dir, "v_pose").select("frame_name", "station_id"), "frame_name")
    return observations.eligible_frames(p.select("frame_name", "station_id", (F.col("depth") > 130).alias("sky"), (F.col("confidence") >= 0.5).alias("foreground")), "frame_name", 2)


@query("v_observation", "SELECT point_id, station_id image_id, source_row point2d, 'f'||station_id source FROM v_observation WHERE station_id%3<>0 AND station_id%5<>1")
def track_rows(spark, sf_dir):
    o = view(spark, sf_dir, "v_observation")
    points = o.groupBy("point_id").agg(F.collect_list(F.struct(F.col("station_id").alias("image_id"), F.col("source_row").alias("point2d"))).alias("track"))
    ids = o.select(F.col("station_id").alias("image_id")).distinct()
    images = ids.select("image_id", F.concat(F.lit("n"), F.col("image_id").cast("string")).alias("name"), (F.col("image_id") % 3 != 0).alias("has_pose"))
    sources = ids.where("image_id % 5 <> 1").select(F.concat(F.lit("n"), F.col("image_id").cast("string")).alias("name"), F.concat(F.lit("f"), F.col("image_id").cast("string")).alias("source"))
    return observations.tracks(points, images, sources).select("point_id", "image_id", "point2d", "source")


@query("v_camera", "SELECT concat('a/b/', frame_name) file_path, CASE WHEN station_id%4<>0 THEN concat('d/', frame_name) END depth_path FROM v_camera")
def depth_by_name(spark, sf_dir):
    c = view(spark, sf_dir, "v_camera").select("station_id", "frame_name")
    depths = c.where("station_id % 4 <> 0").select(F.concat(F.lit("other/"), "frame_name").alias("image"), F.concat(F.lit("d/"), "frame_name").alias("depth_path"))
    return observations.bound_by_name(c.select(F.concat(F.lit("a/b/"), "frame_name").alias("file_path")), depths)


@query("v_camera", "SELECT frame_name image, station_id*2 metric, station_id*3 pose FROM v_camera WHERE station_id%2=0")
def paired_depths(spark, sf_dir):
    c = view(spark, sf_dir, "v_camera").select(F.col("frame_name").alias("image"), F.sha2("frame_name", 256).alias("source_sha256"), "station_id")
    return observations.paired_depths(c.select("image", "source_sha256", (F.col("station_id") * 2).alias("metric")), c.where("station_id % 2 = 0").select("image", "source_sha256", (F.col("station_id") * 3).alias("pose"))).select("image", "metric", "pose")


@query("v_camera", "SELECT face, count(*) frames, count(*) FILTER (station_id%3=0) accepted_frames, CAST(coalesce(sum(station_id) FILTER (station_id%3=0),0) AS BIGINT) pixels FROM v_camera GROUP BY 1")
def face_tallies(spark, sf_dir):
    c = view(spark, sf_dir, "v_camera")
    return observations.face_tallies(c.select("face", (F.col("station_id") % 3 == 0).alias("accepted"), F.col("station_id").alias("pixels")))


@query("v_pose", """WITH s AS (SELECT station_id, avg(cx) cx, avg(cy) cy, avg(cz) cz FROM v_pose GROUP BY 1), m AS (SELECT avg(cx) x, avg(cy) y, avg(cz) z FROM s), c AS (SELECT station_id FROM s, m ORDER BY sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)), CAST(station_id AS VARCHAR) LIMIT 1)
SELECT frame_name FROM v_pose WHERE station_id=(FROM c) ORDER BY face<>'F', abs(r12), frame_name LIMIT 1""")
def preferred_view(spark, sf_dir):
    return stations.preferred_view(view(spark, sf_dir, "v_pose").withColumn("frame_index", F.col("frame_name"))).select("frame_name")


@query("v_view_metric", "SELECT station_id, n, p FROM (SELECT station_id, count(*) n, CAST(sum(static_pixels) AS BIGINT) p FROM v_view_metric GROUP BY 1) ORDER BY n DESC, p DESC, station_id DESC LIMIT 1")
def best_model(spark, sf_dir):
    m = view(spark, sf_dir, "v_view_metric").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("static_pixels").alias("p"))
    return stations.best_first(m, ["n", "p", "station_id"])


@query("v_link v_capture", f"""WITH RECURSIVE n AS (SELECT pano_id id FROM v_capture WHERE {_DIST} <= 900 OR pano_id=1), r AS (SELECT CAST(1 AS BIGINT) id UNION SELECT l.dst FROM r JOIN v_link l ON l.src=r.id JOIN n ON n.id=l.dst WHERE r.id%6<>3)
SELECT id, CASE WHEN id%6=3 THEN 'failed' ELSE 'found' END status FROM r""")
def discovery_within(spark, sf_dir):
    # The first capture is moved to the centre, so that there is a start within the radius.
    c = view(spark, sf_dir, "v_capture").withColumns({"lat": F.when(F.col("pano_id") == 1, 37.51).otherwise(F.col("lat")), "lng": F.when(F.col("pano_id") == 1, 127.01).otherwise(F.col("lng"))})
    failed = c.where("pano_id % 6 = 3").select(F.col("pano_id").alias("id"))
    return captures.discover_within(view(spark, sf_dir, "v_link"), c, [1], 37.51, 127.01, 900.0, failed).select("id", "status")


@query("", "WITH g AS (SELECT n_nationkey id, n_name label, n_regionkey grp FROM nation) SELECT CAST(grp AS VARCHAR) \"group\", array_to_string(list(id ORDER BY id), ',') ids FROM g GROUP BY 1")
def class_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    out = sky.class_groups(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), n.select(F.col("n_regionkey").cast("string").alias("group"), F.concat(F.lit(" "), F.lower("n_name")).alias("name")))
    return out.select("group", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("", "WITH r AS (SELECT o_custkey k, o_orderkey v, epoch(o_orderdate) t FROM orders), l AS (SELECT k, max((t, v))[2] v, max(t) t FROM r GROUP BY 1) SELECT k, v FROM l WHERE (SELECT max(t) FROM r)-t <= 86400*400")
def unexpired_latest(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t"))
    now = r.agg(F.max("t")).first()[0]
    return pages.unexpired(pages.latest(r, "k", "t"), "t", now, 86400.0 * 400).select("k", "v")
