"""Capture, camera, Gaussian and observation views over the star-schema tables.

One text serves both engines: ``{table}`` names a table, and ``{e(i)}`` stands for component i of an embedding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "v_gaussian": "SELECT vec_id AS row_id, " + ", ".join(
        f"{{e{i}}}{scale} AS {name}"
        for i, (name, scale) in enumerate([("x", "*200"), ("y", "*200"), ("z", "*200"), ("scale_0", "*8+1"), ("scale_1", "*8+1"), ("scale_2", "*8+1"), ("rot_0", ""), ("rot_1", ""), ("rot_2", ""), ("rot_3", ""), ("opacity", "*10")])
    ) + ", label FROM {embeddings}",
    "v_camera": "SELECT s.s_suppkey AS station_id, f.face, concat(CAST(s.s_suppkey AS STRING), '_', f.face) AS frame_name, "
    "CAST((s.s_suppkey*7919)%10007 AS DOUBLE)/500-10 AS cx, CAST(s.s_suppkey AS DOUBLE)/100 AS cy, CAST((s.s_suppkey*1299)%10009 AS DOUBLE)/500-10 AS cz "
    "FROM {supplier} s CROSS JOIN (SELECT * FROM (VALUES ('F'),('R'),('B'),('L'),('U'),('D')) AS t(face)) f",
    "v_pose": "SELECT station_id, face, frame_name, cx, cy, cz, "
    + ", ".join(
        f"co*{c}x + si*(st*{c}y + ct*{c}z) AS r0{j}, ct*{c}y - st*{c}z AS r1{j}, co*(st*{c}y + ct*{c}z) - si*{c}x AS r2{j}" for j, c in enumerate("rdf")
    )
    + ", fl_x, fl_y, pp_x, pp_y, w, h FROM (SELECT s.s_suppkey AS station_id, t.*, concat(CAST(s.s_suppkey AS STRING), '_', t.face) AS frame_name, "
    "CAST((s.s_suppkey*7919)%10007 AS DOUBLE)/500-10 AS cx, CAST(s.s_suppkey AS DOUBLE)/100 AS cy, CAST((s.s_suppkey*1299)%10009 AS DOUBLE)/500-10 AS cz, "
    "cos(radians(CAST((s.s_suppkey*37)%360 AS DOUBLE))) AS co, sin(radians(CAST((s.s_suppkey*37)%360 AS DOUBLE))) AS si, "
    "cos(radians(CAST(s.s_suppkey%5-2 AS DOUBLE)/2)) AS ct, sin(radians(CAST(s.s_suppkey%5-2 AS DOUBLE)/2)) AS st, "
    "CAST(100+s.s_suppkey%7 AS DOUBLE) AS fl_x, CAST(100+s.s_suppkey%5 AS DOUBLE) AS fl_y, CAST(128 AS DOUBLE) AS pp_x, CAST(64 AS DOUBLE) AS pp_y, 256 AS w, 128 AS h FROM {supplier} s CROSS JOIN "
    "(SELECT * FROM (VALUES ('F',1,0,0,0,1,0,0,0,1),('R',0,0,-1,0,1,0,1,0,0),('B',-1,0,0,0,1,0,0,0,-1),('L',0,0,1,0,1,0,-1,0,0),('U',1,0,0,0,0,1,0,-1,0),('D',1,0,0,0,0,-1,0,1,0)) AS q(face,rx,ry,rz,dx,dy,dz,fx,fy,fz)) t) p",
    "v_depth": "SELECT frame_name, CAST(i%16 AS BIGINT) AS tx, CAST((i-i%16)/16 AS BIGINT) AS ty, CAST(40+(k*31+i*17)%97 AS DOUBLE) AS depth, CAST((k+i)%9 AS DOUBLE)/8 AS confidence FROM "
    "(SELECT concat(CAST(s_suppkey AS STRING), '_', t.face) AS frame_name, s_suppkey*6+t.n AS k FROM {supplier} CROSS JOIN (SELECT * FROM (VALUES ('F',0),('R',1),('B',2),('L',3),('U',4),('D',5)) AS q(face,n)) t) f, "
    "(SELECT a.v*16+b.v AS i FROM (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS q(v)) a CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15)) AS q(v)) b) n",
    "v_capture": "SELECT c.c_custkey AS pano_id, CAST(37500000+(c.c_custkey*7919)%20011 AS DOUBLE)/1000000 AS lat, CAST(127000000+(c.c_custkey*1299)%20021 AS DOUBLE)/1000000 AS lng, "
    "CASE c.c_custkey%12 WHEN 0 THEN NULL WHEN 1 THEN substr(o.d,1,7) WHEN 2 THEN substr(o.d,1,10) WHEN 4 THEN concat(substr(o.d,1,10),'junk') WHEN 5 THEN concat(substr(o.d,1,10),' 25:99:00') "
    "WHEN 6 THEN concat(substr(o.d,1,10),' 10:30') WHEN 7 THEN concat(' ',substr(o.d,1,10),'T',lpad(CAST(c.c_custkey%24 AS STRING),2,'0'),':15:07.25 ') WHEN 8 THEN concat(substr(o.d,1,8),'31') WHEN 9 THEN concat(substr(o.d,1,7),'-') "
    "ELSE concat(substr(o.d,1,10),' ',lpad(CAST(c.c_custkey%24 AS STRING),2,'0'),':30:00') END AS captured_at "
    "FROM {customer} c LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS STRING)) AS d FROM {orders} GROUP BY o_custkey) o ON o.o_custkey=c.c_custkey",
    "v_link": "SELECT DISTINCT o_custkey AS src, (o_orderkey*31+7)%(SELECT count(*) FROM {customer}) AS dst FROM {orders}",
    "v_observation": "SELECT l_partkey AS point_id, l_suppkey AS station_id, l_linenumber%6 AS face_ix, CASE WHEN l_suppkey%5=0 THEN 'heldout' ELSE 'train' END AS split, "
    "CAST(CAST(round(l_extendedprice*100) AS BIGINT)%102400 AS DOUBLE)/100 AS px, CAST((l_orderkey*37+l_linenumber)%1024 AS DOUBLE)+CAST(1 AS DOUBLE)/2 AS py, CAST(l_quantity AS DOUBLE) AS depth_z, "
    "1+l_orderkey%4 AS support_station_count, CAST(CAST(round(l_tax*100) AS BIGINT) AS DOUBLE) AS angle_deg, CAST(CAST(round(l_discount*100) AS BIGINT) AS DOUBLE)/4 AS reprojection_error_px, "
    "l_orderkey*10+l_linenumber AS source_row FROM {lineitem}",
    "v_view_metric": "SELECT frame, station_id, category, sp AS static_pixels, CASE WHEN sp>0 THEN ep/1000 ELSE CAST(0 AS DOUBLE) END AS before_sse, "
    "CASE WHEN sp>0 THEN ep*(1-dc+tx)/1000 ELSE CAST(0 AS DOUBLE) END AS after_sse, CASE WHEN sp>0 THEN CAST(round(dc*100) AS BIGINT)%3 ELSE 0 END AS new_hole_pixels "
    "FROM (SELECT l_orderkey*10+l_linenumber AS frame, min(l_suppkey) AS station_id, min(l_returnflag) AS category, min(CAST(l_quantity AS BIGINT))*20-20 AS sp, "
    "min(CAST(l_extendedprice AS DOUBLE)) AS ep, min(CAST(l_discount AS DOUBLE)) AS dc, min(CAST(l_tax AS DOUBLE)) AS tx FROM {lineitem} GROUP BY l_orderkey, l_linenumber) q",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = re.sub(r"\{e(\d+)\}", r"CAST(embedding[\1] AS DOUBLE)", VIEWS[name])
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def duck(*names: str) -> str:
    """The views as common table expressions for DuckDB, without the word WITH."""
    out = []
    for n in names:
        text = re.sub(r"\{e(\d+)\}", lambda m: f"CAST(embedding[{int(m[1]) + 1}] AS DOUBLE)", VIEWS[n])
        text = re.sub(r"\{(\w+)\}", r"\1", text).replace("AS STRING", "AS VARCHAR")
        out.append(f"{n} AS ({text})")
    return ", ".join(out)
