"""Trajectory-shaped tables derived from the benchmark's star schema, the same in Spark SQL and DuckDB SQL.

FIXTURES.md states what each one stands for. `sql(name, dialect)` gives a table's query; `view(spark, sf_dir, name)` its DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = {
    "spark": {"{EP}": "(unix_micros(cast(ts as timestamp))-1704067200000000)", "{K}": "cast(get_json_object(props,'$.k') as int)", "{EL}": "embedding[cast(i as int)]", "{IDX}": "explode(sequence(0,63))", "{E}": "embedding[{}]", "D#": "D"},
    "duckdb": {"{EP}": "(epoch_us(ts)-1704067200000000)", "{K}": "cast(json_extract(props,'$.k') as int)", "{EL}": "embedding[i+1]", "{IDX}": "unnest(range(0,64))", "{E}": "embedding[{}+1]", "D#": ""},
}
_POSE = ", ".join(f"cast(@{k}@ as double) as {n}" for k, n in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))) + ", cast(0.5 as double)+abs(cast(@7@ as double)) as fov_h, cast(0.5 as double)+abs(cast(@8@ as double)) as fov_w"
QUERIES = {
    "detections": """select row_id,video_id,frame_id,track_id,class_name,confidence,x1,y1,x2,y2,pos_n,pos_e,
 case when row_id % 7 = 0 or class_name <> 'person' then null else cast((track_id + cast(floor(cast(frame_id as double)/8) as int)) % 9 + 1 as int) end as crowd_id, ts
from (select event_id as row_id, cast(user_id % 3 as int) as video_id, cast(floor({EP}/cast(21600000000 as double)) as int) as frame_id, user_id+1 as track_id,
 case when event_type='error' then 'car' else 'person' end as class_name,
 cast(0.5 as double)+cast(event_id % 50 as double)/100 as confidence,
 cast((event_id*37) % 1180 as double) as x1, cast((event_id*53) % 620 as double) as y1,
 cast((event_id*37) % 1180 + 20 + event_id % 80 as double) as x2, cast((event_id*53) % 620 + 40 + event_id % 60 as double) as y2,
 cast(8*(user_id % 5) as double)+cast({K} as double)/20 as pos_n,
 cast(8*(cast(floor(cast(user_id as double)/5) as int) % 5) as double)+cast(event_id % 97 as double)/20 as pos_e, ts,
 row_number() over (partition by user_id, cast(floor({EP}/cast(21600000000 as double)) as int) order by ts desc, event_id desc) rn from events) q where rn=1""",
    "telemetry": """select cast(row_number() over (order by ts,event_id) - 1 as int) as seq, ts,
 cast(51.474 as double)+cast(event_id % 500 as double)/100000 as latitude, cast(-3.185 as double)+cast(event_id % 700 as double)/100000 as longitude,
 cast(40+event_id % 60 as double) as altitude, cast(-(10+event_id % 80) as double) as gimbal_pitch, cast((event_id*7) % 360 - 180 as double) as gimbal_yaw, cast(event_id % 5 - 2 as double) as gimbal_roll,
 cast((event_id*11) % 360 - 180 as double) as drone_yaw, cast(event_id % 9 - 4 as double) as drone_roll,
 case event_id % 4 when 0 then 'Follow Yaw' when 1 then 'FPV' when 2 then 'Free' else 'Lock' end as gimbal_mode,
 case when event_id % 10 = 0 then 'FALSE' when event_id % 3 = 0 then 'true' else 'TRUE' end as is_video,
 cast(event_id % 7 - 3 as double)/2 as vel_north, cast(event_id % 11 - 5 as double)/2 as vel_east, cast(0 as double) as vel_down
from events where event_type='view'""",
    "polygon_vertices": """select name, ring_id, seq, cn + dn*h as n, ce + de*h as e from (
 select n_name as name, 0 as ring_id, cast(8*(n_nationkey % 5) as double) as cn, cast(8*cast(floor(cast(n_nationkey as double)/5) as int) as double) as ce,
  cast(2.013 as double) + n_nationkey % 3 as h, n_nationkey % 2 as shape from nation
 union all select r_name, 0, cast(16 as double), cast(8*r_regionkey as double), cast(9.013 as double), 0 from region) p
 join (select * from (values (0,0,-1e0,-1e0),(0,1,-1e0,1e0),(0,2,1e0,1e0),(0,3,1e0,-1e0),(1,0,-1e0,0e0),(1,1,0e0,1e0),(1,2,1e0,0e0),(1,3,0e0,-1e0)) v(vshape,seq,dn,de)) v on p.shape=v.vshape""",
    "graph_edges": """select a.n_nationkey as src, b.n_nationkey as dst, 0 as k, cast(8 + (a.n_nationkey*7+b.n_nationkey*3) % 5 as double) as length,
 cast(8*(a.n_nationkey % 5) as double) as x1, cast(8*cast(floor(cast(a.n_nationkey as double)/5) as int) as double) as y1,
 cast(8*(b.n_nationkey % 5) as double) as x2, cast(8*cast(floor(cast(b.n_nationkey as double)/5) as int) as double) as y2
 from nation a join nation b on abs(a.n_nationkey % 5 - b.n_nationkey % 5) + abs(cast(floor(cast(a.n_nationkey as double)/5) as int) - cast(floor(cast(b.n_nationkey as double)/5) as int)) = 1""",
    "depth_pixels": """select cast(vec_id as int) as frame_id, cast(floor(cast(i as double)/8) as int) as v, cast(i % 8 as int) as u, cast(10 as double)+20*abs(cast({EL} as double)) as depth
 from embeddings cross join (select {IDX} as i) t""",
    "poses": f"select cast(vec_id as int) as frame_id, {_POSE} from embeddings",
}


#: Spark numbers the telemetry's rows within hours and adds how many come before each hour, from a table of a row per hour; the numbers are those of one sort over all.
NUMBERED = (
    ("cast(row_number() over (order by ts,event_id) - 1 as int)", "cast(row_number() over (partition by e.hour_no order by ts,event_id) - 1 + earlier as int)"),
    ("from events where event_type='view'", """from (select *, cast(floor({EP}/cast(3600000000 as double)) as bigint) as hour_no from events where event_type='view') e
 join (select hour_no as h, sum(n) over (order by hour_no) - n as earlier from (select cast(floor({EP}/cast(3600000000 as double)) as bigint) as hour_no, count(*) as n from events where event_type='view' group by 1)) on h = e.hour_no"""),
)


def sql(name: str, dialect: str) -> str:
    text = QUERIES[name]
    for before, after in NUMBERED if (name, dialect) == ("telemetry", "spark") else ():
        text = text.replace(before, after)
    for token, value in TOKENS[dialect].items():
        text = text.replace(token, value)
    for k in range(9):
        text = text.replace(f"@{k}@", TOKENS[dialect]["{E}"].format(k))
    return text


BASE = {"detections": "events", "telemetry": "events", "polygon_vertices": "nation", "graph_edges": "nation", "depth_pixels": "embeddings", "poses": "embeddings"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter's rows over the parquet tables under sf_dir."""
    text = sql(name, "spark")
    for table in ("events", "nation", "region", "embeddings"):
        for word in ("from", "join"):
            text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "nation", "region", "embeddings") if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """`with a as (...), b as (...)` in DuckDB SQL, for oracles."""
    return "with " + ", ".join(f"{n} as ({sql(n, 'duckdb')})" for n in names)
