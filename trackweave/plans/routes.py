"""Queries of walkers' routes: the best paths to two stations, as nodes and as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import paths
from trackweave.plans.catalog import P, SQL, _snapped, query
from trackweave.sources.adapters import ctes

C = F.col
#: Where walkers go to.
STATIONS = (24, 6)

#: Trees by all sums of lengths up to 12 edges, the walkers' first steps, and their paths node by node.
_routes_sql = ctes("detections", "graph_edges").replace("with ", "with recursive ", 1) + f""", p as {P}, n as (select distinct src node, x1, y1 from graph_edges),
 s as (select row_id, arg_min(node, (round((pos_n-n.x1)*(pos_n-n.x1)+(pos_e-n.y1)*(pos_e-n.y1), 9), node)) node, (row_id*13 % 360)::double h, (row_id % 7)/4.0::double sp from p, n group by row_id),
 w as (select target, target node, 0::double dist, 0 hops from (values {', '.join(f'({t})' for t in STATIONS)}) v(target) union select w.target, e.src, w.dist + e.length, hops + 1 from w join graph_edges e on e.dst = w.node where hops < 12),
 t as (select target, node, dist, min(hops) hops from w where (target, node, dist) in (select target, node, min(dist) from w group by all) group by all),
 tree as (select t.target, t.node, t.dist, t.hops, min(u.node) nxt from t left join graph_edges e on e.src = t.node left join t u on u.target = t.target and u.node = e.dst and t.dist = e.length + u.dist and t.hops = u.hops + 1 group by all),
 x as (select row_id, target, s.node, sp, length + dist d, hops, dst, ((degrees(atan2(x2-x1, y2-y1)) + 360) % 360 - h + 360) % 360 b from s join graph_edges g on g.src = s.node join tree on tree.node = g.dst),
 y as (select *, row_number() over (partition by row_id, target order by case when least(b, 360 - b) <= 90 then 0 else 1 end, d, hops, dst) k from x),
 r as (select row_id, target, node, dst as first, round(d, 2) distance_m, round(d / greatest(sp, 0.5), 1) eta_s from y where k = 1),
 u as (select distinct target, first as start, 0 hop, first as node from r union all select u.target, start, hop + 1, nxt from u join tree on tree.target = u.target and tree.node = u.node where nxt is not null)"""


def _steps(d, g):
    people = _snapped(d, g).select("row_id", "node", ((C("row_id") * 13) % 360).cast("double").alias("heading_deg"), (C("row_id") % 7 / F.lit(4.0)).cast("double").alias("speed"))
    tree = paths.shortest_tree(g, STATIONS, cell=16.0)
    return paths.first_steps(people, g, tree), tree


@query("detections", "graph_edges")
def eta_routes(d, g):
    steps, tree = _steps(d, g)
    return paths.routes(steps, tree).select("row_id", "target", "distance_m", "eta_s", F.array_join(C("path").cast("array<string>"), "-").alias("path"))


@query("detections", "graph_edges")
def eta_route_lines(d, g):
    """Places as whole degrees, from the fixture's metres."""
    steps, tree = _steps(d, g)
    places = g.select(C("src").alias("node"), C("x1").alias("lon"), C("y1").alias("lat")).distinct()
    return paths.route_lines(steps, tree, places)


@query("graph_edges")
def station_tree(g):
    return paths.shortest_tree(g, STATIONS, cell=16.0)


SQL["eta_routes"] = _routes_sql + """ select row_id, r.target, distance_m, eta_s, r.node || '-' || string_agg(u.node::varchar, '-' order by hop) path from r join u on u.target = r.target and u.start = r.first group by row_id, r.target, distance_m, eta_s, r.node"""
SQL["eta_route_lines"] = _routes_sql + """, q as (select row_id, target, 0 hop, node from r union all select row_id, r.target, hop + 1, u.node from r join u on u.target = r.target and u.start = r.first)
 select row_id, target, '{"type":"LineString","coordinates":[' || string_agg(printf('[%.1f,%.1f]', x1, y1), ',' order by hop) || ']}' geojson from q join n using (node) group by row_id, target"""
SQL["station_tree"] = _routes_sql + " select target, node, dist, hops::bigint hops, nxt as next from tree"
