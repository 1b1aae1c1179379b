"""Queries of skein.operators.patterns and traverse."""

from pyspark.sql import functions as F

from skein.operators import patterns as J
from skein.operators import traverse as P
from skein.operators.similarity import first_similar
from skein.plans.registry import query


def _of(d, t):
    return d.nodes.where(F.col("node_type") == t)


@query("J1_edge_endpoint_join", "select e.id, a.node_name src_name, b.node_name dst_name from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst where e.edge_type = 'HANDLED_BY'", "nodes edges")
def _(d):
    from skein.operators.scans import with_ends

    return with_ends(d.edges.where("edge_type = 'HANDLED_BY'"), d.nodes, ("node_name",)).select("id", F.col("src_node_name").alias("src_name"), F.col("dst_node_name").alias("dst_name"))


@query(
    "J2_api_implementation",
    """with h as (select src api, dst mth from edges where edge_type = 'HANDLED_BY'), c as (select dst mth, src ctl from edges where edge_type = 'CONTAINS' and src like 'ctl:%'), m as (select dst mth, src map from edges where edge_type = 'CONTAINS' and src like 'map:%'),
    s as (select src mth, dst svc from edges where edge_type = 'CALLS' and src like 'mth:%' and dst like 'svc:%'), t as (select m.mth, x.dst tbl from m join edges q on q.src = m.map and q.edge_type = 'EXECUTES' join edges x on x.src = q.dst and x.edge_type in ('READS', 'WRITES', 'JOINS')),
    l as (select mth, array_to_string(list_sort(list(distinct ctl)), ',') ctl from c group by mth), n as (select mth, array_to_string(list_sort(list(distinct map)), ',') map from m group by mth), o as (select mth, array_to_string(list_sort(list(distinct svc)), ',') svc from s group by mth), p as (select mth, array_to_string(list_sort(list(distinct tbl)), ',') tbl from t group by mth)
    select api, h.mth, coalesce(ctl, '') ctl, coalesce(map, '') as "map", coalesce(svc, '') svc, coalesce(tbl, '') tbl from h left join l on l.mth = h.mth left join n on n.mth = h.mth left join o on o.mth = h.mth left join p on p.mth = h.mth where coalesce(ctl, map, svc, tbl) is not null""",
    "edges",
)
def _(d):
    return J.api_implementation(d.nodes, d.edges)


@query("J3_table_access", "select q.src as \"map\", q.dst as \"sql\", x.edge_type as \"access\", x.dst tbl from edges q join edges x on x.src = q.dst where q.edge_type = 'EXECUTES' and x.edge_type in ('READS', 'WRITES', 'JOINS')", "edges")
def _(d):
    return J.table_access(d.edges)


@query("J4_domain_containment", "select e.src domain, array_to_string(list_sort(list(distinct coalesce(nullif(n.node_name, ''), n.node_key))), ',') members from edges e left join nodes n on n.id = e.dst and n.node_type = 'Controller' where e.edge_type = 'CONTAINS' and e.src like 'dom:%' group by e.src", "nodes edges")
def _(d):
    n = _of(d, "Controller").select(F.col("id").alias("dst"), F.coalesce(F.nullif("node_name", F.lit("")), "node_key").alias("label"))
    e = d.edges.where("edge_type = 'CONTAINS' and src like 'dom:%'").join(n, "dst", "left")
    return e.groupBy(F.col("src").alias("domain")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("members"))


_CO = "t as (select distinct src as \"sql\", dst a from edges where edge_type in ('READS', 'WRITES', 'JOINS')), co as (select x.a, y.a b, count(distinct x.\"sql\") statements from t x join t y on x.\"sql\" = y.\"sql\" and x.a < y.a group by 1, 2)"


@query(
    "J5_table_stats",
    f"""with {_CO}, c as (select src id, count(*) n from edges where edge_type = 'HAS_COLUMN' group by src), r as (select id, count(distinct o) n from (select src id, dst o from edges where edge_type = 'REFERENCES' union all select dst, src from edges where edge_type = 'REFERENCES') x group by id),
    k as (select id, count(*) n from (select a id from co union all select b from co) y group by id) select nodes.id, coalesce(c.n, 0) columns_n, coalesce(r.n, 0) references_n, coalesce(k.n, 0) co_accessed_n from nodes left join c on c.id = nodes.id left join r on r.id = nodes.id left join k on k.id = nodes.id where node_type = 'Table'""",
    "nodes edges",
)
def _(d):
    return J.table_stats(d.nodes, d.edges)


@query("J6_tables_enriched", "select n.id, n.node_name, count(e.id) columns_n from nodes n left join edges e on e.src = n.id and e.edge_type = 'HAS_COLUMN' where n.node_type = 'Table' group by n.id, n.node_name", "nodes edges")
def _(d):
    return _of(d, "Table").select("id", "node_name").join(J.table_stats(d.nodes, d.edges).select("id", "columns_n"), "id")


@query("J7_tables_without_columns", "select id from nodes n where node_type = 'Table' and not exists (select 1 from edges e where e.edge_type = 'HAS_COLUMN' and e.src = n.id)", "nodes edges")
def _(d):
    return J.without_edge(d.nodes, d.edges, "Table", "HAS_COLUMN")


@query("J9_layer_skips", "select src, dst from edges where edge_type = 'CALLS' and src like 'ctl:%' and dst like 'map:%'", "edges")
def _(d):
    return J.layer_skips(d.nodes, d.edges)


_CALLS = "select distinct concat('c', cast(l_orderkey as string)) caller, concat('I', cast(l_partkey + l_linenumber % 2 as string), '#m', cast(l_linenumber as string)) callee from {lineitem}"


@query(
    "J10_interface_call_expansion",
    f"""with c as ({_CALLS.replace('{lineitem}', 'lineitem')}), i as (select concat('Impl', cast(p_partkey as string)) impl, concat('I', cast(p_partkey - p_partkey % (1 + p_size % 2) as string)) iface from part), n as (select *, count(*) over (partition by iface) n from i)
    select distinct caller, concat(impl, '#', split_part(callee, '#', 2)) callee, case when n = 1 then 1.0 else 0.6 end confidence, case when n = 1 then 'CONFIRMED' else 'PENDING' end status from c join n on iface = split_part(callee, '#', 1)""".replace("case when n = 1 then 1.0 else 0.6 end", "cast(case when n = 1 then 1.0 else 0.6 end as double)"),
)
def _(d):
    calls = d.spark.sql(_CALLS, lineitem=d.lineitem)
    impl = d.part.select(F.concat(F.lit("Impl"), F.col("p_partkey").cast("string")).alias("impl"), F.concat(F.lit("I"), (F.col("p_partkey") - F.col("p_partkey") % (1 + F.col("p_size") % 2)).cast("string")).alias("iface"))
    return J.expand_interface_calls(calls, impl)


@query("J11_statement_links", "with m as (select c_custkey, concat('ns.', cast(c_custkey % 40 as string)) k from customer), s as (select concat('ns.', cast(o_custkey % 60 as string)) k, min(concat('sql:', cast(o_orderkey as string))) \"sql\" from orders group by 1) select concat('mth:', cast(c_custkey as string)) \"method\", \"sql\" from m join s using (k) where c_custkey % 7 <> 0")
def _(d):
    m = d.customer.select(F.concat(F.lit("mth:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("ns."), (F.col("c_custkey") % 40).cast("string"), F.lit("(int)")).alias("key"), "c_custkey")
    s = d.orders.select(F.concat(F.lit("sql:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("ns."), (F.col("o_custkey") % 60).cast("string")).alias("key"))
    first = d.orders.groupBy((F.col("o_custkey") % 60).alias("g")).agg(F.min(F.concat(F.lit("sql:"), F.col("o_orderkey").cast("string"))).alias("sql"))
    done = d.customer.where("c_custkey % 7 = 0").withColumn("g", F.col("c_custkey") % 40).join(first, "g").select(F.concat(F.lit("mth:"), F.col("c_custkey").cast("string")).alias("method"), "sql")
    return J.statement_links(m, s, done)


@query("J12_cross_validation", "select coalesce(a.k, b.k) k, case when a.k is null then 'b_only' when b.k is null then 'a_only' else 'matched' end side from (select distinct l_partkey k from lineitem where l_quantity > 45) a full join (select p_partkey k from part where p_size > 10) b on a.k = b.k")
def _(d):
    return J.cross_validate(d.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), d.part.where("p_size > 10").select(F.col("p_partkey").alias("k")), "k")


@query("J13_reference_inference", "select t table_name, c column_name, case when c = 'parent_id' then t else regexp_replace(c, '_id$', '') end target from (select concat('t', cast(p_partkey % 30 as string)) t, case p_size % 3 when 0 then 'parent_id' when 1 then concat('t', cast(p_size as string), '_id') else 'name' end c from part) x where c <> 'name' and (c = 'parent_id' or regexp_replace(c, '_id$', '') in (select concat('t', cast(p_partkey % 30 as string)) from part))")
def _(d):
    c = d.part.select(F.concat(F.lit("t"), (F.col("p_partkey") % 30).cast("string")).alias("table_name"), F.when(F.col("p_size") % 3 == 0, "parent_id").when(F.col("p_size") % 3 == 1, F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit("_id"))).otherwise("name").alias("column_name"))
    return J.infer_references(c, c.select("table_name"))


@query("J16_package_graph", "select distinct a.p_brand package, b.p_brand imported from part a join part b on b.p_partkey = a.p_partkey + 1 where a.p_brand <> b.p_brand and not b.p_brand like 'Brand#1%'")
def _(d):
    b = d.part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_brand").alias("imported"))
    return J.package_graph(d.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("package")).join(b, "k"), ["Brand#1"])


@query(
    "J17_token_similarity_top3",
    """with t as (select p_partkey id, unnest(list_distinct(string_split(lower(p_name), ' '))) token from part), a as (select t.* from t join part on p_partkey = id where p_size <= 5), b as (select t.* from t join part on p_partkey = id where p_size > 5), na as (select id, count(*) n from a group by id), nb as (select id, count(*) n from b group by id),
    s as (select a.id a, b.id b, cast(count(*) as double) / least(min(na.n), min(nb.n)) score from a join b on a.token = b.token join na on na.id = a.id join nb on nb.id = b.id group by a.id, b.id), r as (select *, row_number() over (partition by a order by score desc, b) r from s where score >= 0.5) select a, b, round(score, 6) score from r where r <= 3""",
)
def _(d):
    t = d.part.select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("tokens"), "p_size")
    s = first_similar(t.where("p_size <= 5"), t.where("p_size > 5"), 0.5, 3)
    return s.select("a", "b", F.round("score", 6).alias("score"))


_ACC = "select concat('p', cast(o_custkey % 3 as string)) project, concat('tbl:', cast(l_partkey as string)) tbl, case when l_returnflag = 'R' then 'WRITE' else 'READ' end as \"access\", concat('map:', cast(o_custkey as string)) node from orders join lineitem on o_orderkey = l_orderkey where l_linenumber = 1"


def _access(d):
    j = d.orders.join(d.lineitem.where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("project"), F.concat(F.lit("tbl:"), F.col("l_partkey").cast("string")).alias("tbl"), F.when(F.col("l_returnflag") == "R", "WRITE").otherwise("READ").alias("access"), F.concat(F.lit("map:"), F.col("o_custkey").cast("string")).alias("node"))


_X = f"""with a as ({_ACC}), w as (select distinct project, node, tbl from a where "access" = 'WRITE'), r as (select distinct project, node, tbl from a where "access" = 'READ'), l as (select w.project from_project, w.node from_node, r.project to_project, r.node to_node, w.tbl from w join r on w.tbl = r.tbl and w.project <> r.project)"""


@query("J22_cross_repo_tables", _X + " select from_project, from_node, to_project, to_node, tbl, cast(0.95 as double) confidence from l")
def _(d):
    a = _access(d)
    return J.cross_links(a.where("access = 'WRITE'"), a.where("access = 'READ'"), "tbl", 0.95)


_APIS = "select distinct concat('p', cast(a.c_custkey % 3 as string)) from_project, a.c_custkey from_node, concat('p', cast(b.c_custkey % 3 as string)) to_project, b.c_custkey to_node from customer a join customer b on a.c_nationkey = b.c_nationkey where a.c_acctbal > 9000 and b.c_acctbal < 0 and a.c_custkey % 3 <> b.c_custkey % 3"


def _apis(d):
    side = lambda w: d.customer.where(w).select(F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string")).alias("project"), F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("k"))
    return side("c_acctbal > 9000"), side("c_acctbal < 0"), "k"


_TOPICS = "select distinct concat('p', cast(a.user_id % 3 as string)) from_project, a.user_id from_node, concat('p', cast(b.user_id % 3 as string)) to_project, b.user_id to_node from (select user_id, event_type t from events where value > 90) a join (select user_id, event_type t from events where value < 5) b on a.t = b.t where a.user_id % 3 <> b.user_id % 3"


def _topics(d):
    side = lambda w: d.events.where(w).select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"), F.col("user_id").alias("node"), F.col("event_type").alias("topic")).distinct()
    return side("value > 90"), side("value < 5"), "topic"


@query("J23_cross_repo_apis", _APIS)
def _(d):
    return J.node_links(*_apis(d))


@query("J24_cross_repo_topics", _TOPICS.replace("select distinct", "select distinct a.t topic,"))
def _(d):
    return J.crowded_links(*_topics(d), 0.75).select("topic", "from_project", "from_node", "to_project", "to_node")


@query(
    "J25_cross_repo_impact",
    _X + f""", g as (select from_project, to_project, 0.95 c from l union all select from_project, to_project, 0.9 from ({_APIS}) y union all select from_project, to_project, 0.75 from ({_TOPICS}) z) select from_project, to_project, case when c >= 0.9 then 'HIGH' when c >= 0.7 then 'MEDIUM' else 'LOW' end as "level", count(*) n from g where from_project = 'p1' or to_project = 'p1' group by 1, 2, 3""",
)
def _(d):
    a = _access(d)
    counts = [(J.counted_links(a.where("access = 'WRITE'"), a.where("access = 'READ'"), "tbl", True), 0.95), (J.counted_links(*_apis(d), False), 0.9), (J.counted_links(*_topics(d), False), 0.75)]
    n = [c.where("from_project = 'p1' or to_project = 'p1'").withColumn("level", J.impact_level(F.lit(confidence))) for c, confidence in counts]
    return n[0].union(n[1]).union(n[2]).groupBy("from_project", "to_project", "level").agg(F.sum("n").alias("n"))


@query("J26_evidence_join_coverage", "select node_type, count(distinct id) n from (select node_type, id, unnest(string_split(evidence_ids, ',')) e from nodes where evidence_ids <> '') x where e in (select concat('e', cast(n_nationkey as string)) from nation) group by node_type", "nodes")
def _(d):
    x = d.nodes.where("evidence_ids <> ''").select("node_type", "id", F.explode(F.split("evidence_ids", ",")).alias("e"))
    known = d.nation.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("e"))
    return x.join(known, "e", "left_semi").groupBy("node_type").agg(F.count_distinct("id").alias("n"))


@query("J27_covered_nodes", "select distinct o_custkey id from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'N')")
def _(d):
    return d.orders.join(d.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("id")).distinct()


@query("J28_first_matcher", "select k, priority, node from (select *, row_number() over (partition by k order by priority, score desc, node) r from (select l_orderkey k, l_linenumber % 3 priority, l_quantity score, l_partkey node from lineitem) x) y where r = 1")
def _(d):
    c = d.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("priority"), F.col("l_quantity").alias("score"), F.col("l_partkey").alias("node"))
    return J.first_matcher(c, "k").select("k", "priority", "node")


# traversal


_REACH = """with recursive w as (select id, 0 as lvl from nodes where id = '{seed}' union select {to}, lvl + 1 from w join edges on {on} = w.id where lvl < {depth}{types}) select id, cast(min(lvl) as integer) as "level" from w group by id"""


@query("P7_impact_levels", _REACH.format(seed="svc:1", to="dst", on="src", depth=3, types=""), "nodes edges")
def _(d):
    return P.reach(d.nodes.where("id = 'svc:1'"), d.edges, 3).select("id", "level")


@query("P4_api_call_chain", _REACH.format(seed="api:1", to="dst", on="src", depth=12, types=" and edge_type in ('HANDLED_BY', 'CALLS', 'EXECUTES', 'READS', 'WRITES', 'JOINS')"), "nodes edges")
def _(d):
    return P.reach(d.nodes.where("id = 'api:1'"), d.edges, 12, "out", ["HANDLED_BY", "CALLS", "EXECUTES", "READS", "WRITES", "JOINS"]).select("id", "level")


@query("P5_table_impact", _REACH.format(seed="tbl:5", to="src", on="dst", depth=8, types=""), "nodes edges")
def _(d):
    return P.reach(d.nodes.where("id = 'tbl:5'"), d.edges, 8, "in").select("id", "level")


@query("P6_implicit_associations", f"with {_CO} select a, b, statements from co", "edges")
def _(d):
    return J.co_accessed(d.edges)


@query(
    "P1_undirected_paths",
    """with recursive b as (select src, dst, id from edges where edge_type in ('DEPENDS_ON', 'REFERENCES') union all select dst, src, id from edges where edge_type in ('DEPENDS_ON', 'REFERENCES')),
    p as (select 'tbl:20' start, 'tbl:20' "end", 0 depth, [''] path_edges union all select start, dst, depth + 1, list_append(path_edges, id) from p join b on b.src = p."end" where depth < 4 and not list_contains(path_edges, id)) select "end", depth, count(*) n from p where depth > 0 group by 1, 2""",
    "edges",
)
def _(d):
    out = P.paths(d.nodes.where("id = 'tbl:20'"), d.edges, 4, "both", ["DEPENDS_ON", "REFERENCES"])
    return out.groupBy("end", "depth").agg(F.count("*").alias("n"))


@query(
    "P2_directed_paths",
    """with recursive p as (select id start, id "end", 0 depth, [id] ns from nodes where id in ('api:1', 'api:2') union all select start, dst, depth + 1, list_append(ns, dst) from p join edges on src = p."end" where depth < 3),
    c as (select row_number() over () i, * from p where depth > 0), x as (select i, unnest(ns) id from c), m as (select i, min(confidence) confidence from x join nodes using (id) group by i) select start, "end", depth, round(confidence, 6) confidence, array_to_string(ns, '>') trail from c join m using (i)""",
    "nodes edges",
)
def _(d):
    out = P.with_confidence(P.paths(d.nodes.where("id in ('api:1', 'api:2')"), d.edges, 3), d.nodes)
    return out.select("start", "end", "depth", F.round("confidence", 6).alias("confidence"), F.array_join("nodes", ">").alias("trail"))


@query("P9_neighbours_capped", "select id, neighbour from (select distinct id, neighbour, row_number() over (partition by id order by neighbour) r from (select distinct n.id, o neighbour from nodes n join (select src s, dst o from edges union all select dst, src from edges) b on b.s = n.id where node_type = 'Controller') x) y where r <= 20", "nodes edges")
def _(d):
    return P.neighbours(d.edges, _of(d, "Controller"))


_NEAR = "select distinct o id from (select b.s, b.o, row_number() over (partition by b.s order by b.o) r from b where b.s in (select id from {f})) x where r <= 20"


@query(
    "P8_neighbourhood",
    f"""with b as materialized (select src s, dst o from edges union select dst, src from edges), l0 as (select id from nodes where node_type = 'BusinessDomain' or id = 'svc:3'), l1 as materialized (select id from ({_NEAR.format(f='l0')}) y where id not in (select id from l0)), l2 as (select id from ({_NEAR.format(f='l1')}) y where id not in (select id from l0 union all select id from l1))
    select id, 0 "level" from l0 union all select id, 1 from l1 union all select id, 2 from l2""",
    "nodes edges",
)
def _(d):
    return P.neighbourhood(d.edges, d.nodes.where("node_type = 'BusinessDomain' or id = 'svc:3'"), 2)


_RAD = "r as (select distinct src source, dst target, edge_type from edges where edge_type in ('CALLS', 'READS', 'WRITES', 'BELONGS_TO', 'DEPENDS_ON', 'IMPLEMENTS', 'EXTENDS', 'IMPLEMENTED_BY', 'EXPOSED_BY') and dst in (select id from nodes where source_path in ('src/m2/Table.java', 'src/m3/Service.java')))"


def _radius(d):
    changed = d.spark.createDataFrame([("src/m2/Table.java",), ("src/m3/Service.java",)], "source_path string")
    return P.blast_radius(d.nodes, d.edges, changed)


@query("P10_blast_radius", f"with {_RAD} select source, target, edge_type from r", "nodes edges")
def _(d):
    return _radius(d)


@query("P11_affected_reasons", f"with {_RAD} select source id, array_to_string(list_sort(list(distinct concat(edge_type, ' <- ', node_key, ' (', source_path, ')'))), '; ') reason from r join nodes on nodes.id = target group by source", "nodes edges")
def _(d):
    return P.affected_reasons(_radius(d), d.nodes)


@query("P12_affected_subgraph", f"""with e as materialized (select id, src, dst, edge_type from edges), {_RAD.replace("from edges", "from e")}, a as (select source id from r union select target from r), b as (select src s, dst o from e union select dst, src from e),
    n as (select distinct o id from a join b on b.s = a.id order by o limit 100), i as materialized (select id from a union select id from n) select e.id from e semi join i x on x.id = e.src semi join i y on y.id = e.dst""", "nodes edges")
def _(d):
    from skein.operators.scans import induced_edges

    r = _radius(d)
    hit = r.select(F.col("source").alias("id")).union(r.select("target")).distinct()
    near = P.oriented(d.edges, "both").join(hit.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return induced_edges(d.edges, hit.union(near.orderBy("id").limit(100)).distinct()).select("id")


@query(
    "P5_forward_impact",
    _REACH.format(seed="tbl:10", to="dst", on="src", depth=3, types=" and edge_type in ('REFERENCES', 'JOINS', 'READS', 'WRITES')"),
    "nodes edges",
)
def _(d):
    return P.reach(d.nodes.where("id = 'tbl:10'"), d.edges, 3, "out", ["REFERENCES", "JOINS", "READS", "WRITES"]).select("id", "level")


@query("P3_preset_reach", _REACH.format(seed="tbl:5", to="src", on="dst", depth=3, types=" and edge_type in ('READS', 'WRITES', 'JOINS', 'EXECUTES', 'CONTAINS', 'CALLS', 'HANDLED_BY')"), "nodes edges")
def _(d):
    return P.reach(d.nodes.where("id = 'tbl:5'"), d.edges, 3, "in", P.PRESETS["TABLE_REVERSE"]).select("id", "level")


@query("P13_transitive_closure", "with o as (select distinct src, dst from edges where edge_type = 'DEPENDS_ON'), t as (select a.src, b.dst from o a join o b on a.dst = b.src union select a.src, c.dst from o a join o b on a.dst = b.src join o c on b.dst = c.src) select src, dst from t where src <> dst and not exists (select 1 from o where o.src = t.src and o.dst = t.dst)", "edges")
def _(d):
    return P.transitive_closure(d.edges, "DEPENDS_ON")


@query(
    "P21_feature_slices",
    """with a as (select id from nodes where node_type = 'ApiEndpoint'), h as (select src api, dst mth from edges where edge_type = 'HANDLED_BY'), c as (select distinct api, dst svc from h join edges on src = mth and edge_type = 'CALLS'), m as (select distinct api, dst map from c join edges on src = svc and edge_type = 'CALLS'), q as (select distinct api from m join edges on src = map and edge_type = 'EXECUTES')
    select id, cast(case when q.api is not null then 4 when mm.api is not null then 3 when cc.api is not null then 2 when hh.api is not null then 1 else 0 end as integer) layers from a left join (select distinct api from h) hh on hh.api = id left join (select distinct api from c) cc on cc.api = id left join (select distinct api from m) mm on mm.api = id left join q on q.api = id""",
    "nodes edges",
)
def _(d):
    return P.chain_coverage(_of(d, "ApiEndpoint"), d.edges, [["HANDLED_BY"], ["CALLS"], ["CALLS"], ["EXECUTES"]])


@query("P19_reached_tables", "with recursive e as materialized (select src, dst from edges), w as (select id, 0 as lvl from nodes where node_type = 'Controller' union select dst, lvl + 1 from w join e on src = w.id where lvl < 6) select distinct w.id from w where w.id like 'tbl:%'", "nodes edges")
def _(d):
    return P.reach(_of(d, "Controller"), d.edges, 6).join(_of(d, "Table").select("id"), "id", "left_semi").select("id")
