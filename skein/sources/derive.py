"""Property-graph, trace, claim and retrieval tables derived from the supplied star schema.

Each table is one SQL text that Spark and other ANSI engines read alike; {name} stands for a base
table. `Derived` gives them as DataFrames, `sql` as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skein.storage import materialize

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_NODES = """
select concat('dom:', cast(r_regionkey as string)) id, 'BusinessDomain' node_type, r_name node_name, cast(r_regionkey as bigint) k from {region}
union all select concat('ctl:', cast(n_nationkey as string)), 'Controller', n_name, cast(n_nationkey as bigint) from {nation}
union all select concat('svc:', cast(s_suppkey as string)), 'Service', s_name, cast(s_suppkey as bigint) from {supplier}
union all select concat('map:', cast(c_custkey as string)), 'Mapper', c_name, cast(c_custkey as bigint) from {customer}
union all select concat('mth:', cast(c_custkey as string)), 'Method', c_name, cast(c_custkey as bigint) from {customer}
union all select concat('api:', cast(c_custkey as string)), 'ApiEndpoint', concat('GET /c/', cast(c_custkey as string)), cast(c_custkey as bigint) from {customer} where c_custkey % 3 <> 0
union all select concat('sql:', cast(o_orderkey as string)), 'SqlStatement', o_orderpriority, cast(o_orderkey as bigint) from {orders}
union all select concat('tbl:', cast(p_partkey as string)), 'Table', p_name, cast(p_partkey as bigint) from {part}
union all select concat('col:', cast(p_partkey as string), '.', cast(i as string)), 'Column', concat(p_name, ' ', cast(i as string)), cast(p_partkey * 3 + i as bigint) from {part} cross join (values (1), (2), (3)) v(i) where p_partkey % 7 <> 0 and i <= 1 + p_size % 3
union all select concat('pkg:', p_brand), 'Package', p_brand, min(cast(p_partkey as bigint)) from {part} group by p_brand
"""

_ATTRIBUTES = """
'p1' project_id, k % 17 <> 0 in_v1, k % 19 <> 0 in_v2,
case when k % 23 = 0 then null else cast((k * 37) % 101 as double) / 100 end confidence,
case k % 5 when 0 then 'CONFIRMED' when 1 then 'PENDING_CONFIRM' when 2 then 'APPROVED' when 3 then 'REJECTED' else 'PENDING' end status,
case k % 6 when 0 then 'CODE_AST' when 1 then 'DB_METADATA' when 2 then 'DOC_AI' when 3 then 'AI_INFERENCE' when 4 then 'RUNTIME_TRACE' else 'SQL_PARSE' end source_type,
case when k % 4 = 0 then '' else concat('e', cast(k % 50 as string), ',e', cast(k % 13 as string)) end evidence_ids,
cast(concat('2024-01-', lpad(cast(k % 30 + 1 as string), 2, '0')) as date) created_at,
case when k % 9 = 0 then 1.0e0 else 0.0e0 end verified_score
"""

_EDGES = """
select concat('dom:', cast(n_regionkey as string)) src, concat('ctl:', cast(n_nationkey as string)) dst, 'CONTAINS' edge_type, cast(n_regionkey * 31 + n_nationkey as bigint) k from {nation}
union all select concat('ctl:', cast(c_nationkey as string)), concat('mth:', cast(c_custkey as string)), 'CONTAINS', cast(c_nationkey * 31 + c_custkey as bigint) from {customer} where c_custkey % 5 <> 0
union all select concat('map:', cast(c_custkey as string)), concat('mth:', cast(c_custkey as string)), 'CONTAINS', cast(c_custkey * 32 as bigint) from {customer} where c_custkey % 5 = 0
union all select concat('api:', cast(c_custkey as string)), concat('mth:', cast(c_custkey as string)), 'HANDLED_BY', cast(c_custkey * 33 as bigint) from {customer} where c_custkey % 3 <> 0 and c_custkey % 11 <> 0
union all select concat('ctl:', cast(s_nationkey as string)), concat('svc:', cast(s_suppkey as string)), 'CALLS', cast(s_nationkey * 31 + s_suppkey as bigint) from {supplier}
union all select concat('ctl:', cast(c_nationkey as string)), concat('map:', cast(c_custkey as string)), 'CALLS', cast(c_nationkey * 37 + c_custkey as bigint) from {customer} where c_acctbal < 0 and c_custkey % 4 = 0
union all select distinct concat('mth:', cast(o_custkey as string)), concat('svc:', cast(l_suppkey as string)), 'CALLS', cast(o_custkey * 31 + l_suppkey as bigint) from {orders} join {lineitem} on o_orderkey = l_orderkey where l_linenumber = 1 and l_orderkey % 5 = 1
union all select distinct concat('svc:', cast(l_suppkey as string)), concat('map:', cast(o_custkey as string)), 'CALLS', cast(l_suppkey * 31 + o_custkey as bigint) from {orders} join {lineitem} on o_orderkey = l_orderkey where l_linenumber = 1 and l_orderkey % 5 = 0
union all select concat('map:', cast(o_custkey as string)), concat('sql:', cast(o_orderkey as string)), 'EXECUTES', cast(o_custkey * 31 + o_orderkey as bigint) from {orders}
union all select distinct concat('sql:', cast(l_orderkey as string)), concat('tbl:', cast(l_partkey as string)), case l_returnflag when 'N' then 'READS' when 'R' then 'WRITES' else 'JOINS' end, cast(l_orderkey * 31 + l_partkey as bigint) from {lineitem} where l_linenumber <= 2 and l_orderkey % 10 <> 9
union all select concat('tbl:', cast(p_partkey as string)), concat('col:', cast(p_partkey as string), '.', cast(i as string)), 'HAS_COLUMN', cast(p_partkey * 31 + i as bigint) from {part} cross join (values (1), (2), (3)) v(i) where p_partkey % 7 <> 0 and i <= 1 + p_size % 3
union all select concat('tbl:', cast(a.p_partkey as string)), concat('tbl:', cast(b.p_partkey as string)), 'REFERENCES', cast(a.p_partkey * 33 as bigint) from {part} a join {part} b on b.p_partkey = 2 * a.p_partkey where a.p_partkey % 5 = 0
union all select concat('pkg:', a) src, concat('pkg:', b), 'DEPENDS_ON', k from (select a.p_brand a, b.p_brand b, min(cast(a.p_partkey * 31 + b.p_partkey as bigint)) k from {part} a join {part} b on b.p_partkey = a.p_partkey + 1 where a.p_partkey % 13 = 0 and a.p_brand <> b.p_brand group by a.p_brand, b.p_brand) x
"""

SQL = {
    "nodes": f"select *, concat(node_type, '#', id) node_key, concat('src/m', cast(k % 40 as string), '/', node_type, '.java') source_path, {_ATTRIBUTES} from ({_NODES}) n",
    "edges": f"select *, concat(src, '->', lower(edge_type), '->', dst) id, {_ATTRIBUTES} from ({_EDGES}) e",
    "spans": """select trace_id, span_id, lag(span_id) over (partition by trace_id order by ts, span_id) parent_span_id, service_name, duration_ms, status, ts from (
        select concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) trace_id, event_id span_id, event_type service_name, cast(floor(value * 10) as bigint) duration_ms, case event_type when 'error' then 'ERROR' else 'OK' end status, ts from {events}) e""",
    "process_log": "select user_id case_id, event_type activity, ts started_at, event_id from {events}",
    "flows": """select 'chain' process_key, concat('act:', b) src, concat('act:', activity) dst, 'FLOW_TO' edge_type from (select activity, lag(activity) over (order by n desc, activity) b from (
        select activity, n, row_number() over (order by n desc, activity) r from (select activity, count(*) n from {process_log} group by activity) c) x where r <= 4) y where b is not null
        union all select 'pairs', concat('act:', b), concat('act:', a), 'FLOW_TO' from (select b, a, row_number() over (partition by b order by n desc, a) r from (
        select b, a, count(*) n from (select lag(activity) over (partition by case_id order by started_at, event_id) b, activity a from {process_log}) f where b is not null group by b, a) c) x where r <= 2""",
    "claims": """select 'Feature' subject_type, concat('f:', cast(o_custkey % 200 as string)) subject_key,
        case l_linenumber when 1 then 'EXPOSED_BY' when 2 then 'IMPLEMENTED_BY' when 3 then 'HANDLED_BY' when 4 then 'READS' when 5 then 'WRITES' when 6 then 'VERIFIED_BY' else 'CALLS' end predicate,
        case when l_linenumber in (4, 5) then 'Table' else 'ApiEndpoint' end object_type,
        concat(case when l_linenumber in (4, 5) then 'tbl:' else 'api:' end, cast(l_partkey % 50 as string)) object_key,
        case l_returnflag when 'N' then 'CODE' when 'A' then 'DOC_AI' else 'DB' end source_type,
        cast((l_orderkey * 37 + l_linenumber) % 101 as double) / 100 confidence, concat('e', cast(l_orderkey % 50 as string)) evidence_id,
        cast(l_orderkey * 8 + l_linenumber as bigint) seq
        from {orders} join {lineitem} on o_orderkey = l_orderkey where l_linenumber <= 7""",
    "classes": """select concat('cls:', cast(p_partkey as string)) id, cast(p_partkey as bigint) k, concat(upper(substring(split_part(p_name, ' ', 1), 1, 1)), substring(split_part(p_name, ' ', 1), 2), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2),
        case p_size % 5 when 0 then 'Service' when 1 then 'ServiceImpl' when 2 then 'Controller' when 3 then 'Mapper' else 'Entity' end) class_name, concat('com.', lower(replace(p_brand, '#', ''))) package,
        case p_size % 5 when 2 then 'Controller' when 3 then 'Mapper' when 4 then 'Entity' else 'Service' end node_type, cast(p_size as bigint) params from {part}""",
    "entities": """select concat('ent:', class_name) id, class_name node_name, node_type, min(k) k, case min(k) % 4 when 0 then 'AI_INFERENCE' when 1 then 'DOC_AI' else 'CODE_AST' end source_type, min(k) % 3 = 0 runtime_verified from {classes} group by class_name, node_type""",
    "entity_evidence": "select distinct concat('ent:', class_name) id, concat('e', cast(k % 7 as string)) evidence from {classes}",
    "files_old": "select 'p1' project_id, concat(source, '/', cast(doc_id as string), '.txt') file_path, {digest} file_hash, cast(n_chars as bigint) file_size, cast(doc_id % 2 as bigint) extractor_version from {documents} where doc_id % 10 <> 0",
    "files_new": "select 'p1' project_id, concat(source, '/', cast(doc_id as string), case when doc_id % 7 = 0 then '_moved.txt' else '.txt' end) file_path, {new_digest} file_hash, cast(n_chars + case when doc_id % 5 = 0 then 1 else 0 end as bigint) file_size, cast(1 as bigint) extractor_version from {documents} where doc_id % 11 <> 0",
    "vectors": "select vec_id, embedding, case label % 4 when 0 then 'DOC' when 1 then 'CODE' when 2 then 'DB' else 'UI' end chunk_type, case vec_id % 3 when 0 then null when 1 then 'alice' else 'bob,carol' end acl, concat('uri', cast(vec_id % 40 as string)) source_uri from {embeddings}",
    "qa": """select q.conv_id, q.turn, q.text question, a.text answer from {conversations} q join {conversations} a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'""",
}

_NEW_TEXT = "case when doc_id % 5 = 0 then concat('x', text) else text end"
_SPARK = {"digest": "sha2(cast(text as binary), 256)", "new_digest": f"sha2(cast({_NEW_TEXT} as binary), 256)"}
_ANSI = {"digest": "sha256(text)", "new_digest": f"sha256({_NEW_TEXT})"}


def sql(*names: str) -> str:
    """`with` clause of the named tables for an engine that has the base tables by name."""
    words = {b: b for b in [*BASE, *SQL]} | _ANSI
    parts = [f"{n} as ({_filled(SQL[n], words)})" for n in dict.fromkeys(names)]
    return "with " + ",\n".join(parts) + "\n" if parts else ""


def _filled(text: str, words: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: words[m[1]], text)


#: Bytes in memory for each byte of a table's Parquet files: files hold repeated and rising values in a few bytes a row, a
#: broadcast id takes some 140, a node 4 in its file. Without it Spark broadcasts millions of ids, as the projected file is under its bound.
IN_MEMORY = "64.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"

#: Bytes of base tables for each shuffle partition that a stage starts with. A graph query shuffles up to some four times its tables, and
#: 1 MB of sorted ids takes some 12 MB in a task; Spark joins small partitions to its advisory size, but cuts none that are too large.
PARTITION = 4 << 20
_START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

#: Starting partitions that were set here, by application and folder of the base tables.
_started: dict[tuple[str, str], str] = {}


def start_partitions(spark: SparkSession, sf_dir: str) -> None:
    """Lets shuffles start with partitions in proportion to the base tables, so that a task's memory doesn't grow with them.

    Never fewer than the session's shuffle partitions; a session that sets a number of its own keeps it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    set_here = {v for (app, _), v in _started.items() if app == key[0]}
    if spark.conf.get(_START, None) not in {None, *set_here}:
        return
    if key not in _started:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
        size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        _started[key] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION)))
    spark.conf.set(_START, _started[key])

#: Graph tables that were written in this process: (application, folder of the base tables, name) -> path.
_written: dict[tuple[str, str, str], str] = {}


class Derived:
    """Base tables as attributes by their names, derived ones by the names in SQL; each is read when first asked for.

    The graph itself is loaded once: nodes and edges are written as Parquet to the shared folder
    when first asked for, so that queries which join them several times scan columns of a table.
    Spark's estimates of tables are raised to what they take in memory, and shuffles start with partitions in
    proportion to the tables, unless the session has a factor or a number of its own.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        if float(spark.conf.get(_FACTOR)) == 1:
            spark.conf.set(_FACTOR, IN_MEMORY)
        start_partitions(spark, sf_dir)
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SQL and name not in BASE:
            raise AttributeError(name)
        if name not in self._held:
            if name in BASE:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                used = {b for b in re.findall(r"\{(\w+)\}", SQL[name]) if b not in _SPARK}
                text = _filled(SQL[name], {b: "{" + b + "}" for b in used} | _SPARK)
                self._held[name] = self._loaded(name, self.spark.sql(text, **{b: getattr(self, b) for b in used}))
        return self._held[name]

    def _loaded(self, name: str, made: DataFrame) -> DataFrame:
        if name not in ("nodes", "edges"):
            return made
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            _, _written[key] = materialize(made, name)
        return self.spark.read.schema(made.schema).parquet(_written[key])

    @cached_property
    def v1_nodes(self) -> DataFrame:
        return self.nodes.where("in_v1")

    @cached_property
    def v1_edges(self) -> DataFrame:
        return self.edges.where("in_v1")
