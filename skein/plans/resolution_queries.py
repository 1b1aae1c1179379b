"""Queries of skein.operators.resolution and communities."""

from pyspark.sql import functions as F

from skein.functions.text import split_words
from skein.operators import blocking as B
from skein.operators import communities as C
from skein.operators import resolution as E
from skein.operators.similarity import similar_sets
from skein.plans.registry import query

_NORMAL = "regexp_replace(regexp_replace(lower(node_name), '[^a-z0-9]', '', 'g'), 'controller|service|mapper|dao|impl|entity|dto|vo', '', 'g')"
_CORE = "regexp_replace(node_name, '(ServiceImpl|Controller|Service|Mapper|Entity)$', '')"
_KEYS = f"""k as (select id, concat(node_type, ':A:', left({_NORMAL}, 3)) "key" from entities where {_NORMAL} <> '' union select id, concat(node_type, ':B:bi:', unnest(list_transform(range(1, length(node_name)), lambda i: substring(node_name, i, 2)))) from entities
    union select id, concat(node_type, ':B:core:', {_CORE}) from entities where {_CORE} <> node_name)"""


@query("E1_blocks", f"with {_KEYS} select \"key\", count(distinct id) members from k group by 1 having count(distinct id) > 1", "classes entities")
def _(d):
    return E.blocks(E.blocking_keys(d.entities))


_BASE = "list_transform(range(1, length(node_name)), lambda i: 31 * ascii(substring(node_name, i, 1)) + ascii(substring(node_name, i + 1, 1)))"


@query("E4_minhash", f"select id, array_to_string(list_transform(range(0, 16), lambda i: list_min(list_transform({_BASE}, lambda h: h * (i + 1) + i * 31))), ',') signature from entities", "classes entities")
def _(d):
    return d.entities.select("id", F.array_join(F.transform(E.minhash_signature(F.col("node_name"), 16), lambda x: x.cast("string")), ",").alias("signature"))


@query("E5_candidate_pairs", f"with {_KEYS} select distinct x.id a, y.id b from k x join k y on x.\"key\" = y.\"key\" and x.id < y.id", "classes entities")
def _(d):
    return E.candidate_pairs(E.blocking_keys(d.entities))


@query("E5_window_pairs", "with n as (select id, node_type, source_type, row_number() over (partition by node_type, source_type order by node_name, id) p from entities) select distinct least(x.id, y.id) a, greatest(x.id, y.id) b from n x join n y on x.node_type = y.node_type and x.source_type = y.source_type and y.p > x.p and y.p < x.p + 50", "classes entities")
def _(d):
    return E.window_pairs(d.entities)


def _entity_edges(d):
    """Entities linked to the packages their classes are in."""
    return d.classes.select(F.concat(F.lit("ent:"), "class_name").alias("src"), F.col("package").alias("dst")).distinct()


#: Few names a block, so that small tables split blocks too.
_BOUND = 8
_AB = [", ".join(str(x[i]) for x in B.family(40)) for i in (0, 1)]
_LSH = f"""r as (select min(id) id, node_type, lower(trim(node_name)) nm from entities where length(trim(node_name)) >= 2 group by 2, 3),
    h as (select id, node_type, list_transform(range(1, length(nm)), lambda j: 31 * ascii(substring(nm, j, 1)) + ascii(substring(nm, j + 1, 1)) + 1) base from r),
    sg as (select id, node_type, list_transform(range(1, 41), lambda i: list_min(list_transform(base, lambda x: (cast(x as bigint) * ([{_AB[0]}])[i] + ([{_AB[1]}])[i]) % {B.PRIME}))) s from h),
    bd as (select id, node_type, list_concat(s, s) s, unnest(range(0, 20)) b from sg),
    ks as (select id, concat(node_type, ':', b, ':', array_to_string(s[2 * b + 1 : 2 * b + 2], ',')) k0, concat(node_type, ':', b, ':', array_to_string(s[2 * b + 1 : 2 * b + 6], ',')) k1, concat(node_type, ':', b, ':', array_to_string(s[2 * b + 1 : 2 * b + 40], ',')) k2 from bd),
    kn as (select *, count(*) over (partition by k0) n0, count(*) over (partition by k1) n1, count(*) over (partition by k2) n2 from ks),
    bl as (select case when n0 <= {_BOUND} then k0 when n1 <= {_BOUND} then k1 else k2 end "key", id, n0 > {_BOUND} and n1 > {_BOUND} and n2 > {_BOUND} crowd from kn),
    pr as (select x.id a, y.id b from bl x join bl y on x."key" = y."key" and x.id < y.id and not x.crowd union all select m.a, x.id from bl x join (select "key", min(id) a from bl where crowd group by 1) m on m."key" = x."key" and m.a <> x.id where x.crowd),
    wp as (select a, b, count(*) weight from pr group by 1, 2), en as (select a id, weight from wp union all select b, weight from wp), av as (select id, sum(weight) t, count(*) n from en group by 1),
    kept as (select a, b, weight from wp join av x on x.id = a join av y on y.id = b where weight * x.n >= x.t or weight * y.n >= y.t)"""


@query("E4_lsh_blocks", f"with {_LSH} select \"key\", count(*) members from bl where not crowd group by 1 having count(*) > 1", "classes entities")
def _(d):
    return B.lsh_blocks(d.entities, bound=_BOUND)[0].groupBy("key").agg(F.count("*").alias("members"))


@query("E5_weighted_pairs", f"with {_LSH} select a, b, weight from wp", "classes entities")
def _(d):
    return B.weighted_pairs(*B.lsh_blocks(d.entities, bound=_BOUND))


@query("E5_pruned_pairs", f"with {_LSH} select a, b, weight from kept", "classes entities")
def _(d):
    return B.pruned_pairs(B.weighted_pairs(*B.lsh_blocks(d.entities, bound=_BOUND)))


def _scored(d):
    pairs = B.resolution_pairs(d.entities).union(E.window_pairs(d.entities)).distinct()
    return E.scored_pairs(pairs, d.entities, _entity_edges(d), d.entity_evidence)


@query("E6_composite_scores", None)
def _(d):
    return _scored(d).select("a", "b", F.round("score", 6).alias("score"))


@query("E7_name_scores", None)
def _(d):
    n = lambda end: d.entities.select(F.col("id").alias(end), F.col("node_name").alias(f"n{end}"))
    pairs = B.resolution_pairs(d.entities)
    return pairs.join(n("a"), "a").join(n("b"), "b").select("a", "b", F.round(E.name_score(F.col("na"), F.col("nb")), 6).alias("score"))


_NEXT = "p as (select x.id a, y.id b from nodes x join nodes y on y.node_type = 'Service' and y.k = x.k + 1 where x.node_type = 'Service')"


def _next(d, t="Service"):
    s = d.nodes.where(F.col("node_type") == t).select("id", "k")
    return s.select(F.col("id").alias("a"), (F.col("k") + 1).alias("k")).join(s.withColumnRenamed("id", "b"), "k").select("a", "b")


@query(
    "E8_structural_similarity",
    f"""with {_NEXT}, m as (select src id, dst member from edges union select dst, src from edges), c as (select id, count(*) n from m group by id), s as (select a, b, count(*) n from p join m x on x.id = a join m y on y.id = b and y.member = x.member group by 1, 2)
    select p.a, p.b, case when x.n is null and y.n is null then 1.0 when x.n is null or y.n is null then 0.0 else cast(coalesce(s.n, 0) as double) / (x.n + y.n - coalesce(s.n, 0)) end score from p left join s on s.a = p.a and s.b = p.b left join c x on x.id = p.a left join c y on y.id = p.b""",
    "nodes edges",
)
def _(d):
    return E.set_overlap(_next(d), E.neighbours_of(d.edges), 1.0, False)


@query(
    "E9_shared_evidence",
    """with m as (select id, list_distinct(string_split(evidence_ids, ',')) e, k from nodes where node_type = 'Table') select x.id a, y.id b, case when x.e = [''] or y.e = [''] then 0.0 else cast(len(list_intersect(x.e, y.e)) as double) / greatest(len(x.e), len(y.e)) end score from m x join m y on y.k = x.k + 1""",
    "nodes",
)
def _(d):
    members = d.nodes.where("node_type = 'Table' and evidence_ids <> ''").select("id", F.explode(F.split("evidence_ids", ",")).alias("member")).distinct()
    return E.set_overlap(_next(d, "Table"), members, 0.0, True)


@query("E10_runtime_scores", "select x.id a, y.id b, case when x.verified_score > 0 and y.verified_score > 0 then 0.5 when x.verified_score > 0 or y.verified_score > 0 then 0.2 else 0.0 end score from nodes x join nodes y on y.node_type = 'Table' and y.k = x.k + 1 where x.node_type = 'Table'", "nodes")
def _(d):
    v = lambda end: d.nodes.select(F.col("id").alias(end), (F.col("verified_score") > 0).alias(f"v{end}"))
    return _next(d, "Table").join(v("a"), "a").join(v("b"), "b").select("a", "b", E.runtime_score(F.col("va"), F.col("vb")).alias("score"))


@query("E11_merge_decisions", None)
def _(d):
    return _scored(d).select("a", "b", "decision")


_PAIRS = "select concat('svc:', cast(s_suppkey as string)) a, concat('svc:', cast(s_suppkey - s_suppkey % 4 as string)) b from {supplier} where s_suppkey % 4 in (1, 2)"
_TO = f"""x as ({_PAIRS.format(supplier='supplier')}), g as (select b, least(b, min(a)) "into" from x group by b), t as (select id, "into" from (select a id, b from x union select b, b from x) y join g using (b) where id <> "into")"""


@query("E12_merged_edges", f"with {_TO}, m as (select e.id, e.edge_type, e.src o, e.dst q, coalesce(x.\"into\", e.src) src, coalesce(y.\"into\", e.dst) dst from edges e left join t x on x.id = e.src left join t y on y.id = e.dst) select src, dst, edge_type, min(id) id from m where src <> dst or o = q group by 1, 2, 3", "edges")
def _(d):
    return E.merged_graph(d.nodes, d.edges, d.spark.sql(_PAIRS, supplier=d.supplier))[1]


@query("E12_merge_lineage", f"with {_TO} select id, \"into\" merged_into from t")
def _(d):
    return E.merged_graph(d.nodes, d.edges, d.spark.sql(_PAIRS, supplier=d.supplier))[2]


@query("E13_run_counters", None)
def _(d):
    n = lambda what: F.count_if(F.col("decision") == what)
    return _scored(d).agg(F.count("*").alias("candidates"), n("AUTO_MERGE").alias("auto"), n("REVIEW").alias("review"), n("REJECT").alias("rejected"))


_COS = "list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"


@query(
    "E14_cross_type_candidates",
    f"""with m as (select id, node_type, k, unnest(list_distinct(string_split(evidence_ids, ','))) e from nodes where evidence_ids <> '' and node_type in ('Table', 'Service', 'Mapper', 'Controller')), s as (select x.id a, y.id b, min(x.k) ka, min(y.k) kb, count(*) shared from m x join m y on x.e = y.e and (x.node_type, y.node_type) in (('Service', 'Table'), ('Service', 'Mapper'), ('Mapper', 'Table'), ('Controller', 'Service'), ('Controller', 'Mapper')) group by 1, 2 having count(*) >= 2)
    select a, b, shared, ({_COS.format(a='v.embedding', b='w.embedding')} + 1) / 2 similarity from s join embeddings v on v.vec_id = ka join embeddings w on w.vec_id = kb where ({_COS.format(a='v.embedding', b='w.embedding')} + 1) / 2 >= 0.7""",
    "nodes",
)
def _(d):
    nodes = d.nodes.where("node_type in ('Table', 'Service', 'Mapper', 'Controller')")
    evidence = nodes.where("evidence_ids <> ''").select("id", F.explode(F.split("evidence_ids", ",")).alias("evidence"))
    vectors = nodes.select("id", F.col("k").alias("vec_id")).join(d.embeddings.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    return E.cross_type_candidates(nodes, evidence, vectors, [("Service", "Table"), ("Service", "Mapper"), ("Mapper", "Table"), ("Controller", "Service"), ("Controller", "Mapper")])


@query("E15_semantic_similarity", f"select a.vec_id, ({_COS.format(a='a.embedding', b='b.embedding')} + 1) / 2 similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 7")
def _(d):
    b = d.embeddings.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("other"))
    return d.embeddings.join(b, "vec_id").select("vec_id", E.semantic_similarity(F.col("embedding"), F.col("other")).alias("similarity"))


def _propagation(types: str, edges: str, rounds: int) -> str:
    """Label propagation as `rounds` steps of SQL; ends with the labels as table l{rounds}."""
    parts = [f"v as materialized (select id from nodes where node_type in ({types}))", f"u as materialized (select src id, dst o from edges where edge_type in ({edges}) and src <> dst and src in (select id from v) and dst in (select id from v) union select dst, src from edges where edge_type in ({edges}) and src <> dst and src in (select id from v) and dst in (select id from v))", "l0 as materialized (select id, id label from v)"]
    for i in range(rounds):
        parts.append(
            f"l{i + 1} as materialized (select l{i}.id, coalesce(b.vote, label) label from l{i} left join (select id, vote from (select u.id, o.label vote, row_number() over (partition by u.id order by count(*) desc, max(case when o.label = m.label then 1 else 0 end) desc, o.label) r from u join l{i} o on o.id = u.o join l{i} m on m.id = u.id group by u.id, o.label) z where r = 1) b on b.id = l{i}.id)"
        )
    return ", ".join(parts)


_PKG, _CLS = _propagation("'Package'", "'DEPENDS_ON'", 10), _propagation("'Controller', 'Service', 'Mapper'", "'CALLS', 'EXTENDS', 'IMPLEMENTS'", 10)


@query("E16_package_communities", f"with {_PKG} select id, label from l10", "nodes edges")
def _(d):
    return C.label_propagation(d.nodes.where("node_type = 'Package'").select("id"), d.edges.where("edge_type = 'DEPENDS_ON'").select("src", "dst"))


def _classes(d):
    return C.label_propagation(d.nodes.where("node_type in ('Controller', 'Service', 'Mapper')").select("id"), d.edges.where("edge_type in ('CALLS', 'EXTENDS', 'IMPLEMENTS')").select("src", "dst"))


@query("E17_class_communities", f"with {_CLS} select id, label from l10", "nodes edges")
def _(d):
    return _classes(d)


@query("E18_community_summaries", f"with {_CLS}, p as (select label, node_type, count(*) n from l10 join nodes using (id) group by 1, 2) select label, cast(sum(n) as bigint) members, string_agg(concat(node_type, ': ', cast(n as varchar)), ', ' order by n desc, node_type) summary from p group by label", "nodes edges")
def _(d):
    return C.summaries(_classes(d), d.nodes)


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(node_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 2))"


@query(
    "E19_token_similarity",
    f"""with t as (select id, {_TOK} t from entities), p as (select distinct x.id a, y.id b from (select id, unnest(t) w from t) x join (select id, unnest(t) w from t) y on x.w = y.w and x.id < y.id), s as (select a, b, len(list_intersect(x.t, y.t)) i, least(len(x.t), len(y.t)) m from p join t x on x.id = a join t y on y.id = b),
    q as (select a, b, case when m < 2 then 1.0 when i <> m and m < 3 then 0.0 else cast(i as double) / m end score from s) select a, b, score from q where score >= 0.5""",
    "classes entities",
)
def _(d):
    return similar_sets(d.entities.select("id", split_words(F.col("node_name")).alias("tokens")), None, 0.5, small=3, least_length=4)


@query("E21_field_similarity", None)
def _(d):
    fields = d.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: (x["l_partkey"] % 5).cast("string")).alias("f"))
    nxt = fields.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("f").alias("g"))
    return fields.join(nxt, "l_orderkey").select("l_orderkey", F.round(E.list_similarity(F.col("f"), F.col("g")), 6).alias("score"))


@query("E22_aliases", f"select id, array_to_string(list_sort(list_distinct([node_name, {_CORE}, replace(replace({_CORE}, 'Red', 'Scarlet'), 'Ring', 'Loop')])), ',') aliases from entities", "classes entities")
def _(d):
    return d.entities.select("id", F.array_join(E.derived_aliases(F.col("node_name"), ["ServiceImpl", "Controller", "Service", "Mapper", "Entity"], {"Red": "Scarlet", "Ring": "Loop"}), ",").alias("aliases"))


_W = "string_split(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' ')"


@query("E25_name_scores", f"with n as (select class_name c, k from classes) select x.k, case when starts_with(lower(x.c), lower(y.c)) or starts_with(lower(y.c), lower(x.c)) then 2 else 0 end + case when contains(lower(x.c), lower(y.c)) or contains(lower(y.c), lower(x.c)) then 1 else 0 end + case when list_has_any({_W.format(c='x.c')}, {_W.format(c='y.c')}) then 1 else 0 end score from n x join n y on y.k = x.k + 1", "classes")
def _(d):
    b = d.classes.select((F.col("k") - 1).alias("k"), F.col("class_name").alias("other"))
    return d.classes.join(b, "k").select("k", E.camel_score(F.col("class_name"), F.col("other")).alias("score"))
