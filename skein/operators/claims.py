"""Knowledge claims: merging, compiling to a graph, gaps, review rules, feedback and verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.stats import violations

KEY = ("subject_type", "subject_key", "predicate", "object_type", "object_key")
#: Sources that are machine guesses, and those whose word counts.
AI = ("DOC_AI", "CODE_AI", "AI_INFERENCE", "AI")
TRUSTED = ("CODE", "DB", "RUNTIME", "TEST")
#: Predicates that become edges.
EDGES = ("EXPOSED_BY", "IMPLEMENTED_BY", "HANDLED_BY", "CALLS", "EXECUTES", "READS", "WRITES", "HAS_COLUMN", "ENFORCES_RULE", "HAS_RULE", "VERIFIED_BY", "MAPS_TO")


def claim_status(source: Column, confidence: Column) -> Column:
    sure = source.isin(*TRUSTED) & (F.coalesce(confidence, F.lit(0.5)) >= 0.85)
    return F.when(sure, "CONFIRMED").otherwise("PENDING_CONFIRM")


def merge_claims(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row per claim key: evidence (in order of first occurrence), confidence, source_type, status.

    Both: KEY, source_type, confidence, evidence_id, seq. Existing rows come before drafts. The highest
    confidence counts; the source is a person's or a program's before a machine guess, then the more
    confident, then the earlier one. Evidence is deduplicated before it is listed.
    """
    rows = existing.withColumn("draft", F.lit(0)).unionByName(drafts.withColumn("draft", F.lit(1))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    place = F.struct("draft", "seq")
    evidence = rows.where("evidence_id is not null").groupBy(*KEY, "evidence_id").agg(F.min(place).alias("place")).groupBy(*KEY)
    evidence = evidence.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda e: e["evidence_id"]).alias("evidence"))
    best = F.struct(F.col("source_type").isin(*AI).alias("ai"), (-F.col("confidence")).alias("c"), "draft", "seq", "source_type")
    merged = rows.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.min_by("source_type", best).alias("source_type"))
    return merged.join(evidence, list(KEY), "left").withColumn("status", claim_status(F.col("source_type"), F.col("confidence")))


def claims_from_facts(facts: DataFrame) -> DataFrame:
    """Claims that facts (fact_type, fact_key, source_type, confidence) stand for; other types give none."""
    subject = F.when(F.col("fact_type").isin("FEATURE", "CODE_FEATURE"), "Feature").when(F.col("fact_type") == "BUSINESS_OBJECT", "BusinessObject").when(F.col("fact_type") == "BUSINESS_RULE", "BusinessRule").when(F.col("fact_type") == "STATUS_TRANSITION", "StatusTransition")
    predicate = F.when(subject == "Feature", "DESCRIBED_BY").otherwise("MENTIONED_IN")
    made = facts.select(subject.alias("subject_type"), F.col("fact_key").alias("subject_key"), predicate.alias("predicate"), F.lit("Evidence").alias("object_type"), F.concat(F.lit("fact:"), "fact_key").alias("object_key"), "source_type", "confidence")
    return made.where("subject_type is not null")


def list_claims(claims: DataFrame, limit: int = 100, **filters: str | float) -> DataFrame:
    """Claims by confidence, then seq, at most 500; filters are equalities, min_confidence a bound."""
    for name, value in filters.items():
        claims = claims.where(F.col("confidence") >= value if name == "min_confidence" else F.col(name) == value)
    return claims.orderBy(F.desc_nulls_last("confidence"), "seq").limit(min(limit, 500))


def compiled(claims: DataFrame, pending: bool = False, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that claims with an edge predicate project to: confirmed ones, with `pending` all.

    Nodes (node_type, node_key, confidence) are one per identity, edges (src_key, dst_key, edge_type, confidence) one per triple.
    """
    used = claims.where(F.col("predicate").isin(*EDGES) & (F.col("confidence") >= least))
    used = used if pending else used.where("status = 'CONFIRMED'")
    ends = used.select(F.explode(F.array(F.struct(F.col("subject_type").alias("node_type"), F.col("subject_key").alias("node_key")), F.struct(F.col("object_type").alias("node_type"), F.col("object_key").alias("node_key")))).alias("n"), "confidence").where("n.node_key is not null")
    nodes = ends.groupBy("n.node_type", "n.node_key").agg(F.max("confidence").alias("confidence"))
    edges = used.where("object_key is not null").groupBy(F.col("subject_key").alias("src_key"), F.col("object_key").alias("dst_key"), F.col("predicate").alias("edge_type")).agg(F.max("confidence").alias("confidence"))
    return nodes, edges


def type_mismatches(claims: DataFrame) -> DataFrame:
    """(key, types): keys that claims give more than one type, as subject or object."""
    ends = claims.select(F.explode(F.array(F.struct(F.col("subject_key").alias("key"), F.col("subject_type").alias("type")), F.struct(F.col("object_key").alias("key"), F.coalesce("object_type", F.lit("Unknown")).alias("type")))).alias("e")).select("e.*").where("key is not null").distinct()
    return ends.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("types"), F.count("*").alias("n")).where("n > 1").select("key", "types")


def conflicts(claims: DataFrame) -> DataFrame:
    """(seq, subject_key, predicate, first_object, object_key): live claims whose object is another than the first one's."""
    w = Window.partitionBy("subject_key", "predicate").orderBy("seq", "object_key")
    live = claims.where(F.col("status").isin("CONFIRMED", "PENDING_CONFIRM") & F.col("object_key").isNotNull())
    return live.withColumn("first_object", F.first("object_key").over(w)).where("object_key <> first_object").select("seq", "subject_key", "predicate", "first_object", "object_key")


#: Fixed values. Gap detectors: type of subject, what its claims lack or show, severity.
ENTRY, EFFECT = ("EXPOSED_BY", "IMPLEMENTS", "HANDLED_BY"), ("READS", "WRITES", "MATERIALIZED_AS")


def gaps(claims: DataFrame) -> DataFrame:
    """(gap_type, subject_key, severity): what the claims about features, objects and rules leave open. One pass by subject."""
    has = lambda *p: F.bool_or(F.col("predicate").isin(*p))
    source = lambda s: F.bool_or(F.contains("source_type", F.lit(s)))
    table = F.bool_or((F.col("predicate") == "MATERIALIZED_AS") & (F.col("object_type") == "Table"))
    per = claims.groupBy("subject_type", "subject_key").agg(
        has(*ENTRY).alias("entry"), has("EXPOSED_BY").alias("exposed"), has(*EFFECT).alias("effect"), has("ENFORCED_BY").alias("enforced"), source("DOC").alias("doc"), source("CODE").alias("code"), table.alias("table")
    )
    of = lambda t, c: (F.col("subject_type") == t) & c
    c = F.col
    rules = [
        ("doc_only_feature", "HIGH", of("Feature", c("doc") & ~c("entry"))), ("code_only_feature", "MEDIUM", of("Feature", c("code") & ~c("doc"))), ("feature_without_entry", "HIGH", of("Feature", ~c("exposed"))),
        ("feature_without_data_effect", "MEDIUM", of("Feature", ~c("effect"))), ("business_object_without_table", "MEDIUM", of("BusinessObject", ~c("table"))), ("rule_without_enforcement", "MEDIUM", of("BusinessRule", ~c("enforced"))),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(g).alias("gap_type"), F.lit(s).alias("severity"))) for g, s, when in rules]))
    return per.select("subject_key", F.explode(found).alias("g")).select("g.gap_type", "subject_key", "g.severity")


def tool_gaps(runs: DataFrame) -> DataFrame:
    """Gaps of tool evidence: no runs at all, failed runs, runs on a stale index. runs: run_id, status, stale."""
    each = runs.select(F.lit("tool_evidence_insufficient").alias("gap_type"), F.col("run_id").cast("string").alias("subject_key"), F.lit("MEDIUM").alias("severity"), (F.col("status").isin("FAILED", "UNAVAILABLE", "TIMEOUT") | F.col("stale")).alias("bad")).where("bad").drop("bad")
    none = runs.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("tool_evidence_insufficient"), F.lit("none"), F.lit("HIGH"))
    return each.union(none)


def upsert_gaps(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored gaps (gap_type, subject_key, severity, status) after a scan: new ones OPEN, closed ones that occur again reopened, others as they were."""
    s = stored.select("gap_type", "subject_key", F.col("severity").alias("old"), F.col("status").alias("was"))
    both = s.join(found, ["gap_type", "subject_key"], "full")
    status = F.when(F.col("was").isNull(), "OPEN").when(F.col("severity").isNotNull() & F.col("was").isin("RESOLVED", "WONT_FIX"), "OPEN").otherwise(F.col("was"))
    action = F.when(F.col("was").isNull(), "created").when(F.col("severity").isNull(), "kept").when(F.col("was").isin("RESOLVED", "WONT_FIX"), "reopened").otherwise("refreshed")
    return both.select("gap_type", "subject_key", F.coalesce("severity", "old").alias("severity"), status.alias("status"), action.alias("action"))


def by_severity(gaps: DataFrame, limit: int) -> DataFrame:
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return gaps.orderBy(rank, "gap_type", "subject_key").limit(limit)


def first_rule(edges: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """edges with the decision of the first rule (edge_type, source_type, min_confidence, decision) that matches; '*' matches all."""
    decision = F.lit(None).cast("string")
    for edge_type, source, least, said in rules:
        hit = (F.lit(edge_type == "*") | (F.col("edge_type") == edge_type)) & (F.lit(source == "*") | (F.col("source_type") == source)) & (F.col("confidence") >= least)
        decision = F.coalesce(decision, F.when(hit, said))
    return edges.withColumn("decision", F.coalesce(decision, F.lit("REQUIRE_MANUAL_REVIEW")))


#: What a test result does to the confidence of what it tested.
TEST_DELTA = {"PASS": 0.05, "API": -0.1, "DB": -0.15, "PERMISSION": -0.2}


def fed_back(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """(id, confidence, status) of nodes after their test results (id, kind, passed, executed_at, result_id), applied in order and kept in [0, 1]."""
    delta = F.when(F.col("passed"), TEST_DELTA["PASS"])
    for kind in ("API", "DB", "PERMISSION"):
        delta = delta.when(F.col("kind") == kind, TEST_DELTA[kind])
    log = results.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("executed_at", "result_id", delta.otherwise(0.0).alias("delta"), F.col("passed")))).alias("log"))
    step = lambda c, e: F.round(F.least(F.greatest(c + e["delta"], F.lit(0.0)), F.lit(1.0)), 4)
    new = F.aggregate("log", F.coalesce("confidence", F.lit(0.5)), step)
    out = nodes.select("id", "confidence", "status").join(log, "id").withColumn("confidence", new)
    return out.select("id", "confidence", F.when(F.exists("log", lambda e: e["passed"]) & (F.col("confidence") >= 0.8), "CONFIRMED").otherwise(F.col("status")).alias("status"))


def evidence_scores(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, evidence_score): score plus helpful minus unhelpful feedback (id, helpful), not under -10."""
    delta = feedback.groupBy("id").agg(F.sum(F.when(F.col("helpful"), 1).otherwise(-1)).alias("delta"))
    return nodes.join(delta, "id").select("id", F.greatest(F.lit(-10).cast("long"), F.coalesce("evidence_score", F.lit(0)) + F.col("delta")).alias("evidence_score"))


def written_status(source: Column, confidence: Column, requested: Column) -> Column:
    """Status of a node or edge as it is written: guesses wait, what was asked for counts, the unsure waits."""
    return F.when(source.isin(*AI), "PENDING_CONFIRM").when(F.coalesce(F.trim(requested), F.lit("")) != "", requested).when(F.coalesce(confidence, F.lit(1.0)) < 0.5, "PENDING_CONFIRM").otherwise("CONFIRMED")


def fused_results(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(id, confidence, status) after external results (id, verdict confirmed / missing / suspicious): confirmed edges are sure, missing ones come in at 0.85, suspicious ones wait."""
    both = edges.select("id", "confidence", "status").join(results.select("id", "verdict"), "id", "full")
    confidence = F.when(F.col("verdict") == "confirmed", 1.0).when((F.col("verdict") == "missing") & F.col("status").isNull(), 0.85).otherwise(F.col("confidence"))
    status = F.when(F.col("verdict") == "confirmed", "CONFIRMED").when((F.col("verdict") == "missing") & F.col("status").isNull(), "PENDING_CONFIRM").when(F.col("verdict") == "suspicious", "PENDING_CONFIRM").otherwise(F.col("status"))
    return both.select("id", confidence.alias("confidence"), status.alias("status")).where("status is not null")


def verified_evidence(evidence: DataFrame, nodes: DataFrame, project: str, principals: Sequence[str]) -> DataFrame:
    """(answer_id, passed, n, reliability, verified): checks of each answer's evidence (answer_id, id, acl, source_weight).

    A piece passes if its node exists in the project and its access list is empty or names a principal.
    reliability = 0.6 x share passed + 0.4 x mean source weight of what passed.
    """
    known = nodes.where(F.col("project_id") == project).select("id", F.lit(True).alias("known"))
    free = (F.coalesce(F.trim("acl"), F.lit("")) == "") | F.arrays_overlap(F.split(F.lower("acl"), ","), F.lit([p.lower() for p in principals]))
    ok = F.coalesce(F.col("known") & free, F.lit(False))
    per = evidence.join(known, "id", "left").withColumn("ok", ok).groupBy("answer_id").agg(F.count_if("ok").alias("passed"), F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("ok"), F.col("source_weight"))), F.lit(0.0)).alias("w"))
    share = F.col("passed") / F.col("n")
    return per.select("answer_id", "passed", "n", (0.6 * share + 0.4 * F.col("w")).alias("reliability"), ((share >= 0.6) & (F.col("passed") >= 1)).alias("verified"))


def anomalies(nodes: DataFrame, edges: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(anomaly, id): nodes of a type without an outgoing edge of a type; rules: anomaly -> (node_type, edge_type)."""
    kinds = F.create_map(*[x for a, (t, e) in rules.items() for x in (F.lit(f"{t}|{e}"), F.lit(a))])
    wanted = nodes.select("id", "node_type", F.explode(F.array(*[F.lit(e) for e in sorted({e for _, e in rules.values()})])).alias("edge_type"))
    wanted = wanted.withColumn("anomaly", F.try_element_at(kinds, F.concat_ws("|", "node_type", "edge_type"))).where("anomaly is not null")
    return wanted.join(edges.select(F.col("src").alias("id"), "edge_type"), ["id", "edge_type"], "left_anti").select("anomaly", "id")


def quality_gate(nodes: DataFrame, edges: DataFrame, isolated: DataFrame) -> DataFrame:
    """One row: decision and the violated bounds (edges a node >= 1, isolated <= 10 %, no constraint broken, evidence >= 95 %)."""
    evidence = F.coalesce("evidence_ids", F.lit("")) != ""
    n = nodes.agg(F.count("*").alias("n"), F.avg(evidence.cast("double")).alias("evidence"))
    e, i = edges.agg(F.count("*").alias("e")), isolated.agg(F.count("*").alias("i"))
    v = violations(nodes, edges).agg(F.count("*").alias("v"))
    one = n.join(e, F.lit(True)).join(i, F.lit(True)).join(v, F.lit(True))
    bad = F.array_compact(F.array(
        F.when(F.col("e") < F.col("n"), "edge_node_ratio"), F.when(F.col("i") > 0.1 * F.col("n"), "isolated"), F.when(F.col("v") > 0, "constraints"), F.when(F.col("evidence") < 0.95, "evidence"),
    ))
    return one.select(F.when(F.size(bad) == 0, "PASSED").otherwise("FAILED").alias("decision"), F.array_join(bad, ",").alias("violated"))


def endpoint_drift(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(endpoint, verdict) of a specification against code (endpoint, params): confirmed, suspicious where parameters differ, missing in code, undocumented."""
    both = spec.select("endpoint", F.col("params").alias("a"), F.lit(1).alias("in_spec")).join(code.select("endpoint", F.col("params").alias("b"), F.lit(1).alias("in_code")), "endpoint", "full")
    verdict = F.when(F.col("in_code").isNull(), "missing").when(F.col("in_spec").isNull(), "undocumented").when(F.col("a").eqNullSafe(F.col("b")), "confirmed").otherwise("suspicious")
    return both.select("endpoint", verdict.alias("verdict"))


def released_state(releases: DataFrame, events: DataFrame) -> DataFrame:
    """(release_id, state) after events (release_id, seq, event): DRAFT starts to validate, then is published or fails; other events change nothing."""
    log = events.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("log"))
    step = lambda s, e: (
        F.when((s == "DRAFT") & (e["event"] == "validate"), "VALIDATING").when((s == "VALIDATING") & (e["event"] == "publish"), "PUBLISHED").when((s == "VALIDATING") & (e["event"] == "fail"), "FAILED").otherwise(s)
    )
    return releases.join(log, "release_id", "left").select("release_id", F.coalesce(F.aggregate("log", F.lit("DRAFT"), step), F.lit("DRAFT")).alias("state"))
