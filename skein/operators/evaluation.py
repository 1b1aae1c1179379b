"""Evaluation of answers, retrieval and graphs; risk and confidence scores; reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import clamped, sentences, tokens

#: Weights of coverage, reliability, consistency, path and timeliness.
CONFIDENCE = {"default": (0.30, 0.25, 0.20, 0.15, 0.10), "high_risk": (0.20, 0.25, 0.20, 0.35, 0.0)}
#: What kind of change weighs how much.
CHANGE = {"SCHEMA_CHANGE": 1.5, "API_CONTRACT": 1.4, "INTERNAL_ONLY": 1.0, "READ_ONLY": 0.6}


def context_precision(contexts: Column, expected: Column) -> Column:
    """Share of the expected terms that the contexts' text holds, in any case; blank ones do not count; 1 if none is expected."""
    low = F.lower(F.array_join(contexts, "\n"))
    wanted = F.filter(expected, lambda e: F.trim(F.coalesce(e, F.lit(""))) != "")
    return F.coalesce(F.try_divide(F.size(F.filter(wanted, lambda e: F.contains(low, F.lower(e)))), F.size(wanted)), F.lit(1.0))


def context_recall(contexts: Column, entities: Column) -> Column:
    """Share of the entities that the contexts hold; blank ones count as not held; 1 without entities, 0 without contexts."""
    low = F.lower(F.array_join(contexts, "\n"))
    held = F.size(F.filter(entities, lambda e: (F.trim(F.coalesce(e, F.lit(""))) != "") & F.contains(low, F.lower(e))))
    return F.when(F.size(entities) == 0, 1.0).when(F.size(contexts) == 0, 0.0).otherwise(held / F.size(entities))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's sentences of which half the tokens stand in the contexts; 1 without sentences, 0 without contexts."""
    low = F.lower(F.array_join(contexts, "\n"))
    said = sentences(answer)
    grounded = lambda s: (F.size(tokens(s)) > 0) & (F.size(F.filter(tokens(s), lambda t: F.contains(low, t))) * 2 >= F.size(tokens(s)))
    return F.when(F.size(said) == 0, 1.0).when(F.size(contexts) == 0, 0.0).otherwise(F.size(F.filter(said, grounded)) / F.size(said))


#: What an answer says that does not answer.
ABSTAIN = r"(?i)(no evidence|not found|cannot answer|don't know|insufficient)"


def abstains(answer: Column, least: int = 20) -> Column:
    return (F.length(F.coalesce(F.trim(answer), F.lit(""))) < least) | answer.rlike(ABSTAIN)


def qa_run(cases: DataFrame) -> DataFrame:
    """One row over cases (entities, found, evidence, used, keywords, hit: counts; must_abstain, abstained): rates over all counts and the gate .85 / .90 / .95."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(1.0))
    out = cases.agg(rate("found", "entities").alias("entity_recall"), rate("used", "evidence").alias("evidence_precision"), rate("hit", "keywords").alias("keyword_coverage"), F.avg((F.col("must_abstain") == F.col("abstained")).cast("double")).alias("abstention_accuracy"))
    return out.withColumn("passed", (F.col("entity_recall") >= 0.85) & (F.col("evidence_precision") >= 0.9) & (F.col("abstention_accuracy") >= 0.95))


def benchmark_score(expected: DataFrame, found: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: recall of expected keys (kind node or edge, key) and share of forbidden edges among the found; gate .9 / .85 / .02."""
    hit = expected.distinct().join(found.distinct().withColumn("hit", F.lit(1)), ["kind", "key"], "left")
    recall = lambda kind: F.coalesce(F.try_divide(F.count_if((F.col("kind") == kind) & F.col("hit").isNotNull()), F.count_if(F.col("kind") == kind)), F.lit(1.0))
    bad = found.where("kind = 'edge'").select("key").distinct().join(forbidden.select("key", F.lit(1).alias("bad")).distinct(), "key", "left").agg(F.coalesce(F.try_divide(F.sum("bad"), F.count("*")), F.lit(0.0)).alias("forbidden_rate"))
    out = hit.agg(recall("node").alias("node_recall"), recall("edge").alias("edge_recall")).join(bad, F.lit(True))
    return out.withColumn("passed", (F.col("node_recall") >= 0.9) & (F.col("edge_recall") >= 0.85) & (F.col("forbidden_rate") <= 0.02))


def timeliness(age_hours: Column) -> Column:
    """1 up to an hour, falling to one half over a day; one half for older or unknown."""
    return F.when(age_hours.isNull(), 0.5).when(age_hours <= 1, 1.0).when(age_hours <= 24, 1 - (age_hours - 1) * 0.5 / 23).otherwise(0.5)


def confidence_score(parts: Sequence[Column], kind: str = "default") -> Column:
    return clamped(sum(F.lit(w) * clamped(p) for w, p in zip(CONFIDENCE[kind], parts, strict=True)))


#: Kinds of complaints and the words that tell them, the first that matches.
ISSUES = (("MISSING_EVIDENCE", "evidence|source|citation"), ("IRRELEVANT_ANSWER", "irrelevant|unrelated"), ("WRONG_ANSWER", "wrong|incorrect|inaccurate"), ("INCOMPLETE_ANSWER", "incomplete|missing"))


def issue_of(answer: Column, complaint: Column, evidence: Column) -> Column:
    said = F.lower(F.coalesce(complaint, F.lit("")))
    kind = F.when(F.length(F.coalesce(F.trim(answer), F.lit(""))) < 20, "NO_ANSWER")
    for name, words in ISSUES:
        hit = said.rlike(words)
        kind = kind.when(hit & (F.coalesce(F.trim(evidence), F.lit("")) == "") if name == "MISSING_EVIDENCE" else hit, name)
    return kind.otherwise("OTHER")


def issue_distribution(feedback: DataFrame) -> DataFrame:
    """(issue, n) over feedback (answer, complaint, evidence); kinds that do not occur count 0."""
    found = feedback.groupBy(issue_of(F.col("answer"), F.col("complaint"), F.col("evidence")).alias("issue")).agg(F.count("*").alias("n"))
    kinds = feedback.sparkSession.range(1).select(F.explode(F.lit(["NO_ANSWER", *[n for n, _ in ISSUES], "OTHER"])).alias("issue"))
    return kinds.join(found, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"))


def path_decay(depth: Column) -> Column:
    return 1 / F.log2(depth + 2)


def risk_score(confidence: Column, depth: Column, change: Column, tested: Column, asset: Column | float = 1.0, hotness: Column | float = 1.0) -> Column:
    """confidence x decay by depth x weight of the change x asset x 1.5 if untested x hotness."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANGE.items() for x in kv]), F.upper(change)), F.lit(1.0))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return confidence * path_decay(depth) * weight * as_column(asset) * F.when(tested, 1.0).otherwise(1.5) * as_column(hotness)


def impact_name(depth: Column) -> Column:
    return F.concat(F.lit("L"), F.least(depth, F.lit(4)).cast("string"))


def graded(share: Column, degree: Column) -> Column:
    """Connectivity by share of isolated nodes and mean degree."""
    return F.when((share <= 0.05) & (degree >= 2), "good").when((share <= 0.15) & (degree >= 1), "fair").otherwise("poor")


def stacked(one: DataFrame, metrics: Mapping[str, tuple[Column, float, bool]]) -> DataFrame:
    """(metric, value, target, passed) of one row of measures; metrics: name -> (value, target, whether larger is better)."""
    rows = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(float(t)).alias("target"), ((v >= t) if up else (v <= t)).alias("passed")) for m, (v, t, up) in metrics.items()]
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def markdown_table(df: DataFrame, columns: Sequence[str], *order: Column | str, limit: int = 100) -> DataFrame:
    """One row: a short report table as Markdown (column text); its `limit` keeps the report, and what one task joins, short."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    some = df.orderBy(*order).limit(limit).withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", row.alias("r")))), lambda x: x["r"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return some.agg(F.concat(F.lit(head + "\n"), body).alias("text"))
