"""Paths and traversals: frontier joins that stop when a level adds nothing; rounds are written to the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import bucketed, drop, materialize

#: Edge types that a change travels against.
REVERSE_TYPES = ("CALLS", "READS", "WRITES", "BELONGS_TO", "DEPENDS_ON", "IMPLEMENTS", "EXTENDS", "IMPLEMENTED_BY", "EXPOSED_BY")


#: Presets of edge types by what changes.
PRESETS = {"TABLE_REVERSE": ("READS", "WRITES", "JOINS", "EXECUTES", "CONTAINS", "CALLS", "HANDLED_BY"), "API_REVERSE": ("CALLS", "EXPOSED_BY", "HANDLED_BY"), "SERVICE_REVERSE": ("CALLS", "CONTAINS", "HANDLED_BY", "IMPLEMENTS")}


def oriented(edges: DataFrame, direction: str = "out", edge_types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, id) as travelled: out, in or both ways."""
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(list(edge_types)))
    out, back = e.select("src", "dst", "id"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int, direction: str = "out", edge_types: Sequence[str] | None = None) -> DataFrame:
    """(id, level, parent, via): every node within max_depth of seeds (id), with the level of its first discovery.

    Of several discoveries on one level the edge with the least id is kept. Seeds have level 0.
    Edges are shuffled once, into buckets by source that every level reads as they lie: a level shuffles only the last one's
    nodes, the edges at them and the ids that are known. Each level is written once.
    """
    steps, drop_steps = bucketed(oriented(edges, direction, edge_types), "src", "steps")
    start = seeds.select("id").distinct().select("id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"))
    last, _ = materialize(start, "reach")
    known = last
    for level in range(1, max_depth + 1):
        frontier = last.select(F.col("id").alias("src"))
        new = frontier.hint("shuffle_hash").join(steps, "src").groupBy("dst").agg(F.min(F.struct("id", "src")).alias("m")).join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
        last, at = materialize(new.select(F.col("dst").alias("id"), F.lit(level).alias("level"), F.col("m.src").alias("parent"), F.col("m.id").alias("via")), "reach")
        if not last.limit(1).count():
            drop(known.sparkSession, at)
            break
        known = known.union(last)
    drop_steps()
    return known


def paths(seeds: DataFrame, edges: DataFrame, max_depth: int, direction: str = "out", edge_types: Sequence[str] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(start, end, depth, nodes, path_edges): trails of 1..max_depth edges from seeds; no edge occurs twice in one.

    With ends (id), a backward pass first finds what can still reach an end in the steps left, and trails
    that cannot are never built.
    """
    steps, _ = materialize(oriented(edges, direction, edge_types), "steps")
    allowed = None
    if ends is not None:
        back = {"out": "in", "in": "out", "both": "both"}[direction]
        allowed = reach(ends, edges, max_depth, back, edge_types).select(F.col("id").alias("dst"), F.col("level").alias("left"))
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("depth"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("path_edges"))
    out = None
    for depth in range(1, max_depth + 1):
        step = steps.join(allowed.where(F.col("left") <= max_depth - depth), "dst", "left_semi") if allowed is not None else steps
        grown = now.join(step.withColumnRenamed("src", "end"), "end").where(~F.array_contains("path_edges", F.col("id")))
        now = grown.select("start", F.col("dst").alias("end"), F.lit(depth).alias("depth"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("path_edges", F.col("id")).alias("path_edges"))
        now, _ = materialize(now, "trails")
        out = now if out is None else out.union(now)
    return out if ends is None else out.join(ends.select(F.col("id").alias("end")), "end", "left_semi")


def best_trails(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int, k: int, direction: str = "out", edge_types: Sequence[str] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The k first trails of 1..max_depth edges from seeds (id) to ends (id; any node if None), by depth, then by `trail`, exact.

    Returns start, end, depth, trail (node ids joined by '>'), path_edges and confidence, the least of its nodes' (null: none
    known). No edge occurs twice in a trail.

    Depth by depth, and only until k are found: a backward pass says which nodes can reach an end in exactly the steps that are
    left, and of the trails so far that stand at one node only the first `keep` go on, so a hub costs keep trails, not all.
    As edges must not repeat, a trail that was left could be the start of one of the k first: all its continuations sort
    behind it, so the depth is run again with a larger `keep` unless k found ones sort before every trail that was left.
    Without ends nothing is asked backward: trails that can't go on end by themselves. Confidences are looked up for the nodes
    of the k trails only, so nodes are read once and not shuffled.
    """
    steps, steps_at = materialize(oriented(edges, direction, edge_types), "steps")
    left = [None if ends is None else ends.select("id").distinct()]
    places = []
    for _ in range(max_depth):
        if ends is None:
            left.append(None)
            continue
        back = steps.join(left[-1].withColumnRenamed("id", "dst"), "dst", "left_semi")
        level, at = materialize(back.select(F.col("src").alias("id")).distinct(), "left")
        left.append(level)
        places.append(at)
    start = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.col("id").cast("string").alias("trail"), F.array().cast("array<string>").alias("path_edges"), F.array("id").alias("nodes"))
    found, need = [], k
    for depth in range(1, max_depth + 1):
        keep, first = k, start if ends is None else start.join(left[depth].withColumnRenamed("id", "end"), "end", "left_semi")
        while need > 0:
            now, cut, made = first, None, []
            for d in range(1, depth + 1):
                to = left[depth - d]
                step = steps if to is None else steps.join(to.withColumnRenamed("id", "dst"), "dst", "left_semi")
                grown = now.join(step.withColumnRenamed("src", "end"), "end").where(~F.array_contains("path_edges", F.col("id")))
                grown = grown.select("start", F.col("dst").alias("end"), F.concat_ws(">", "trail", "dst").alias("trail"), F.array_append("path_edges", F.col("id")).alias("path_edges"), F.array_append("nodes", F.col("dst")).alias("nodes"))
                place = F.row_number().over(Window.partitionBy("end").orderBy("trail", "path_edges"))
                grown, at = materialize(grown.withColumn("place", place), "trails")
                made.append(at)
                if d < depth:
                    least = grown.where(F.col("place") > keep).agg(F.min("trail").alias("m")).first()["m"]
                    cut = least if cut is None or least is not None and least < cut else cut
                now = grown.where(F.col("place") <= (keep if d < depth else k)).drop("place")
            best, best_at = materialize(now.withColumn("depth", F.lit(depth)).orderBy("trail", "path_edges").limit(need), "best")
            last = best.agg(F.count("*").alias("n"), F.max("trail").alias("m")).first()
            for at in made:
                drop(steps.sparkSession, at)
            if cut is None or last["n"] == need and last["m"] < cut:
                found.append(best)
                need -= last["n"]
                break
            drop(steps.sparkSession, best_at)
            keep *= 4
    for at in [steps_at, *places]:
        drop(steps.sparkSession, at)
    out = found[0]
    for best in found[1:]:
        out = out.union(best)
    out, _ = materialize(out.withColumn("n", F.monotonically_increasing_id()), "best")
    on = F.broadcast(out.select("n", F.explode("nodes").alias("id")))  # k trails of max_depth + 1 nodes at most
    least = nodes.select("id", "confidence").join(on, "id").groupBy("n").agg(F.min("confidence").alias("confidence"))
    return out.join(F.broadcast(least), "n", "left").select("start", "end", "depth", "trail", "path_edges", "confidence")


def with_confidence(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with the least confidence among their nodes (null: none known)."""
    key = ["start", "path_edges", "nodes"]
    least = found.select(*key, F.explode("nodes").alias("id")).join(nodes.select("id", "confidence"), "id").groupBy(*key).agg(F.min("confidence").alias("confidence"))
    return found.join(least, key, "left")


def neighbours(edges: DataFrame, ids: DataFrame, cap: int = 20) -> DataFrame:
    """(id, neighbour): at most cap neighbours of each, by id."""
    n = ids.select("id").join(oriented(edges, "both").select(F.col("src").alias("id"), F.col("dst").alias("neighbour")), "id").distinct()
    return n.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("neighbour"))).where(F.col("r") <= cap).drop("r")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, cap: int = 20) -> DataFrame:
    """(id, level) within depth, expanding at most cap neighbours of each node."""
    known, at = materialize(seeds.select("id", F.lit(0).alias("level")).distinct(), "near")
    for level in range(1, depth + 1):
        frontier = known.where(F.col("level") == level - 1)
        new = neighbours(edges, frontier, cap).select(F.col("neighbour").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        grown, grown_at = materialize(known.union(new.withColumn("level", F.lit(level))), "near")
        drop(known.sparkSession, at)
        known, at = grown, grown_at
    return known


def blast_radius(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """(source, target, edge_type): what depends on nodes of the changed files (source_path), directly."""
    hit = nodes.join(changed_paths.select("source_path").distinct(), "source_path", "left_semi").select(F.col("id").alias("dst"))
    found = edges.where(F.col("edge_type").isin(*REVERSE_TYPES)).join(hit, "dst", "left_semi")
    return found.select(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type").distinct()


def affected_reasons(radius: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, reason): 'type <- key (path)' of everything that affects a node, joined by '; '."""
    r = radius.join(nodes.select(F.col("id").alias("target"), "node_key", "source_path"), "target")
    return r.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.format_string("%s <- %s (%s)", "edge_type", "node_key", "source_path"))), "; ").alias("reason"))


def transitive_closure(edges: DataFrame, edge_type: str, longest: int = 3) -> DataFrame:
    """(src, dst) over 2..longest edges of a type, without direct edges and loops."""
    one = edges.where(F.col("edge_type") == edge_type).select("src", "dst").distinct()
    far, found = one, None
    for _ in range(longest - 1):
        far = far.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("further")), "dst").select("src", F.col("further").alias("dst")).distinct()
        found = far if found is None else found.union(far)
    return found.where("src <> dst").distinct().join(one, ["src", "dst"], "left_anti")


def chain_coverage(start: DataFrame, edges: DataFrame, chain: Sequence[Sequence[str]]) -> DataFrame:
    """(id, layers): how many layers of a chain of edge types each start reaches, one after the other."""
    out, now = start.select("id").withColumn("layers", F.lit(0)), start.select("id", F.col("id").alias("at"))
    for i, types in enumerate(chain, 1):
        step = edges.where(F.col("edge_type").isin(list(types))).select(F.col("src").alias("at"), F.col("dst").alias("to"))
        now = now.join(step, "at").select("id", F.col("to").alias("at")).distinct()
        hit = now.select("id").distinct().withColumn("hit", F.lit(i))
        out = out.join(hit, "id", "left").select("id", F.greatest("layers", F.coalesce("hit", F.lit(0))).alias("layers"))
    return out


def covered_status(share):
    return F.when(share >= 0.8, "COVERED").when(share >= 0.3, "PARTIAL").otherwise("MISSING")


def coverage_risk(share):
    return F.when(share < 0.5, "HIGH").when(share < 0.8, "MEDIUM").otherwise("LOW")


def lineage(targets: DataFrame, nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str], depth: int = 4) -> DataFrame:
    """(requirement_id, id, risk, columns): tables that a requirement's targets (requirement_id, id) are, at risk 1, or lead back to, at 0.7.

    Reach is found once for the distinct targets with each one's own levels, not once a requirement. columns
    counts the table's columns.
    """
    steps = oriented(edges, "in", edge_types)
    now = targets.select("requirement_id", "id").distinct()
    found, at = materialize(now.withColumn("level", F.lit(0)), "lineage")
    for level in range(1, depth + 1):
        new = found.where(F.col("level") == level - 1).join(steps.select(F.col("src").alias("id"), F.col("dst").alias("to")), "id").select("requirement_id", F.col("to").alias("id")).distinct()
        new = new.join(found.select("requirement_id", "id"), ["requirement_id", "id"], "left_anti").withColumn("level", F.lit(level))
        grown, grown_at = materialize(found.union(new), "lineage")
        drop(found.sparkSession, at)
        found, at = grown, grown_at
    tables = nodes.where("node_type = 'Table'").select("id")
    columns = edges.where("edge_type = 'HAS_COLUMN'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("columns"))
    risk = F.when(F.col("level") == 0, 1.0).otherwise(0.7)
    return found.join(tables, "id", "left_semi").join(columns, "id", "left").select("requirement_id", "id", risk.alias("risk"), F.coalesce("columns", F.lit(0)).alias("columns"))


def incident(edges: DataFrame, ids: DataFrame, limit: int = 200) -> DataFrame:
    """At most `limit` edges at the nodes, by id."""
    i = ids.select("id").distinct()
    at = lambda end: edges.join(i.withColumnRenamed("id", end), end, "left_semi").select("id", "src", "dst", "edge_type")
    return at("src").union(at("dst")).distinct().orderBy("id").limit(limit)
