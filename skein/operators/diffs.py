"""Set operations, differences between versions and snapshots, renames, tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with change 'added' or 'removed'; null keys are equal to each other."""
    a, b = old.select(*key).distinct(), new.select(*key).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: shared, left_only, right_only, rate (Jaccard; 1 for two empty sides). One shuffle by key."""
    both = left.select(key, F.lit(1).alias("side")).union(right.select(key, F.lit(2).alias("side")))
    sides = both.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    n = sides.agg(F.count_if(F.col("lo") < F.col("hi")).alias("shared"), F.count_if(F.col("hi") == 1).alias("left_only"), F.count_if(F.col("lo") == 2).alias("right_only"))
    return n.withColumn("rate", F.round(F.coalesce(F.try_divide("shared", F.col("shared") + F.col("left_only") + F.col("right_only")), F.lit(1.0)), 6))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of new whose stored hash is missing or another."""
    stored = old.select("file_path", F.col("file_hash").alias("stored"))
    return new.join(stored, "file_path", "left").where(~F.col("stored").eqNullSafe(F.col("file_hash"))).select("file_path", "file_hash")


def unchanged_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_semi").select("file_path")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path): disappeared and appeared files of one hash, paired one to one in order of their paths."""
    numbered = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("file_hash").orderBy("file_path")))
    gone = numbered(old.join(new.select("file_path"), "file_path", "left_anti")).select("file_hash", "r", F.col("file_path").alias("old_path"))
    came = numbered(new.join(old.select("file_path"), "file_path", "left_anti")).select("file_hash", "r", F.col("file_path").alias("new_path"))
    return gone.join(came, ["file_hash", "r"]).select("old_path", "new_path")


def logic_rescans(old: DataFrame, new: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Files of both snapshots of which a version attribute differs."""
    differs = F.lit(False)
    for v in versions:
        differs = differs | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    return new.alias("n").join(old.alias("o"), F.col("n.file_path") == F.col("o.file_path")).where(differs).select("n.file_path")


def recorded(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after new files are recorded: theirs replace those of the same path."""
    return old.join(new.select("file_path"), "file_path", "left_anti").select(new.columns).union(new)


def chunk_actions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): delete what is gone, insert what is new, keep the rest."""
    both = old.select(key, F.lit(1).alias("side")).union(new.select(key, F.lit(2).alias("side"))).groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return both.select(key, F.when(F.col("hi") == 1, "delete").when(F.col("lo") == 2, "insert").otherwise("keep").alias("action"))


def tombstoned(rows: DataFrame, snapshot: DataFrame, path: str = "source_path") -> DataFrame:
    """rows plus deleted: 1 where the path is not in the snapshot (a null path never is tombstoned)."""
    there = snapshot.select(F.col(path).alias(path)).distinct().withColumn("there", F.lit(True))
    gone = F.col(path).isNotNull() & F.col("there").isNull()
    return rows.drop("deleted").join(there, path, "left").withColumn("deleted", gone.cast("int")).drop("there")


def cloned(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """target plus those rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(target.columns))


def schema_fingerprints(columns: DataFrame) -> DataFrame:
    """(table, fingerprint) of columns (table, name, type, nullable): SHA-256 of table:name:type:(Y/N) by name, joined by commas."""
    one = F.concat_ws(":", "table", "name", "type", F.when(F.col("nullable"), "Y").otherwise("N"))
    held = F.array_sort(F.collect_list(F.struct("name", one.alias("text"))))
    return columns.groupBy("table").agg(F.sha2(F.array_join(F.transform(held, lambda c: c["text"]), ","), 256).alias("fingerprint"))


def wildcard(patterns: Sequence[str]) -> str:
    """A regular expression of names that match any of the patterns with * and ?, in any case."""
    import re

    return "(?i)^(" + "|".join(re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in patterns) + ")$"


def included(tables: DataFrame, name: str, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Rows whose name an include matches (none given: all) and no exclude does."""
    found = tables.where(F.col(name).rlike(wildcard(includes))) if includes else tables
    return found.where(~F.col(name).rlike(wildcard(excludes))) if excludes else found
