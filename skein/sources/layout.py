"""Clustered tables with zone maps: least and greatest values by file say which files a scan can leave unread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comparisons that zones can answer, by name: whether a file with these least and greatest values may hold a match.
_MAY = {
    "=": lambda lo, hi, v: (lo <= F.lit(v)) & (hi >= F.lit(v)),
    "<": lambda lo, hi, v: lo < F.lit(v),
    "<=": lambda lo, hi, v: lo <= F.lit(v),
    ">": lambda lo, hi, v: hi > F.lit(v),
    ">=": lambda lo, hi, v: hi >= F.lit(v),
    "in": lambda lo, hi, v: _any([(lo <= F.lit(x)) & (hi >= F.lit(x)) for x in v]),
    "prefix": lambda lo, hi, v: (hi >= F.lit(v)) & (F.substring(lo, 1, len(v)) <= F.lit(v)),
}
_IS = {
    "=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "prefix": lambda c, v: c.startswith(v),
}

#: Rows of a file at most, by which larger tables get more files: a task sorts one file's rows.
ROWS = 1_000_000

#: (column, comparison, value)
Condition = tuple[str, str, object]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def cluster(df: DataFrame, path: str, by: Sequence[str], zones: Sequence[str] = (), files: int = 32, bloom: Sequence[str] = ()) -> None:
    """Writes df sorted by ranges of `by`, some `files` files (more where these would hold over ROWS rows each), and beside it a row for each file with its zones.

    zones: further columns whose least and greatest values are kept. bloom: columns that get Parquet's own Bloom filters, for
    keys that the order does not bring together. Rows without a value in `by` come first and count in no zone of that column.
    """
    files = max(files, -(-df.count() // ROWS))
    writer = df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("compression", "zstd")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    writer.parquet(path)
    kept = list(dict.fromkeys([*by, *zones]))
    spread = [x for c in kept for x in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"), F.count(c).alias(f"n_{c}"))]
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.groupBy(F.input_file_name().alias("file")).agg(*spread).coalesce(1).write.parquet(f"{path}-zones")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    whole = spark.read.parquet(path)
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)


def pruned(spark: SparkSession, path: str, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that meet all conditions: the same as a filter, from the files whose zones allow it.

    Comparisons: = < <= > >= in prefix; conditions on columns without zones prune nothing. Nulls meet none. Only the names of
    files that are left come to the driver, which lists files for any scan.
    """
    zones = spark.read.parquet(f"{path}-zones")
    hit = F.lit(True)
    for c, op, v in conditions:
        if f"least_{c}" in zones.columns:
            hit = hit & _MAY[op](F.col(f"least_{c}"), F.col(f"most_{c}"), v)
    rows = _read(spark, path, [r["file"] for r in zones.where(hit).select("file").collect()])
    for c, op, v in conditions:
        rows = rows.where(_IS[op](F.col(c), v))
    return rows


def window(spark: SparkSession, path: str, by: str, after: object | None, limit: int) -> DataFrame:
    """The first `limit` rows after a key in the order of `by` (first column of the clustering): keyset paging that reads a file or two.

    Files are in order, so the ones to read are those from the key's on until they hold enough rows; the key's own file
    counts for none, as all its rows may lie before the key.
    """
    zones = spark.read.parquet(f"{path}-zones")
    later = zones if after is None else zones.where(F.col(f"most_{by}") > F.lit(after))
    files, held = [], 0
    for r in later.where(F.col(f"most_{by}").isNotNull()).orderBy(f"least_{by}", "file").select("file", F.col(f"n_{by}").alias("n"), F.col(f"least_{by}").alias("least")).toLocalIterator():
        if held >= limit:
            break
        files.append(r["file"])
        held += r["n"] if after is None or r["least"] > after else 0
    rows = _read(spark, path, files)
    rows = rows.where(F.col(by).isNotNull()) if after is None else rows.where(F.col(by) > F.lit(after))
    return rows.orderBy(by).limit(limit)
