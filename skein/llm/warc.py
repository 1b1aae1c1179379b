"""WARC archives: written by tasks, read back by byte ranges with boundary-chain verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.storage import drop, materialize

MAGIC = "WARC/1.0\r\n"
_END = "\r\n\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Records a file: bounds a file's chain, hence the rounds of pointer jumping.
FILE_RECORDS = 2048
#: Rows up to which a side is broadcast; counted first, shuffled beyond it.
BROADCAST_ROWS = 500_000


def _sized(side: DataFrame) -> DataFrame:
    """A materialized side, marked for broadcast if it is small."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html; other columns are ignored) to files under path.

    The payload is html in UTF-8, a null one empty, behind an HTTP response head. Of records with
    equal payloads of REVISIT_BYTES bytes or more, that with the smallest page_id is `response`
    and the others are `revisit` records, which name it and carry no payload; all rows of that
    page_id are responses. A null page_id is never referred to. A null url leaves its header out;
    line ends in a url are percent-encoded. An empty table gives no records.

    Digests are compared, not payloads; only rows whose digest occurs again are looked up, so
    payloads stay where they were read unless those rows are too many to broadcast.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html"))
    again = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again, at = materialize(again.select("digest", "first"), "again")
    found = rows.join(_sized(again), "digest", "left").withColumn("refers", F.when(F.col("bytes") >= REVISIT_BYTES, F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    found.select(F.concat(header, F.lit(_END), block).alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    drop(pages.sparkSession, at)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic strings: file, block (start of the byte range), serial (order in it), value.

    Spark cuts files in byte ranges and each task reads from the first magic in its range to the
    first past its end. Ranges and the numbers in them depend on the cores there are when the scan
    is planned, so what is to be joined by them must come from one scan.
    """
    value = spark.read.option("lineSep", MAGIC).text(path)
    return value.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("serial"))


def record_chains(spark: SparkSession, path: str, pieces: DataFrame | None = None) -> DataFrame:
    """Every candidate record under path: file, block, serial, start, size, successor, reached.

    pieces: the scan of path (see `_pieces`) where the caller has it materialized.

    A candidate starts wherever the magic string stands. Tasks emit its offset and that of its
    successor, from its own Content-Length; whether it is a record shows only in whether the chain
    from the file's start reaches it. Pointer jumping finds that: in each round the reached set
    takes what its jumps lead to, and jumps double, so a file of n records takes log2(n) rounds of
    joins over offsets; payloads take no part.
    """
    head = F.substring_index("value", _END, 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    slim = (_pieces(spark, path) if pieces is None else pieces).select(
        "file", "block", "serial", F.octet_length("value").cast("long").alias("bytes"), F.octet_length(head).cast("long").alias("head"), F.when(length != "", length).try_cast("long").alias("length")
    )
    slim, slim_at = materialize(slim, "pieces")
    in_block = Window.partitionBy("file", "block").orderBy("serial")
    step = F.col("bytes") + len(MAGIC)
    blocks = slim.groupBy("file", "block").agg(F.sum(step).alias("total"))
    base = blocks.select("file", "block", (F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")).alias("base"))
    placed = slim.withColumn("own", F.sum(step).over(in_block) - step).join(base, ["file", "block"])
    # a piece starts behind its magic; a file's first piece has none and is empty in a sound file
    start = F.col("base") + F.col("own") - len(MAGIC)
    candidates = placed.select(
        "file", "block", "serial", "bytes", start.alias("start"),
        (start + len(MAGIC) + F.col("head") + len(_END) + F.col("length") + len(_END)).alias("successor"),
    )
    candidates, _ = materialize(candidates, "candidates")
    drop(spark, slim_at)
    jumps, jumps_at = materialize(candidates.where("start >= 0 and successor is not null").select("file", "start", F.col("successor").alias("to")), "jumps")
    reached, reached_at = materialize(candidates.where("start = 0").select("file", "start"), "reached")
    n = reached.count()
    while True:
        more = reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))
        new, new_at = materialize(reached.union(more).distinct(), "reached")
        size = new.count()
        drop(spark, reached_at)
        reached, reached_at = new, new_at
        if size == n:
            break
        n = size
        on = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        # an offset whose doubled jump leaves the chain loses it: what it reaches is reached already
        doubled, doubled_at = materialize(jumps.join(on, ["file", "to"]).select("file", "start", F.col("further").alias("to")), "jumps")
        drop(spark, jumps_at)
        jumps, jumps_at = doubled, doubled_at
    flags = reached.withColumn("reached", F.lit(True))
    return candidates.join(flags, ["file", "start"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The verified records under path: record_id, record_type, refers_to, target_uri, digest, http_length, payload.

    record_type, refers_to, target_uri and digest are what the headers say (null where they say
    nothing); payload is the block, without its HTTP head if it has one, as binary; http_length
    is that head's Content-Length. A magic string inside a payload starts a candidate that no
    chain reaches; its piece is joined back to the record that holds it. A damaged record ends the
    chain of its file: what follows it is not returned.

    Archives are scanned once, into a table of pieces that offsets and records both come from: a
    scan planned anew could cut other ranges (see `_pieces`). Each piece finds its record by range
    and order; only records of several pieces are gathered by key.
    """
    scanned, _ = materialize(_pieces(spark, path), "scan")
    chains = record_chains(spark, path, scanned).where("start >= 0")
    owner = F.max(F.when(F.col("reached"), F.col("start"))).over(Window.partitionBy("file").orderBy("start"))
    owned = chains.withColumn("owner", owner).where("owner is not null")
    owned = owned.withColumn("parts", F.count("*").over(Window.partitionBy("file", "owner")))
    owned, _ = materialize(owned.select("file", "block", "serial", "bytes", "start", "owner", "parts"), "owned")
    pieces = scanned.join(_sized(owned), ["file", "block", "serial"])
    if (n := pieces.count()) != (m := owned.count()):
        raise RuntimeError(f"{n} pieces found for {m} of verified records under {path}")
    single = pieces.where("parts = 1").select("value")
    gathered = pieces.where("parts > 1").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("p"))
    several = gathered.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    head = F.substring_index("value", _END, 1)
    field = lambda name, of="head": F.nullif(F.regexp_extract(of, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    records = single.union(several).select("value", head.alias("head"))
    records = records.withColumn("block", F.expr(f"substring(cast(value as binary), octet_length(head) + {len(_END) + 1}, cast(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1) as int))"))
    http = F.coalesce(field("Content-Type").startswith("application/http"), F.lit(False))
    records = records.withColumn("http", F.when(http, F.substring_index(F.col("block").cast("string"), _END, 1)))
    return records.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"), field("WARC-Payload-Digest").alias("digest"),
        field("Content-Length", "http").cast("long").alias("http_length"),
        F.expr(f"case when http is null then block else substring(block, octet_length(http) + {len(_END) + 1}, octet_length(block)) end").alias("payload"),
    )
