"""Records must not depend on how Spark cuts files when the caller's action is planned."""

from skein.llm.warc import read_warc, write_warc


def test_ranges_change_before_the_action(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (1 + i % 40)) for i in range(200)], "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    write_warc(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        records = read_warc(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1100")
        got = sorted((r.record_id, bytes(r.payload).decode()) for r in records.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((f"<urn:page:{i}>", f"page {i} " * (1 + i % 40)) for i in range(200))
