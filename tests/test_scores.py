"""Scores at their bounds: counts times decimals are exact, as in SQL."""

from datetime import datetime

from skein.plans import catalog


def test_verified_at_the_bound(spark, tmp_path):
    """0 + 17 x 0.05 is 0.85, which counts as verified; three steps are 0.15 as SQL says it."""
    at = lambda name: f"file://{tmp_path}/{name}.parquet"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(at(name))
    rows = [(i, datetime(2024, 1, 1), user, "view", 1.0, "") for i, user in enumerate([1] * 17 + [2] * 3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(at("events"))
    got = {r.id: (r.verified_score, r.verified) for r in catalog.queries()["K16_verified_scores"](spark, f"file://{tmp_path}").collect()}
    assert got == {"mth:1": (0.85, True), "mth:2": (0.15, False)}
