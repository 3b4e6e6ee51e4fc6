from larkspur.queries import records

DATA = "/root/testdata/sf0.001"


def test_every_killer_uid_has_a_row(spark):
    kills = spark.read.parquet(f"{DATA}/kill_events.parquet").distinct().filter("killer_uid IS NOT NULL")
    want = {r.killer_uid: r["count"] for r in kills.groupBy("killer_uid").count().collect()}
    wide = records.p1_features(spark, DATA)
    assert 0 in want and "n__all" in wide.columns
    assert {r.killer_uid: r.n__all for r in wide.select("killer_uid", "n__all").collect()} == want
    assert records.p1_type_totals(spark, DATA).filter("killer_uid = 0").count() == 0
