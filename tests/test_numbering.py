import random

from pyspark.sql import functions as F

from palimpsa.operators.numbering import placed


def test_places_of_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), n, r.randrange(10**6)) for n in range(3000)]
    frame = spark.createDataFrame(rows, "g string, n int, x int").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small data would be one part
    try:
        got = placed(frame, "g", ["x", "n"]).collect()
        parts = frame.repartitionByRange("g", "x", "n").select(F.spark_partition_id().alias("p"), "g").filter("g = 'hot'").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert parts > 1 and len(got) == 3000
    for g in ("hot", "a", "b", None):
        want = [n for _, n, _ in sorted(((g2, n, x) for g2, n, x in rows if g2 == g), key=lambda t: (t[2], t[1]))]
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == want
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(want) + 1))
    assert placed(frame.limit(0), "g", ["x"]).count() == 0
