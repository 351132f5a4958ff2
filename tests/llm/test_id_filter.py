"""The id filter lets everything of the set through and loses no row of either side."""

from cartoframe.llm import id_filter


def test_split_is_a_partition(spark):
    rows = spark.range(2000).selectExpr("id * 7 as x", "cast(id as string) as t").union(spark.createDataFrame([(None, "n")], "x long, t string")).repartition(5)
    ids = spark.createDataFrame([(i * 7,) for i in range(0, 2000, 9)] + [(None,), (-5,)], "x long")
    maybe, kept = id_filter.split(rows, "x", id_filter.build(ids))
    a, b = [r.x for r in maybe.collect()], [r.x for r in kept.collect()]
    assert len(a) + len(b) == 2001 and None in b and {i * 7 for i in range(0, 2000, 9)} <= set(a) and len(a) < 300
    maybe, kept = id_filter.split(rows, "x", id_filter.build(ids.limit(0)))
    assert maybe.count() == 0 and kept.count() == 2001
