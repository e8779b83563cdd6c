from pyspark.sql import functions as F

from lodestone.llm.common import HOT_SHARE, attach_groups, components, words


def test_attach_groups_keeps_every_row_of_hot_and_cold_groups(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert groups.filter(f"n * {HOT_SHARE} > 6000").count() == 1
    found = attach_groups(rows, groups, ["k"], "n").collect()
    assert len(found) == 6000
    assert {r["top"] for r in found if r["k"] == -1} == {5997}
    assert all(r["top"] == r["id"] for r in found if r["k"] != -1)


def test_attach_groups_of_nothing(spark):
    rows = spark.range(0).withColumnRenamed("id", "k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert attach_groups(rows, groups, ["k"], "n").count() == 0


def test_components_of_a_long_chain_a_star_and_repeated_links(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 50)]
    links = chain + star + star + [(50, 49), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(1, 51)} == {1}
    assert len(found) == 61 + 50


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_counts_ascii_white_space_only(spark):
    texts = [("a  b\tc\n",), ("",), (None,), ("x y",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(words("t")).collect()] == [3, 0, 0, 1]
