import duckdb
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import context


def test_fold_up_to_the_budget(spark):
    rows = spark.createDataFrame([([("a", "", 6), ("b", "", 4), ("c", "", 0), ("d", "", 1)],)], "s array<struct<name:string,text:string,tokens:long>>")
    below, full = (rows.select(context.fold(F.col("s"), 10, full=x).alias("f")).first().f for x in (False, True))
    assert (below.used, below.kept, below.skipped) == (7, ["a", "c", "d"], True)
    assert (full.used, full.kept, full.skipped) == (10, ["a", "b", "c"], True)


def test_turns_that_use_up_the_budget_equal_sql(spark, tmp_path):
    sizes = {1: [575, 900, 125], 2: [700], 3: [701, 699, 1], 4: [0], 5: [350, 350, 1, 0]}
    rows = [(i, k, "user", "x" * n) for i, s in sizes.items() for k, n in enumerate(s)] + [(6, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["section_budget_fold"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["section_budget_fold"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
