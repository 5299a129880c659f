"""Lines that share order and number: every layer takes the first one in the table, however it is split."""

import duckdb

from glimmerline.catalog import stored


def test_first_line_counts_in_every_layer(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE o AS SELECT k AS o_orderkey, k % 50 AS o_custkey, 'O' AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, 'LOW' AS o_orderpriority FROM range(2000) t(k)")
    con.execute(
        "CREATE TABLE l AS SELECT k * 7919 % 2003 AS l_orderkey, k AS l_partkey, k AS l_suppkey, (k * 31 % 3 + 1)::INT AS l_linenumber, 1.0 AS l_quantity, 'N' AS l_returnflag FROM range(40000) t(k)"
    )
    con.execute(f"COPY o TO '{tmp_path}/orders.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for part, where in enumerate(("l_partkey < 8000", "l_partkey >= 8000")):  # Spark reads the larger file first
        con.execute(f"COPY (FROM l WHERE {where}) TO '{tmp_path}/lineitem.parquet/part-{part}.parquet' (ROW_GROUP_SIZE 2048)")
    want = dict(con.execute("SELECT l_orderkey || '_' || l_linenumber, min(l_suppkey) FROM l WHERE l_orderkey < 2000 GROUP BY 1").fetchall())
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, "20000")
    try:
        x = stored.star_layers(spark, str(tmp_path))
        subjects = {r.event_id[4:]: int(r.subject[1:]) for r in x["events"].select("event_id", "subject").collect()}
        titles = {r.document_id[4:]: int(r.title[5:]) for r in x["documents"].select("document_id", "title").collect()}
    finally:
        spark.conf.set(split, before)
    assert subjects == want
    assert titles == {k: v for k, v in want.items() if not k.endswith("_2")}
