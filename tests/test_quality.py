from pyspark.sql import functions as F

from townrisk.operators.quality import byte_batches, infer_types, pk_violations, sql_literal_row


def test_infer_types(spark):
    rows = [(None, "1", "1.5", "True", "nan", "abc", "007"),
            (None, "2", "2", "False", "1", "x", "010")]
    df = spark.createDataFrame(rows, "empty string, i string, r string, b string, n string, t string, code string")
    got = {r.column: r.type for r in infer_types(df, force_text=["code"]).collect()}
    assert got == {"empty": "INTEGER", "i": "INTEGER", "r": "REAL", "b": "TEXT", "n": "REAL",
                   "t": "TEXT", "code": "TEXT"}


def test_pk_violations(spark):
    df = spark.createDataFrame([(1, 2025), (1, 2025), (2, 2025)], "key long, data_year int")
    assert [(r.key, r.n) for r in pk_violations(df, ["key", "data_year"]).collect()] == [(1, 2)]


def test_byte_batches_invariants(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.repeat(F.lit("あ"), (F.col("id") % 50).cast("int")).alias("t"))
    rows = sql_literal_row(df, text_cols=["t"]).withColumn("key", F.col("row_text"))
    total = rows.agg(F.sum("n_bytes")).collect()[0][0]
    b = byte_batches(rows, "key", 5000, 3).collect()
    assert sum(r.n_rows for r in b) == 2000
    assert sum(r.n_bytes for r in b) == total
    assert all(r.n_bytes <= 5000 or r.n_rows == 1 for r in b)
    big = spark.createDataFrame([("x" * 9000,)], "t string")
    one = byte_batches(sql_literal_row(big, ["t"]).withColumn("key", F.col("row_text")), "key", 5000, 1).collect()
    assert [(r.n_rows) for r in one] == [1]
