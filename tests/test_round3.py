"""Cases of the third round of findings."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import runs, tokens
from textloom.plans import registry
from textloom.sources import sinks


def test_summary_cells_end_where_the_sql_ends_them(spark, tmp_path):
    import duckdb

    spark.range(1, 9).selectExpr("149990 + id AS o_orderkey", "id AS o_custkey", "concat(1 + id % 4, '-A LONG PRIORITY NAME') AS o_orderpriority", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2).selectExpr("id AS c_custkey", "'M' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.queries()["report_summary"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(registry.oracle_sql()["report_summary"]).fetchall())
    metrics = spark.range(1).select(F.lit("base").alias("stage"), F.lit("CORE").alias("key"), F.lit("float").alias("kind"), F.lit(9374.8125).alias("number"), F.lit(None).cast("string").alias("text"))
    assert "9374.8125" in sinks.summary_table(metrics).first()["line"]


def test_merges_apart_part_chunks_at_rare_pairs(spark, monkeypatch):
    """Few rounds in Spark, then the driver; the same merges, also if the bound on counts
    has to be lowered to find them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = tokens.chunk_counts(docs).cache()
    counts = [(r["chunk"].encode(), r["n"]) for r in table.collect()]
    kept = []
    monkeypatch.setattr(tokens, "cut", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    assert tokens.train(docs, 60, driver_chunks=len(counts) // 2) == tokens.learn_merges(counts, 60)
    assert len(kept) < 16 and kept[-1].count() <= len(counts) // 2
    rare = spark.createDataFrame([("abababab", 9), ("xy", 5), ("xz", 4), ("aaaaab", 2)], "chunk string, n long")
    few = [(r["chunk"].encode(), r["n"]) for r in rare.collect()]
    for n in (1, 2, 5, 9):
        for held in (0, 1, 9):
            assert tokens.learn_merges_apart(rare, n, driver_chunks=held) == tokens.learn_merges(few, n)


def test_lookup_ships_no_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1, 2, 9]), (2, []), (3, None), (4, [7]), (1, [2])], "doc_id long, ids array<int>")
    vocab = spark.createDataFrame([(0, "a"), (1, 'b"\n'), (2, "é")], "token_id int, token string")
    found = tokens.lookup(rows, vocab)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, ["a", 'b"\n', "é"]), (1, ["é"])]
    for more in ([(0, "z")], [(70_000, "far")], [(-1, "below")], [(None, "none")]):
        joined = tokens.lookup(rows.limit(4), vocab.unionByName(spark.createDataFrame(more, "token_id int, token string"))).collect()
        assert [r["doc_id"] for r in joined] == [1] and set(joined[0]["tokens"]) - {"z"} == {"a", 'b"\n', "é"}


def test_byte_ids_and_common_length_read_each_place_once(spark):
    texts = spark.createDataFrame([("a\x00é🌍\n\x7f\x80",), ("",), (None,)], "t string")
    ids = T.byte_ids(F.col("t"))
    assert [r["b"] for r in texts.select(ids.alias("b")).collect()] == [list("a\x00é🌍\n\x7f\x80".encode()), [], None]
    assert "regexp" not in str(ids._jc) and "conv" not in str(ids._jc)
    rows = spark.createDataFrame([([[1, 2, 3], [1, 2], [1, 2, 4]],), ([[], [1]],), ([[2, 1], [3, 1], [1]],), ([[1, 2]],), ([[1], [1]],)], "t array<array<int>>")
    found = rows.select(T.common_length(F.col("t")).alias("p"), T.common_length(F.col("t"), suffix=True).alias("s")).collect()
    assert [tuple(r) for r in found] == [(2, 0), (0, 0), (0, 1), (2, 2), (1, 1)]
    long = list(range(3000))
    rows = spark.createDataFrame([([long, [-1, *long]],)], "t array<array<int>>")
    assert rows.select(T.common_length(F.col("t"), suffix=True)).first()[0] == 3000


def test_moving_average_keeps_no_arrays(spark):
    """A run of several blocks with wide values, and no array of its steps in the plan."""
    log = spark.range(9000).selectExpr("id AS step", "id % 2 AS run", "CASE WHEN id < 5000 THEN 1e6 ELSE id % 7 END AS x")
    for beta in (0.9, 0.3, 0.9999):
        got = runs.ema(log, "x", beta, by=("run",))
        acc, want = [0.0, 0.0], {}
        for i in range(9000):
            acc[i % 2] = beta * acc[i % 2] + (1 - beta) * (1e6 if i < 5000 else i % 7)
            want[i] = acc[i % 2] / (1 - beta ** (i // 2 + 1))
        assert all(abs(r["ema"] - want[r["step"]]) <= 1e-9 * max(1, want[r["step"]]) for r in got.collect())
    assert "array_append" not in got._jdf.queryExecution().optimizedPlan().toString()
