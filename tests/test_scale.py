"""Steps that must not grow with the data in one process."""

import datetime

from echoloom.operators import usage as U


def _calls(spark):
    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(k, f"t{k % 3}", "analyze", f"c{k // 2}", t, k, 2 * k, 3 * k, "ok" if k % 7 else "error") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, tenant_id string, operation string, call_id string, ts timestamp, call_duration_ms long, input_tokens long, output_tokens long, status string")
    return df.selectExpr("*", "cast(0.5 as decimal(12,6)) AS cost_usd")


def test_value_counts_are_not_broadcast(spark):
    for make in (U.two_views, U.fan_out):
        df = make(_calls(spark))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 8  # three tenants, one operation, four groupings


def test_texts_of_records_are_dealt_once_by_id(spark, tmp_path):
    """The dates of the records view and what is joined by id meet the texts in one shuffle of theirs."""
    from echoloom import views

    spark.createDataFrame([(k, f"text {k}", "en", "src1") for k in (1, 2, 3, 3)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ts = datetime.datetime(2024, 1, 2, 12)
    spark.createDataFrame([(10, ts), (10, ts), (11, ts), (30, ts)], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = views.view(spark, str(tmp_path), "records")
        got = r.join(spark.createDataFrame([("doc-1", 5)], "id string, x int"), "id", "left")
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted((x.id, x.created) for x in r.collect()) == [("doc-1", "2024-01-02")] * 2 + [("doc-2", ""), ("doc-3", "2024-01-02"), ("doc-3", "2024-01-02")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_restore_by_id(spark):
    from echoloom.operators import pii as P

    df = spark.createDataFrame([("a", "c", "x <P_1> y"), ("a", "c", "<P_2><P_1>"), ("b", "c", None), ("d", "e", "<P_1> <Q_7>"), (None, "c", "<P_1>")], "id string, corpus_id string, content string")
    m = spark.createDataFrame([("c", "<P_1>", "P", "one"), ("c", "<P_2>", "P", "two"), ("e", "<P_1>", "P", "eins")], "corpus_id string, placeholder string, type string, value string")
    got = P.restore(df, m, "corpus_id", "content", id_col="id").collect()
    assert sorted(((r.id or "-", r.content or "-") for r in got)) == [("-", "<P_1>"), ("a", "twoone"), ("a", "x one y"), ("b", "-"), ("d", "eins <Q_7>")]


def test_volumes_are_not_made_in_one_task(spark):
    from echoloom.operators import corpus as B

    leaves = spark.range(300).selectExpr("cast(id as string) AS code")
    plan = B.allocate_volumes(leaves, 9000, 3)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "code#" in x]


def test_rounding_of_halves(spark):
    from echoloom.plans import chunks

    got = spark.createDataFrame([(41 / 640,), (-41 / 640,), (0.0640624,)], "x double").select(chunks._six("x")).collect()
    assert [r.x for r in got] == [0.064063, -0.064063, 0.064062]
    assert "DECIMAL(18,15)" in chunks.SQL["e8_hashed"]
