"""CSV round trip, missing tables, append/overwrite, report sink."""

from pyspark.sql import functions as F

from signals.session import scratch_path
from signals.sources import adapters as ad
from signals.sources import tables as tbl

SF_SMALL = "/root/testdata/sf0.001"


def test_csv_round_trip_and_missing_table(spark):
    m = ad.signal_model(spark, SF_SMALL)
    path = scratch_path(spark, "t-csv")
    tbl.write_csv_tables({k: v for k, v in m.items() if k != "usage_signals"}, path)
    back = tbl.read_csv_tables(spark, path)
    assert back["usage_signals"].count() == 0  # missing file → empty table with schema
    assert "trial_sessions" in back["usage_signals"].columns
    t = m["text_feedback"]
    assert t.exceptAll(back["text_feedback"].select(*t.columns)).count() == 0
    d = m["demo_signals"].withColumn("follow_up_requested", F.col("follow_up_requested").cast("int")) \
        .withColumn("decision_maker_present", F.col("decision_maker_present").cast("int"))
    b = back["demo_signals"].select(*d.columns)
    assert d.exceptAll(b).count() == 0 and b.exceptAll(d).count() == 0


def test_append_skips_empty_and_reset(spark):
    u = ad.signal_model(spark, SF_SMALL)["usage_signals"]
    n = u.count()
    path = scratch_path(spark, "t-append")
    assert tbl.append_table(u, path)
    assert not tbl.append_table(u.limit(0), path)
    tbl.write_table(u, path, reset=False)
    assert spark.read.parquet(path).count() == 2 * n
    tbl.write_table(u, path, reset=True)
    assert spark.read.parquet(path).count() == n


def test_incremental_load_takes_each_file_once(spark):
    from signals.streaming.ingest import incremental_load
    d = ad.signal_model(spark, SF_SMALL)["demo_signals"]
    d = d.select(*[F.col(c).cast("int").alias(c) if c in ("follow_up_requested", "decision_maker_present")
                   else F.col(c) for c in d.columns])
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    d.where(F.col("customer_id") % 2 == 0).write.options(**tbl.CSV_OPTIONS).csv(f"{landing}/a")
    incremental_load(spark, f"{landing}/*", "demo_signals", d.schema, sink, checkpoint=ckpt)
    n1 = spark.read.parquet(sink).count()
    incremental_load(spark, f"{landing}/*", "demo_signals", d.schema, sink, checkpoint=ckpt)  # nothing new
    assert spark.read.parquet(sink).count() == n1
    d.where(F.col("customer_id") % 2 == 1).write.options(**tbl.CSV_OPTIONS).csv(f"{landing}/b")
    incremental_load(spark, f"{landing}/*", "demo_signals", d.schema, sink, checkpoint=ckpt)
    back = spark.read.parquet(sink)
    assert back.count() == d.count()
    assert dict(back.dtypes)["follow_up_requested"] == "boolean"


def test_incremental_loads_do_not_overwrite_each_other(spark):
    from signals.streaming.ingest import incremental_load
    d = spark.createDataFrame([(i, float(i)) for i in range(6)], "concept_id bigint, feedback_score double")
    one, two, sink, other = (scratch_path(spark, n) for n in ("t-one", "t-two", "t-sink", "t-other"))
    d.where("concept_id < 2").write.options(**tbl.CSV_OPTIONS).csv(f"{one}/a")
    d.where("concept_id >= 2").write.options(**tbl.CSV_OPTIONS).csv(f"{two}/a")
    for landing in (one, two):  # two landing folders, fresh checkpoints, one sink
        incremental_load(spark, f"{landing}/*", "demo_signals", d.schema, sink, checkpoint=scratch_path(spark, "t-ckpt"))
    assert sorted(r[0] for r in spark.read.parquet(sink).select("concept_id").collect()) == list(range(6))
    incremental_load(spark, f"{one}/*", "demo_signals", d.schema, sink + "-1")  # default checkpoints: one landing, two sinks
    incremental_load(spark, f"{one}/*", "demo_signals", d.schema, other)
    assert spark.read.parquet(sink + "-1").count() == spark.read.parquet(other).count() == 2


def test_csv_with_text_ids_and_bad_values(spark, tmp_path):
    (tmp_path / "concepts.csv").write_text(
        "concept_id,concept_name,industry,problem_area,target_user,delivery_complexity,strategic_fit\n"
        'C001,"Name, with comma",Retail,Costs,Buyers,0.4,0.9\nC002,Other,Retail,Costs,,oops,0.1\n')
    (tmp_path / "demo_signals.csv").write_text(
        "demo_id,concept_id,customer_id,segment,demo_date,feedback_score,follow_up_requested,decision_maker_present,objections_count\n"
        "D1,C001,CUST0023,A,2024-01-02,7.5,1,0,2\nD2,C002,CUST0001,B,not a date,x,0,1,3\n")
    (tmp_path / "usage_signals.csv").write_text("no such header\n\x00\x01,,,\n")
    t = tbl.read_csv_tables(spark, str(tmp_path), text_ids=True)
    assert [r["concept_id"] for r in t["concepts"].orderBy("concept_id").collect()] == ["C001", "C002"]
    assert t["concepts"].where("concept_id = 'C001'").first()["concept_name"] == "Name, with comma"
    d = {r["demo_id"]: r for r in t["demo_signals"].collect()}
    assert d["D1"]["follow_up_requested"] == 1 and d["D2"]["demo_date"] is None and d["D2"]["feedback_score"] is None
    assert t["usage_signals"].count() >= 0 and t["commercial_signals"].count() == 0
    bad = {(r[0], r[1]): r[2] for r in tbl.csv_rejects(spark, str(tmp_path), text_ids=True).where("n_rejected > 0").collect()}
    assert bad == {("concepts", "delivery_complexity"): 1, ("demo_signals", "demo_date"): 1, ("demo_signals", "feedback_score"): 1}
    assert tbl.csv_rejects(spark, str(tmp_path)).where("column_name = 'concept_id' AND n_rejected = 2").count() == 2
    from signals.operators import features as feat
    f = feat.feature_table(t["concepts"], t["demo_signals"], t["usage_signals"], t["commercial_signals"]).collect()
    assert sorted(r["concept_id"] for r in f if r["concept_id"]) == ["C001", "C002"]


def test_row_differences_count_repeats_and_nulls(spark):
    from signals.operators import quality as qual
    schema = "a long, b string"
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "y")], schema)
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (2, None), (4, "z")], schema)
    assert tuple(qual.row_differences(a, b).select("n_rows", "n_missing", "n_extra").first()) == (5, 2, 2)
    assert tuple(qual.row_differences(a.limit(0), b.limit(0)).first()) == (0, 0, 0)


def _readings(spark, tmp_path, use):
    """How often the rows behind a frame are made while ``use`` works on it, and what it returns."""
    from pyspark.sql import functions as F
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i % 3, i, None if i % 4 == 0 else float(i), None if i % 5 == 0 else "s") for i in range(60)],
                                 "concept_id long, customer_id long, x double, segment string")
    out = use(rows.mapInArrow(count, rows.schema))
    return made.value / 60, out


def test_cleaning_makes_its_rows_twice(spark, tmp_path):
    """One pass for the profile and one that stores the rows; medians, modes and readers of the result use the stored rows."""
    from signals.operators import clean as cln
    times, rows = _readings(spark, tmp_path, lambda df: [cln.impute(df).collect() for _ in range(1)][0])
    assert times == 2 and len(rows) == 60 and all(r["x"] is not None and r["segment"] == "s" for r in rows)


def test_a_batch_makes_its_rows_once(spark, tmp_path, monkeypatch):
    from signals.operators import incremental as inc
    from signals.session import scratch_path
    monkeypatch.setattr(inc, "PARTS", {"demo_signals": ("demo", {"mean_x": "x"}, {"x_var": "x"}, {}, {})})
    path = scratch_path(spark, "t-once")
    times, _ = _readings(spark, tmp_path, lambda df: inc.save_batch(path, "b", {"demo_signals": df}))
    assert times == 1 and spark.read.parquet(f"{path}/segments").count() > 0
    assert spark.read.parquet(f"{path}/demo_signals/customers").count() == 60
