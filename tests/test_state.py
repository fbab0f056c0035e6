import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission, ops
from tidemark.streaming import state

D = lambda day, month=1: dt.date(2024, month, day)
EVENT = "key string, fill_id string, track string, code string, side string, quantity long, price double, fees double, intent_id long, occurred_on date, seq long"
INTENTS = [(1, 100, D(1), D(31)), (2, 50, D(5), D(20)), (3, 1000, D(1), D(31))]


def gates(spark, rows, skips=(), cash=(("base", 1e6), ("actual", 1e6))):
    """rows: key, track, side, quantity, intent, day and maybe price; fill ids and seq follow from their place."""
    full = [(r[0], f"f{i}", r[1], "c", r[2], r[3], r[6] if len(r) > 6 else 1.0, 0.0, r[4], r[5], i) for i, r in enumerate(rows)]
    intents = spark.createDataFrame(INTENTS, "intent_id long, quantity long, created_on date, expires_on date")
    skipped = spark.createDataFrame(list(skips), "intent_id long, track string, skipped_on date")
    return spark.createDataFrame(full, EVENT), intents, skipped, spark.createDataFrame(list(cash), "track string, cash double")


def outcome(df):
    rows = sorted(df.collect(), key=lambda r: int(r.fill_id[1:]))
    return [r.verdict if r.reason is None else r.reason for r in rows]


def test_an_intent_is_filled_on_each_track(spark):
    rows = [("a", "base", "buy", 100, 1, D(2)), ("b", "actual", "buy", 100, 1, D(2)), ("c", "base", "buy", 1, 1, D(3))]
    assert outcome(admission.admitted(*gates(spark, rows))) == ["accepted", "accepted", "over_intent"]


def test_the_earliest_skip_of_the_track_counts_once(spark):
    rows = [("a", "base", "buy", 10, 1, D(2)), ("b", "base", "buy", 10, 1, D(6)), ("c", "actual", "buy", 10, 1, D(6))]
    got = admission.admitted(*gates(spark, rows, [(1, "base", D(9)), (1, "base", D(5)), (1, "other", D(1))]))
    assert outcome(got) == ["accepted", "after_skip", "accepted"]


def test_a_refused_key_may_be_tried_again(spark):
    rows = [("a", "base", "buy", 10, 2, D(1)), ("a", "base", "buy", 10, 2, D(6)), ("a", "base", "buy", 10, 2, D(6)), ("a", "base", "buy", 11, 2, D(6)), ("a", "actual", "buy", 11, 2, D(6))]
    assert outcome(admission.admitted(*gates(spark, rows))) == ["before_intent", "accepted", "replay", "conflict", "accepted"]


def test_refused_events_leave_cash_and_quantity_free(spark):
    rows = [("a", "base", "buy", 60, 1, D(2)), ("b", "base", "buy", 20, 1, D(2)), ("c", "base", "sell", 20, 1, D(2)), ("d", "base", "sell", 20, 1, D(3), 3.0), ("e", "base", "buy", 60, 1, D(3)), ("f", "base", "sell", 1, 3, D(4))]
    got = admission.admitted(*gates(spark, rows, cash=[("base", 50.0)]))
    assert outcome(got) == ["short_cash", "accepted", "t_plus_one", "accepted", "accepted", "accepted"]


def test_windows_unknown_intents_and_expired_ones(spark):
    rows = [("a", "base", "buy", 1, 9, D(2)), ("b", "base", "buy", 1, 2, D(20)), ("c", "base", "buy", 1, 2, D(21)), ("b", "base", "buy", 1, 2, D(21)), ("d", None, "buy", 1, 3, D(2))]
    assert outcome(admission.admitted(*gates(spark, rows))) == ["unknown_intent", "accepted", "after_expiry", "after_expiry", "short_cash"]
    events, *rest = gates(spark, rows)
    assert admission.admitted(events.limit(0), *rest).count() == 0


def test_many_intents_are_forgotten_once_expired(spark):
    days = [D(1) + dt.timedelta(days=k) for k in range(300)]
    intents = spark.createDataFrame([(k, 5, d, d) for k, d in enumerate(days)], "intent_id long, quantity long, created_on date, expires_on date")
    rows = [(f"k{k}", f"f{2 * k + j}", "t", "c", "buy", 3, 1.0, 0.0, k, d, j) for k, d in enumerate(days) for j in (0, 1)]
    events = spark.createDataFrame(rows, EVENT)
    none = spark.createDataFrame([], "intent_id long, track string, skipped_on date")
    got = admission.admitted(events.withColumn("key", F.col("fill_id")), intents, none, spark.createDataFrame([("t", 1e6)], "track string, cash double"), most_intents=10)
    assert outcome(got) == ["accepted", "over_intent"] * 300


def test_events_are_shuffled_once(spark):
    rows = [("a", "base", "buy", 10, 1, D(2)), ("a", "base", "buy", 10, 1, D(3))]
    shape = admission.admitted(*gates(spark, rows, [(1, "base", D(9))]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = [block for block in shape.split("\n\n") if " Exchange\n" in block]
    assert len(shuffled) > 1 and sum("fill_id" in block for block in shuffled) == 1
    assert sum("key#" in block for block in shuffled) == 1


def test_large_ids_beside_null_ones_stay_apart(spark):
    big = (1 << 53) + 1
    events, _, skips, cash = gates(spark, [("a", "base", "buy", 10, big - 1, D(2)), ("b", "base", "buy", 10, big, D(2)), ("c", "base", "buy", 1, None, D(2)), (None, "base", "buy", 1, 3, D(2)), (None, "base", "buy", 1, 3, D(2))])
    intents = spark.createDataFrame([(i, 10, D(1), D(9)) for i in (big - 1, big, 3)], "intent_id long, quantity long, created_on date, expires_on date")
    assert outcome(admission.admitted(events, intents, skips, cash)) == ["accepted", "accepted", "unknown_intent", "accepted", "replay"]


def run(stream, name, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_stream_of_events_goes_on_after_a_restart(spark, tmp_path):
    import random

    r = random.Random(4)
    keys = [f"k{i}" for i in range(60)]
    rows = [(r.choice(keys), r.choice(["base", "actual"]), r.choice(["buy", "buy", "sell"]), r.randrange(1, 30), r.choice([1, 2, 3, 3, 9]), D(1 + i // 8), r.choice([1.0, 2.5])) for i in range(200)]
    skips, cash = [(1, "base", D(9)), (1, "base", D(12))], [("base", 200.0), ("actual", 300.0)]
    events, intents, skipped, opening = gates(spark, rows, skips, cash)
    want = {x.fill_id: (x.verdict, x.reason) for x in admission.admitted(events, intents, skipped, opening).collect()}
    assert len({x for x in want.values()}) >= 8
    placed = events.withColumn("place", F.col("seq")).drop("seq")
    for part in (placed.filter("place < 96"), placed.filter("place >= 96")):  # between days; each time a new stream
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(placed.schema).parquet(f"{tmp_path}/in")
        run(state.admission_stream(source, intents, skipped, opening), "out", tmp_path)
    got = {x.fill_id: (x.verdict, x.reason) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    late = placed.limit(1).withColumn("fill_id", F.lit("late")).withColumn("key", F.lit("new")).withColumn("intent_id", F.lit(3).cast("long"))
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(state.admission_stream(spark.readStream.schema(placed.schema).parquet(f"{tmp_path}/in"), intents, skipped, opening), "out", tmp_path)
    assert [x.reason for x in spark.read.parquet(f"{tmp_path}/out").filter("fill_id = 'late'").collect()] == ["late"]


def alert_events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), "event_id", F.when(F.col("event_type").isin("error", "purchase"), "open").otherwise("resolved").alias("phase"), F.col("ts").cast("timestamp").alias("at"))


@pytest.mark.parametrize("hand_over", [False, True])
def test_alerts_equal_the_batch_after_hand_over_and_restart(spark, sf, tmp_path, hand_over):
    events = alert_events(spark, sf)
    batch = ops.transitions(events, "key", "phase", ["at", "event_id"], "resolved")
    cuts = events.selectExpr("percentile(unix_micros(at), array(0.3, 0.6))").first()[0]
    past, middle, new = (events.filter(f"unix_micros(at) > {a} AND unix_micros(at) <= {b}") for a, b in ((-1, cuts[0]), (cuts[0], cuts[1]), (cuts[1], 1 << 60)))
    known = None
    parts = [past, middle, new]
    if hand_over:
        known = past.groupBy("key").agg(F.max_by(F.struct("phase", "at", "event_id"), F.struct("at", "event_id")).alias("x")).select("key", "x.*")
        parts = [middle, new]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(state.alert_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), known=known), "out", tmp_path)
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.event_id for r in batch.collect()}
    if hand_over:
        want -= {r.event_id for r in past.collect()}
    assert got == want


def test_silent_alerts_are_closed(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    schema = "key long, event_id long, phase string, at timestamp"
    for rows in ([(1, 1, "open", at(0)), (2, 2, "open", at(0))], [(2, 3, "open", at(8)), (3, 4, "resolved", at(8))], [(2, 5, "open", at(16)), (3, 6, "resolved", at(16))], [(3, 7, "resolved", at(17)), (1, 8, "open", at(17))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run(state.alert_stream(source, silence=dt.timedelta(minutes=10)), "out", tmp_path)
    got = sorted(((r.key, r.event_id, r.phase) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert (1, 1, "open") in got and (1, None, "resolved") in got and (1, 8, "open") in got
    assert [x for x in got if x[0] == 2] == [(2, 2, "open")]  # heard of in time
