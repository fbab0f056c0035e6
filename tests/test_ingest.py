import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalize, publish
from tidemark.schemas import KEYS, SCHEMAS, business_columns
from tidemark.sources import catalog, envelopes, requests
from tidemark.sources.store import Store
from tidemark.streaming import jobs, state

RAW = "path string, row_index int, operation string, query map<string,string>, row map<string,string>, source string, received_at timestamp, payload_sha256 string"
DAILY = {"date": "2024-01-03", "code": "sh.600000", "open": "10", "high": "11", "low": "9.5", "close": "10.1234565", "preclose": "", "volume": "100", "amount": "1000", "adjustflag": "3", "turn": "", "tradestatus": "1", "pctChg": "", "isST": "0"}


def raw(spark, operation, query, *rows):
    return spark.createDataFrame([("p", i, operation, query, r, "s", datetime(2024, 2, 1), "h") for i, r in enumerate(rows)], RAW)


def test_daily_rows(spark):
    suspended = DAILY | {"tradestatus": "0", "volume": "", "open": "", "high": "", "low": "", "close": ""}
    rows = raw(spark, "daily_bars", {"code": "sh.600000", "adjustflag": "2"}, DAILY, suspended, DAILY | {"volume": ""}, DAILY | {"high": "9"}, DAILY | {"code": "sh.600001"}, DAILY | {"close": "x"})
    good, refused = normalize.split(normalize.normalize(rows, "daily_bars"), "daily_bars")
    got = good.collect()
    assert [f.name for f in good.schema] == SCHEMAS["daily_bars"].names and len(got) == 2
    assert str(got[0].close) == "10.123456" and got[0].adjustment_flag == "2" and got[1].volume == 0 and got[0].available_at == datetime(2024, 1, 3, 7)
    reasons = {r.row_index: list(r.errors) for r in refused.collect()}
    assert reasons[2] == ["volume: blank on a trading day"] and reasons[3] == ["ohlc: inconsistent"] and reasons[4] == ["code: not the one asked for"] and "close: not a decimal" in reasons[5]


def test_other_operations(spark):
    of = lambda op, q, r, d: normalize.split(normalize.normalize(raw(spark, op, q, r), d), d)
    member = {"updateDate": "2024-01-01", "code": "sh.600000", "code_name": "n"}
    assert of("hs300_stocks", {"date": "2024-01-02"}, member, "index_memberships")[0].first().index_code == "sh.000300"
    assert of("hs300_stocks", {"date": "2023-01-02"}, member, "index_memberships")[1].count() == 1
    assert of("trade_calendar", {"start_date": "2024-01-01", "end_date": "2024-01-31"}, {"calendar_date": "2024-01-05", "is_trading_day": "1"}, "trade_calendar")[0].first().available_at == datetime(2024, 1, 4, 16)
    bar = {"date": "2024-01-03", "time": "20240103093500000", "code": "sh.600000", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "5", "amount": "5", "adjustflag": "3"}
    assert of("five_minute_bars", {}, bar, "five_minute_bars")[0].first().timestamp == datetime(2024, 1, 3, 1, 35)
    paid = {"code": "sh.600000", "dividPlanAnnounceDate": "2024-05-01", "dividOperateDate": "2024-06-01", "dividCashPsBeforeTax": "", "dividStocksPs": "0.1"}
    one = of("dividends", {}, paid, "corporate_actions")[0].first()
    assert one.available_at == datetime(2024, 5, 1, 16) and float(one.cash_before_tax_per_share) == 0 and len(one.action_id) == 64
    assert of("dividends", {}, paid | {"dividPlanAnnounceDate": "2024-07-01"}, "corporate_actions")[1].count() == 1
    assert of("instruments", {}, {"code": "sh.600000", "code_name": "n", "ipoDate": "2000-01-01", "outDate": "", "type": "1", "status": "1"}, "instruments")[0].first().out_date is None
    assert of("historical_universe", {"day": "2024-01-02"}, {"code": "sh.600000", "code_name": "n", "tradeStatus": "1"}, "historical_universe")[0].count() == 1
    factor = {"code": "sh.600000", "dividOperateDate": "2024-01-02", "foreAdjustFactor": "1", "backAdjustFactor": "1", "adjustFactor": "1"}
    assert of("adjustment_factors", {}, factor, "adjustment_factors")[0].count() == 1
    assert normalize.unknown_operations(raw(spark, "other", {}, {})).count() == 1


def envelope(root, operation="daily_bars", rows=({"a": "1"},), break_hash=False, received="2024-01-01T00:00:00Z"):
    content = {"schema_version": 2, "source": "src", "operation": operation, "query": {"k": "v"}, "fields": ["a"], "rows": list(rows)}
    sha = hashlib.sha256(envelopes.canonical(content)).hexdigest()
    body = content | {"content_sha256": sha, "received_at": received}
    whole = body | {"envelope_sha256": hashlib.sha256(envelopes.canonical(body)).hexdigest()}
    if break_hash:
        whole["rows"] = [{"a": "2"}]
    folder = root / "src" / operation
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{sha}-{received[:10]}.json").write_bytes(envelopes.canonical(whole))


def test_envelopes(spark, tmp_path):
    envelope(tmp_path)
    envelope(tmp_path, rows=({"a": "5"},), received="2024-01-02T00:00:00Z")
    envelope(tmp_path, rows=({"a": "7"},), break_hash=True)
    (tmp_path / "src" / "daily_bars" / "x.json").write_text("{")
    verified = envelopes.verify(envelopes.files(spark, str(tmp_path)))
    assert {r.reason: r.files for r in envelopes.audit(verified).collect()} == {"valid": 2, "content hash": 1, "not JSON": 1}
    assert envelopes.raw_rows(verified).count() == 2 and envelopes.latest_payload(verified).first().received_at == datetime(2024, 1, 2)


def test_publish_twice_is_a_no_op(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "a", 1, 10), ("p1", "a", 2, 20), ("p2", "b", 2, 20), ("p2", "b", 3, 30), ("p3", "c", 3, 31)], "source_payload_sha256 string, raw_artifact string, k int, v int")
    stored = rows.limit(0)
    verdicts = publish.payload_verdicts(rows, stored, ["k"], ["v"])
    assert {r[0]: r[1] for r in verdicts.collect()} == {"p1": "accepted", "p2": "accepted", "p3": "conflict"}
    new = publish.new_rows(rows, verdicts, stored, ["k"])
    assert sorted((r.k, r.source_payload_sha256) for r in new.collect()) == [(1, "p1"), (2, "p1"), (3, "p2")]
    publish.publish_segments({"t": new}, f"{tmp_path}/root", {"t": ["k"]})
    held = Store(spark, f"{tmp_path}/root", {"t": ["k"]}).read("t", new.schema)
    assert held.count() == 3
    again = publish.payload_verdicts(rows.filter("raw_artifact <> 'c'"), held, ["k"], ["v"])
    assert {r[1] for r in again.collect()} <= {"seen", "accepted"} and publish.new_rows(rows.filter("raw_artifact <> 'c'"), again, held, ["k"]).count() == 0
    path = publish.write_report(spark.range(1).withColumn("n", F.lit(1)), f"{tmp_path}/reports")
    assert publish.write_report(spark.range(1).withColumn("n", F.lit(1)), f"{tmp_path}/reports") == path and json.loads(spark.read.text(path).first().value) == {"id": 0, "n": 1}


def test_catalog(spark, tmp_path):
    rows = [(date(2024, 1, 2), True) + (datetime(2024, 1, 1), "s", datetime(2024, 1, 1), "h", "r")]
    spark.createDataFrame(rows, SCHEMAS["trade_calendar"]).write.parquet(f"{tmp_path}/trade_calendar")
    assert catalog.read(spark, str(tmp_path), "trade_calendar").count() == 1
    spark.createDataFrame(rows, SCHEMAS["trade_calendar"]).write.mode("append").parquet(f"{tmp_path}/trade_calendar")
    with pytest.raises(catalog.ContractError):
        catalog.read(spark, str(tmp_path), "trade_calendar")
    assert catalog.scan(catalog.load(spark, str(tmp_path), "trade_calendar"), as_of=datetime(2023, 1, 1)).count() == 0
    spark.range(1).write.parquet(f"{tmp_path}/instruments")
    with pytest.raises(catalog.ContractError):
        catalog.load(spark, str(tmp_path), "instruments")
    with pytest.raises(catalog.ContractError):
        catalog.bar_series(spark.range(1), [], date(2024, 1, 1), date(2024, 1, 3), datetime(2024, 1, 2))
    assert business_columns("instruments")[0] == "code" and KEYS["daily_bars"] == ["trade_date", "code", "adjustment_flag"]


def test_request_ids_ignore_key_order(spark):
    df = spark.sql("SELECT 'x' AS o, map('a', '1', 'b', '2') AS q UNION ALL SELECT 'x', map('b', '2', 'a', '1')")
    assert df.select(requests.request_id(F.col("o"), F.col("q")).alias("i")).distinct().count() == 1


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    from tidemark.operators import ops

    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), "event_id", F.when(F.col("event_type").isin("error", "purchase"), "open").otherwise("resolved").alias("phase"), F.col("ts").cast("timestamp").alias("at"))
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = state.alert_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    batch = ops.transitions(events, "key", "phase", ["at", "event_id"], "resolved")
    assert {r.event_id for r in spark.table("alerts").collect()} == {r.event_id for r in batch.collect()}
    seen = []
    jobs.ingest_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), lambda df, n: seen.append(df.count()), f"{tmp_path}/ck2").awaitTermination()
    assert sum(seen) == events.count()
    late = jobs.late_row_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in").withColumn("seen", F.col("at") + F.expr("INTERVAL 1 HOUR")), ["event_id"], "at", "seen")
    late.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck3").trigger(availableNow=True).start().awaitTermination()
    assert all(r.late <= r.rows for r in spark.table("late").collect())


def test_payload_conflicts_are_settled_in_order(spark, monkeypatch):
    # b disagrees with a and goes; so c, which disagrees with b alone, stays; d disagrees with c and goes; e agrees with a
    rows = [("a", 1, 10), ("b", 1, 11), ("b", 2, 20), ("c", 2, 21), ("c", 3, 30), ("d", 3, 31), ("e", 1, 10), ("f", 9, 90), ("g", 9, None), ("h", 8, 1), ("h", 8, 1)]
    df = spark.createDataFrame([(p, p, k, v) for p, k, v in rows], "source_payload_sha256 string, raw_artifact string, k int, v int")
    verdicts = {r[0]: r.verdict for r in publish.payload_verdicts(df, df.limit(0), ["k"], ["v"]).collect()}
    assert verdicts == {"a": "accepted", "b": "conflict", "c": "accepted", "d": "conflict", "e": "accepted", "f": "accepted", "g": "conflict", "h": "repeated_key"}


def test_segments_are_published_within_bounds(spark, tmp_path):
    df = spark.range(25).withColumn("text", F.lit("x"))
    publish.publish_segments({"t": df, "u": df.limit(3)}, f"{tmp_path}/root", {"t": ["id"], "u": ["id"]}, most_rows=10)
    publish.publish_segments({"t": df}, f"{tmp_path}/root", {"t": ["id"]})
    store = Store(spark, f"{tmp_path}/root", {"t": ["id"]})
    assert store.read("t", df.schema).count() == 50 and store.read("u", df.schema).count() == 3 and store.version().number == 2


def test_conflicts_go_to_quarantine_once(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    merged = publish.strict_merge(stored, incoming, ["k"], ["v"])
    for batch in (1, 1, 2):
        assert [r.k for r in publish.quarantine(merged, f"{tmp_path}/q", batch).collect()] == [2]
    assert sorted((r.batch, r.k) for r in spark.read.parquet(f"{tmp_path}/q").collect()) == [(1, 1), (2, 1)]


def test_raw_files_become_a_data_set(spark, tmp_path):
    def put(days, received, broken=False):
        content = {"schema_version": 2, "source": "src", "operation": "trade_calendar", "query": {"start_date": "2024-01-01", "end_date": "2024-01-31"}, "fields": ["calendar_date", "is_trading_day"], "rows": [{"calendar_date": d, "is_trading_day": t} for d, t in days]}
        sha = hashlib.sha256(envelopes.canonical(content)).hexdigest()
        body = content | {"content_sha256": sha, "received_at": received}
        whole = body | {"envelope_sha256": hashlib.sha256(envelopes.canonical(body)).hexdigest()}
        if broken:
            whole["rows"] = []
        folder = tmp_path / "raw" / "src" / "trade_calendar"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{sha}-{received[:10]}.json").write_bytes(envelopes.canonical(whole))

    store = jobs.raw_store(spark, f"{tmp_path}/root", "trade_calendar")

    def run():
        jobs.ingest_raw(spark, f"{tmp_path}/raw", f"{tmp_path}/root", "trade_calendar", f"{tmp_path}/ck").awaitTermination()
        return {(str(r.calendar_date), r.is_trading_day) for r in store.read("trade_calendar", SCHEMAS["trade_calendar"]).collect()}

    def refused():
        return sorted(list(r.reasons)[0].split(":")[-1].strip() for r in store.read("refused", "path string, source_payload_sha256 string, reasons array<string>").collect())

    put([("2024-01-02", "1"), ("2024-01-06", "0")], "2024-02-01T00:00:00Z")
    put([("2024-01-07", "0"), ("2024-01-08", "x")], "2024-02-01T01:00:00Z")  # one bad row
    put([("2024-01-09", "1")], "2024-02-01T00:00:00Z", broken=True)
    assert run() == {("2024-01-02", True), ("2024-01-06", False)}
    assert len(refused()) == 2 and "content hash" in refused()
    put([("2024-01-02", "1"), ("2024-01-03", "1")], "2024-02-02T00:00:00Z")  # agrees and adds
    put([("2024-01-06", "1"), ("2024-01-04", "1")], "2024-02-03T00:00:00Z")  # disagrees and is refused as a whole
    assert run() == run() == {("2024-01-02", True), ("2024-01-06", False), ("2024-01-03", True)}
    assert len(refused()) == 3 and "conflict" in refused()
    # a stream that begins anew finds all payloads known
    version = store.version().number
    jobs.ingest_raw(spark, f"{tmp_path}/raw", f"{tmp_path}/root", "trade_calendar", f"{tmp_path}/ck2").awaitTermination()
    assert store.read("trade_calendar", SCHEMAS["trade_calendar"]).count() == 3 and store.version().number == version + 1


def test_checks_are_recorded_or_refused(spark, tmp_path):
    from tidemark.operators import ops

    rows = [("a", "healthy", True, datetime(2024, 1, 1), 5), ("a", "degraded", True, datetime(2024, 1, 2), 7), ("b", "well", False, datetime(2024, 1, 1), 1), ("", "healthy", False, datetime(2024, 1, 1), 1), ("c", "healthy", False, datetime(2024, 1, 1), -1)]
    df = spark.createDataFrame(rows, "provider string, state string, critical boolean, checked_at timestamp, latency_ms int")
    assert sorted(r.reason for r in ops.record_health(df, f"{tmp_path}/health").collect()) == ["latency", "provider", "state"]
    latest = ops.latest_per_key(spark.read.parquet(f"{tmp_path}/health"), ["provider"], ["checked_at"])
    assert [(r.provider, r.state) for r in latest.collect()] == [("a", "degraded")]


def test_bars_of_one_adjustment(spark):
    at = datetime(2024, 1, 3, 8)
    rows = [("sh.600000", date(2024, 1, 3), f, datetime(2024, 1, 3, 1, m), at) for f in "23" for m in (40, 35)] + [("sh.600001", date(2024, 1, 3), "3", at, at), ("sh.600000", date(2024, 1, 2), "3", at, datetime(2024, 2, 1))]
    bars = spark.createDataFrame(rows, "code string, trade_date date, adjustment_flag string, timestamp timestamp, available_at timestamp")
    span = (["sh.600000"], date(2024, 1, 1), date(2024, 1, 3), datetime(2024, 1, 4))
    assert [r.timestamp.minute for r in catalog.five_minute_bars(bars, *span).collect()] == [35, 40]
    assert catalog.daily_bars(bars, *span, flag="2").count() == 2 and catalog.rows_as_of(bars, at).count() == 5
