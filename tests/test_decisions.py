"""Closed forms against naive models, and rules on hand tables."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.functions.market import fees, from_exchange_code, limit_price, lot_size, to_exchange_code
from tidemark.operators import allocate, evaluation, features, ledger, overlay, quality, regime, trading


def naive_weights(inverse, gross=0.95, cap=0.20):
    left, capped = dict(inverse), {}
    while True:
        budget, total = gross - cap * len(capped), sum(left.values())
        over = [c for c, v in left.items() if budget * v / total > cap + 1e-12]
        if not over or not left:
            return {**capped, **{c: budget * v / total for c, v in left.items()}}
        for c in over:
            capped[c] = cap
            del left[c]
        if not left:
            return capped


def test_capped_weights_equal_the_loop(spark):
    r = random.Random(1)
    cases = {g: {f"c{i}": r.uniform(0.1, 10) ** 2 for i in range(r.randrange(1, 9))} for g in range(150)}
    rows = [(g, c, i + 1, v) for g, case in cases.items() for i, (c, v) in enumerate(case.items())]
    out = allocate.capped_weights(spark.createDataFrame(rows, "g long, code string, rank int, inverse_volatility double"), ["g"]).collect()
    got = {(r.g, r.code): r.weight for r in out}
    for g, case in cases.items():
        for c, w in naive_weights(case).items():
            assert abs(got[g, c] - w) < 2e-8


def test_fifo_equals_the_loop(spark):
    r = random.Random(2)
    rows, expected, matched = [], {}, {}
    for g in range(12):
        lots, day = [], date(2024, 1, 1)
        for n in range(60):
            day += timedelta(days=r.randrange(0, 2))
            held = sum(q for _, q in lots)
            if held > 5 and r.random() < 0.45:
                q = r.randrange(1, held + 1)
                rows.append((f"{g}-{n}", "t", g, "sell", q, 1.0, 0.0, day, n))
                while q:
                    take = min(q, lots[0][1])
                    matched[lots[0][0], f"{g}-{n}"] = take
                    lots[0][1] -= take
                    q -= take
                    if not lots[0][1]:
                        lots.pop(0)
            else:
                q = r.randrange(1, 50)
                rows.append((f"{g}-{n}", "t", g, "buy", q, 1.0, 0.0, day, n))
                lots.append([f"{g}-{n}", q])
        expected |= dict(lots)
    fills = spark.createDataFrame(rows, "fill_id string, track string, code long, side string, quantity long, price double, fees double, occurred_on date, seq int").repartition(5)
    assert {r.fill_id: r.quantity_left for r in ledger.remaining_lots(fills).collect()} == expected
    assert {(r.buy, r.sell): r.quantity for r in ledger.matched_lots(fills).collect()} == matched


def test_same_day_sale_is_a_violation(spark):
    rows = [("a", "t", 1, "buy", 100, 1.0, 0.0, date(2024, 1, 2), 0), ("b", "t", 1, "sell", 50, 1.0, 0.0, date(2024, 1, 2), 1), ("c", "t", 1, "sell", 60, 1.0, 0.0, date(2024, 1, 3), 2)]
    fills = spark.createDataFrame(rows, "fill_id string, track string, code long, side string, quantity long, price double, fees double, occurred_on date, seq int")
    assert [r.fill_id for r in ledger.settlement_violations(fills).collect()] == ["b", "c"]


def trend(codes=10, days=40):
    return [(f"sh.60000{c}", date(2024, 1, 1) + timedelta(days=i), 40.0 + 5 * c + i * (c + 1) / 5 + i % (c + 2) / 100, True, False) for c in range(codes) for i in range(days)]


BARS = "code string, trade_date date, signal_close double, trade_status boolean, is_st boolean"


def test_later_rows_do_not_change_features(spark):
    rows = trend()
    full = features.price_features(spark.createDataFrame(rows, BARS))
    for end in (25, 30, 35):
        day = date(2024, 1, 1) + timedelta(days=end)
        part = features.price_features(spark.createDataFrame([r for r in rows if r[1] <= day], BARS))
        of = lambda df: sorted(map(str, df.filter(F.col("trade_date") == F.lit(day)).collect()))
        assert of(full) == of(part)


def test_exclusions_in_order(spark):
    rows = trend(3, 22)
    rows = [(c, d, p, False if c.endswith("0") and d == date(2024, 1, 22) else t, c.endswith("1")) for c, d, p, t, s in rows] + [("sh.600009", date(2024, 1, 22), 5.0, True, False)]
    last = {r.code: r.exclusion for r in features.price_features(spark.createDataFrame(rows, BARS)).filter("trade_date = DATE'2024-01-22'").collect()}
    assert last == {"sh.600000": "not_tradable", "sh.600001": "st_stock", "sh.600002": None, "sh.600009": "insufficient_history"}


def test_regime_probabilities_and_emergency(spark):
    cols = "trade_date date, trend_return double, annualized_volatility double, breadth double, average_turnover double, concentration double, opening_return double"
    rows = [(date(2024, 1, 1), 0.1, 0.1, 0.9, 1.5, 0.1, 0.01), (date(2024, 1, 2), -0.2, 0.3, 0.1, 0.5, 0.5, 0.0), (date(2024, 1, 3), 0.0, 0.5, 0.5, 1.0, 0.2, -0.06)]
    out = regime.regime_labels(spark.createDataFrame(rows, cols)).orderBy("trade_date").collect()
    for r in out:
        assert abs(sum(r[f"p_{k}"] for k in regime.LABELS) - 1) < 1e-9
    assert [r.selected for r in out] == ["risk_on", "risk_off", "risk_off"] and [list(r.reasons) for r in out] == [[], ["trend_and_breadth"], ["volatility", "opening_selloff"]]


def fold_step(state, day, most, hysteresis):
    """(active, weights, moved) of a day in units of 1e-8, by plain Python."""
    recommended = allocate.STRATEGY_OF[day["selected"]]
    if state is None or state[0] == recommended:
        active = recommended
    elif not day["change"]:
        active = state[0]
    elif day["emergency"]:
        active = "cash"
    else:
        label = next(k for k, s in allocate.STRATEGY_OF.items() if s == state[0])
        active = recommended if day["p_" + day["selected"]] - day["p_" + label] >= hysteresis else state[0]
    wanted = {} if day["emergency"] or active == "cash" else day["desired"].get(active, {})
    old = {} if state is None else state[1]
    codes = sorted({*old, *wanted})
    moved = lambda new: sum(abs(new.get(c, 0) - old.get(c, 0)) for c in codes) + abs(sum(new.values()) - sum(old.values()))
    full, way = moved(wanted), 2 * (most - len(codes) - 1)
    if state is None or day["emergency"] or full <= 2 * most:
        return active, wanted, full
    if way <= 0:
        return active, old, 0
    blended = {c: w for c in codes if (w := (old.get(c, 0) * full + (wanted.get(c, 0) - old.get(c, 0)) * way) // full) > 0}
    return active, blended, moved(blended)


def test_replay_equals_a_plain_fold(spark):
    r = random.Random(11)
    labels, codes = list(allocate.STRATEGY_OF), ["a", "b", "c", "d", "e"]
    days, desired = [], []
    for k in range(90):
        d = date(2024, 1, 1) + timedelta(days=k)
        p = [r.random() for _ in labels]
        days.append((d, r.choice(labels), r.random() < 0.05, *p))
        for s in ("momentum", "short_term_reversal", "defensive_low_volatility"):
            if r.random() < 0.9:
                desired += [(d, s, c, round(r.uniform(0.01, 0.19), 8)) for c in r.sample(codes, r.randrange(0, 5))]
    scenarios = [(i, [0.0, 0.05, 0.2, 1.0][i % 4], [0.0, 0.3][i % 2], 1 + i % 3) for i in range(12)]
    regimes = spark.createDataFrame(days, "trade_date date, selected string, emergency boolean, " + ", ".join(f"p_{k} double" for k in labels))
    targets = spark.createDataFrame(desired, "trade_date date, strategy string, code string, weight double")
    out = allocate.replay(regimes.repartition(3), targets, spark.createDataFrame(scenarios, "scenario int, max_turnover double, hysteresis double, change_every int"))
    got = {(x.scenario, x.trade_date): (x.active_strategy, x.weights, x.moved) for x in out.collect()}
    for number, most, hysteresis, every in scenarios:
        state = None
        for n, row in enumerate(days):
            by = {}
            for d, s, c, w in desired:
                if d == row[0]:
                    by.setdefault(s, {})[c] = round(w * 10**8)
            day = {"selected": row[1], "emergency": row[2], "change": n % every == 0, "desired": by, **{f"p_{k}": v for k, v in zip(labels, row[3:])}}
            want = fold_step(state, day, round(most * 10**8), hysteresis)
            state = want[:2]
            assert got.pop((number, row[0])) == want
    assert not got and allocate.replay(regimes.limit(0), targets, spark.createDataFrame(scenarios, "scenario int, max_turnover double, hysteresis double, change_every int")).count() == 0
    wide = allocate.replayed_weights(out.filter("scenario = 2"))
    assert wide.columns == ["scenario", "trade_date", "active_strategy", "code", "weight", "turnover"] and wide.agg(F.max("turnover")).first()[0] <= 1


def test_market_rules(spark):
    df = spark.createDataFrame([("sh.688001", 10.05), ("sz.300001", 10.05), ("bj.430001", 10.0), ("sh.600000", 10.05)], "code string, p double")
    out = df.select(lot_size(F.col("code")), limit_price(F.col("p"), F.lit(0.1).cast("decimal(4,2)"), True), to_exchange_code(F.col("code")), from_exchange_code(to_exchange_code(F.col("code"))), fees(F.lit(10000), False), fees(F.lit(1000000), True)).collect()
    assert [r[0] for r in out] == [200, 100, 100, 100] and float(out[3][1]) == 11.06 and out[3][2] == "600000.XSHG" and out[2][2] is None and out[1][3] == "sz.300001"
    assert float(out[0][4]) == 5.10 and float(out[0][5]) == 810.0


def test_buys_fit_the_cash(spark):
    day = date(2024, 1, 2)
    rows = [(day, f"sh.60000{i}", 0.15, i, None, None, 100000.0, 33.0 + i, 33.0, True, 10, False, 0.15, 0.0, None) for i in range(6)]
    cols = "trade_date date, code string, weight double, rank int, quantity long, sellable long, equity double, execution_close double, previous_close double, trade_status boolean, volume long, is_st boolean, approved_weight double, current_weight double, reason string"
    cash = spark.createDataFrame([(day, 40000)], "trade_date date, c int").select("trade_date", F.col("c").cast("decimal(24,2)").alias("cash"))
    out = trading.planned_buys(spark.createDataFrame(rows, cols), cash).orderBy("place").collect()
    left = 40000.0
    for r in out:
        left -= float(r.quantity * r.price + r.fees)
    assert out and left >= 0 and abs(left - float(out[0].cash_after)) < 0.01 and all(r.quantity % 100 == 0 for r in out)


def test_listing_window_and_overlay(spark):
    d = lambda n: date(2024, 1, n)
    pairs = spark.createDataFrame([(d(2), "a"), (d(4), "a"), (d(2), "b"), (d(2), "zz")], "trade_date date, code string")
    inst = spark.createDataFrame([("a", d(1), d(4)), ("b", d(3), None)], "code string, ipo_date date, out_date date")
    assert sorted(map(tuple, quality.listing_split(pairs, inst).collect())) == [(d(2), "a", True), (d(2), "b", False), (d(4), "a", False)]
    drafts = spark.createDataFrame([('{"decision_id":"d","snapshot_id":"s","generated_at":"2024-01-01T00:00:00Z","valid_until":"2024-01-02T00:00:00Z","risk_scale":"1","strategy_weights":[{"strategy":"cash","weight":"1"}],"evidence":[]}',), ("nope",), ('{"decision_id":"d","extra":1}',)], "content string")
    errors = [list(r.errors) for r in overlay.parse_drafts(drafts).collect()]
    assert errors[0] == [] and "not_an_object" in errors[1] and {"missing_key", "unknown_key"} <= set(errors[2])


def test_folds_are_complete_and_do_not_overlap(spark):
    rows = [(p, date(2024, 1, 1) + timedelta(days=i), (0.002 if p == "good" else 0.0) + 0.0005 * (i % 2), 0.0003 * (i % 3), 0.0002, "risk_on") for p in ("good", "bad") for i in range(60)]
    series = spark.createDataFrame(rows, "parameter_id string, as_of date, net_return double, benchmark_return double, cost_rate double, regime string")
    trained, tested = evaluation.in_folds(series, 20, 10)
    chosen = evaluation.choose_parameters(trained)
    assert [(r.fold, r.selected_parameter) for r in chosen.orderBy("fold").collect()] == [(k, "good") for k in range(4)]
    oos = evaluation.out_of_sample(tested, chosen)
    assert oos.count() == 40 and oos.select("as_of").distinct().count() == 40


def test_normal_cdf_is_exact_to_twelve_digits(spark):
    from statistics import NormalDist

    from tidemark.operators import evaluation

    xs = [k / 16 for k in range(-160, 161)] + [2.9999999, 3.0, -3.0, 8.5, -37.0, 60.0, -60.0, 1e-9]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double").withColumn("p", evaluation.normal_cdf(F.col("x"))).collect()
    for x, p in rows[:-2]:
        assert abs(p - NormalDist().cdf(x)) < 1e-13, x
    assert rows[-2].p is None and rows[-1].p != rows[-1].p


def test_fingerprint_of_rows_in_any_order(spark):
    from tidemark.functions import hashing

    df = spark.createDataFrame([(k, None if k % 3 else f"t{k}", k / 7) for k in range(200)], "a long, b string, x double")
    read = lambda f: sorted(tuple(r) for r in f.collect())
    whole = hashing.fingerprint(df)
    assert read(whole) == read(hashing.fingerprint(df.repartition(5, "x"))) != read(hashing.fingerprint(df.unionByName(df.limit(1))))
    assert read(whole.select("bucket", "rows", "first_sum", "second_sum")) == read(hashing.fingerprint_with(hashing.fingerprint(df.filter("a < 120")), hashing.fingerprint(df.filter("a >= 120"))))
    changed = df.withColumn("x", F.when(F.col("a") == 7, 0.5).otherwise(F.col("x")))
    found = {r.bucket for r in hashing.differing_buckets(whole, hashing.fingerprint(changed)).collect()}
    assert 1 <= len(found) <= 2 and hashing.differing_buckets(whole, whole).count() == 0
    # nulls and lengths count
    texts = spark.createDataFrame([(None, "1"), ("1", None), ("ab", "c"), ("a", "bc"), ("", None), (None, "")], "a string, b string").select(hashing.row_text(df.select(F.lit("").alias("a"), F.lit("").alias("b"))).alias("t"))
    assert texts.distinct().count() == 6


def test_first_negative_balance(spark):
    d = lambda k: __import__("datetime").date(2024, 1, k)
    rows = [("a", "t", "buy", 10, 1.0, 0.0, d(1), 1), ("b", "t", "buy", 95, 1.0, 0.0, d(2), 1), ("c", "t", "sell", 50, 1.0, 0.0, d(2), 2), ("d", "u", "buy", 5, 1.0, 0.0, d(1), 1)]
    fills = spark.createDataFrame(rows, "fill_id string, track string, side string, quantity long, price double, fees double, occurred_on date, seq long")
    from tidemark.operators import ledger

    got = ledger.first_negative(fills, spark.createDataFrame([("t", 100.0), ("u", 5.0)], "track string, cash double")).collect()
    assert [(r.track, r.fill_id, r.balance) for r in got] == [("t", "b", -5.0)]
