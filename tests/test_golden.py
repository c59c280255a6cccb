"""Small tables with results worked out by hand."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from riskloom.functions import clean
from riskloom.operators import detect, resolve, route, score, signals
from riskloom.sources import tables as src

DAY = dt.date(2024, 1, 31)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_money_dates_and_numbers(spark):
    for raw, want in [("₹12.5 Cr", 125_000_000), ("50 Lakh", 5_000_000), ("1250000", 1_250_000), ("1,250", 1250), ("none", None)]:
        assert one(spark, raw, clean.money) == want
    for raw, want in [("15-01-2024", dt.date(2024, 1, 15)), ("15/01/2024", dt.date(2024, 1, 15)), ("2024-01-15", dt.date(2024, 1, 15)), ("15 Mar 2024", dt.date(2024, 3, 15)), ("07.04.2026", dt.date(2026, 4, 7)), ("garbage", None)]:
        assert one(spark, raw, clean.any_date) == want
    assert one(spark, "1,234.9", clean.whole) == 1234 and one(spark, "abc", clean.whole) is None


def test_names(spark):
    assert one(spark, "A.B.C. Steel (India) Pvt. Ltd.", clean.name_strict) == "abc steel"
    assert one(spark, "Infosys Technologies Ltd", clean.name_strict) == "infosys"
    assert one(spark, "abc steel", clean.name_strict) == "abc steel"
    assert one(spark, "Ramesh Kumar", clean.likely_person) and not one(spark, "Ramesh Steel", clean.likely_person)
    assert one(spark, "Acme Pvt Ltd vs State of X; Beta LLP versus Union of India", clean.parties) == ["Acme Pvt Ltd", "Beta LLP"]
    assert one(spark, "Hiring legal, engineering and finance staff", clean.role_types) == ["finance", "legal", "engineering"]


def test_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("", ""), ("same", "same")], "a string, b string")
    got = [round(r.s, 4) for r in df.select(clean.similarity("a", "b").alias("s")).collect()]
    assert got == [0.3636, 0.0, 1.0]
    back = [round(r.s, 4) for r in df.select(clean.similarity("b", "a").alias("s")).collect()]
    assert back == got


def test_company_diff(spark):
    schema = "cin string, status string, paid_up_capital string, date_of_last_agm date"
    ago = lambda n: DAY - dt.timedelta(days=n)
    old = spark.createDataFrame([("U1", "Active", "1000000", ago(100)), ("U2", "Active", "1000000", ago(100)), ("U3", "Active", "1000000", ago(100)), ("U4", "Active", "1", None)], schema)
    new = spark.createDataFrame([("U1", "Struck Off", "1000000", ago(100)), ("U2", "Active", "2000000", ago(600)), ("U3", "Active", "1200000", ago(100)), ("U5", "Active", "1", None)], schema)
    got = {(r.cin, r.event_type, r.severity) for r in detect.diff_companies(old, new, F.lit(DAY)).collect()}
    assert got == {("U1", "STATUS_CHANGE", "ALERT"), ("U2", "CAPITAL_CHANGE", "WATCH"), ("U2", "AGM_OVERDUE", "WATCH"), ("U4", "COMPANY_REMOVED", "ALERT"), ("U5", "NEW_COMPANY", "INFO")}
    assert detect.diff_companies(new, new, F.lit(DAY)).count() == 0


def test_detectors_are_idempotent(spark):
    r = spark.createDataFrame([("U1", "R1", "Section 9"), ("U1", "R1", "x"), ("U2", None, "x"), (None, "R3", "x")], "cin string, record_id string, filing_type string")
    none = r.limit(0).select("cin", "record_id")
    got = detect.detect_source(r, none, "nclt")
    assert [(x.cin, x.severity) for x in got.collect()] == [("U1", "CRITICAL")]
    assert detect.detect_source(r, got.select("cin", "record_id"), "nclt").count() == 0


def test_transitions(spark):
    rows = [(1, 1, "Active"), (1, 2, "Cancelled"), (1, 3, "Cancelled"), (1, 4, "Active"), (2, 1, None), (2, 2, "Suspended")]
    df = spark.createDataFrame(rows, "key int, pull_ts int, status string")
    got = [(r.key, r.pull_ts, r.event_type, r.severity) for r in detect.transitions(df, "gst", ["key"]).orderBy("key", "pull_ts").collect()]
    assert got == [(1, 2, "GST_CANCELLED", "CRITICAL"), (1, 4, "GST_RESTORED", "INFO")]


def test_fingerprint_ignores_order(spark):
    rows = [("s", i, f"v{i}") for i in range(20)]
    a, b = (spark.createDataFrame(x, "source string, id int, v string") for x in (rows, rows[::-1]))
    f = detect.fingerprint(a, ["source"])
    assert f.collect() == detect.fingerprint(b.repartition(3), ["source"]).collect()
    assert detect.changed_sources(f, f, ["source"]).count() == 0


def test_score_and_penalty(spark):
    parts = spark.createDataFrame([("U1", 50, "AMBER", 40.0, 20.0, 5.0, 40.0, 50.0)], "cin string, health_score_before int, health_band_before string, filing_freshness double, director_stability double, legal_risk double, financial_health double, capital_trajectory double")
    r = score.weigh(parts).first()
    assert (r.score, r.band, r.score_stored) == (28.3, "RED", 28)
    edges = spark.createDataFrame([("D1", "U1", None), ("D1", "U2", None), ("D2", "U1", None), ("D2", "U3", None), ("D3", "U1", DAY), ("D3", "U4", None)], "din string, cin string, cessation_date date")
    bands = spark.createDataFrame([("U2", "RED"), ("U3", "AMBER"), ("U4", "RED")], "cin string, band string")
    p = {r.cin: (r.penalty, r.contributors) for r in score.contagion_penalty(score.peers(edges), bands).collect()}
    assert p == {"U1": (20, ["U2", "U3"])}


def test_combination_needs_all_conditions(spark):
    t = dt.datetime(2024, 1, 30)
    e = spark.createDataFrame([(1, "U1", "GST_CANCELLED", t), (2, "U2", "SEC138_FILED", t), (3, "U3", "AGM_OVERDUE", t), (4, "U3", "SEC138_FILED", t)], "id long, cin string, event_type string, detected_at timestamp")
    m = spark.createDataFrame([("U1", "Active"), ("U2", "Active"), ("U3", "Active")], "cin string, status string")
    got = {(r.cin, r.rule) for r in score.combine_signals(e, m, F.lit("2024-01-31 00:00:00").cast("timestamp")).collect()}
    assert got == {("U1", "ZOMBIE_COMPANY"), ("U3", "PRE_INSOLVENCY_CLASSIC")}


def test_digests_partition_alerts(spark):
    t = dt.datetime(2024, 1, 30)
    rows = [(i, i % 2, f"U{i % 3}", "WATCH" if i % 2 else "ALERT", t + dt.timedelta(hours=i), 10 + i, 20 + i, i) for i in range(12)]
    a = spark.createDataFrame(rows, "alert_id long, watchlist_id int, cin string, severity string, detected_at timestamp, score_before int, score_after int, event_id long")
    d = route.build_digests(a).collect()
    assert sorted(i for r in d for i in r.alert_ids) == list(range(12))
    assert len({r.batch_id for r in d}) == len(d) == 6


def test_accuracy_and_ladder(spark):
    t = dt.datetime(2024, 1, 30)
    p = spark.createDataFrame([(t, True, None, None)] * 32 + [(t, None, True, None)] * 8, "fired_at timestamp, confirmed boolean, false_positive boolean, expired boolean")
    assert route.accuracy(p, F.lit("2024-01-31 00:00:00").cast("timestamp")).first().accuracy == 80.0
    pulls = spark.createDataFrame([("s", t + dt.timedelta(hours=i), i, f) for i, f in enumerate([True, True, True, True, False, True])], "source_id string, pull_at timestamp, id int, failed boolean")
    got = [(r.failures, r.state) for r in route.failure_ladder(pulls).orderBy("id").collect()]
    assert got == [(1, "DEGRADED"), (2, "DEGRADED"), (3, "DEGRADED"), (4, "UNREACHABLE"), (0, "OK"), (1, "DEGRADED")]


def test_master_file(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("﻿CIN,Company Name,Company-Status,State\nU12345MH2015PTC123456,Acme,Active,MH\nbad,,Active,MH\n")
    df = src.read_company_master(spark, str(path))
    good, bad = src.validate_master(df)
    assert [r.registered_state for r in good.collect()] == ["MH"]
    assert bad.first().reasons == ["bad cin", "no name"]


def test_resolution_cascade(spark):
    m = spark.createDataFrame([("U1", "Apex Steel Works Pvt Ltd", "MH", "24", "ABCDE1234F"), ("U2", "Bharat Foods Ltd", "MH", "10", None)], "cin string, company_name string, registered_state string, industrial_class string, pan string")
    q = spark.createDataFrame([(1, "x", None, None, "U2", None), (2, "y", None, None, None, "ABCDE1234F"), (3, "APEX STEEL WORKS", None, None, None, None), (4, "Apex Steal Works", "MH", None, None, None), (5, "Nobody", None, None, None, None)], "qid int, raw_name string, state string, industry string, cin string, pan string")
    got = {r.qid: (r.cin, r.confidence) for r in resolve.resolve_strict(q, m).collect()}
    assert got == {1: ("U2", 100.0), 2: ("U1", 100.0), 3: ("U1", 95.0), 4: ("U1", 85.0), 5: (None, 0.0)}
    assert resolve._jaro_winkler("martha", "marhta") == 0.9611111111111111


def test_strike_off_and_head_count(spark):
    df = spark.createDataFrame([("U1", 1, 100), ("U1", 2, 70), ("U1", 3, 90), ("U1", 4, 0)], "cin string, month int, headcount int")
    got = [(r.month, r.event_type) for r in signals.head_count(df).orderBy("month").collect()]
    assert got == [(2, "EPFO_CONTRIBUTION_DROP"), (3, "EPFO_HIRING_SURGE"), (4, "EPFO_DELISTED")]


def test_charges(spark):
    """One event a charge: a raise ends the row, a satisfied one is WATCH and does not exceed anything any more."""
    schema = "cin string, charge_id string, amount long, status string, authorized_capital long"
    old = spark.createDataFrame([("U1", k, 10_000_000, "Open", 5_000_000) for k in ("up", "done", "over", "same")] + [("U1", "was", 1, "Satisfied", 0)], schema)
    new = spark.createDataFrame([("U1", "up", 20_000_000, "Satisfied", 5_000_000), ("U1", "done", 10_000_000, "Satisfied", 5_000_000), ("U1", "over", 10_000_000, "Open", 5_000_000), ("U1", "same", 9_000_000, "Open", 0), ("U1", "was", 1, "Satisfied", 0), ("U1", "n1", 12_000_000, "Open", 1), ("U1", "n2", 100_000_001, "Open", 1), ("U1", "n3", 9, "Open", 1)], schema)
    got = {(r.charge_id, r.event_type, r.severity) for r in detect.classify_charges(old, new).collect()}
    assert got == {("up", "CHARGE_MODIFIED", "WATCH"), ("done", "CHARGE_SATISFIED", "WATCH"), ("over", "CHARGE_EXCEEDS_CAPITAL", "CRITICAL"), ("n1", "CHARGE_CREATED", "ALERT"), ("n2", "CHARGE_EXCEEDS_CAPITAL", "CRITICAL")}


def test_cool_down_counts_from_the_last_fired(spark):
    rows = [(d, "U1", "A", dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for d in (0, 20, 40, 60, 75)] + [(9, "U2", "A", dt.datetime(2024, 1, 2)), (10, "U2", "A", None)]
    e = spark.createDataFrame(rows, "id long, cin string, event_type string, detected_at timestamp")
    assert sorted(r.id for r in route.cool_down(e.repartition(3), 30).collect()) == [0, 9, 10, 40, 75]


def test_an_empty_list_of_companies_matches_nothing(spark):
    t = dt.datetime(2024, 1, 30)
    e = spark.createDataFrame([(1, "U1", "GST_CANCELLED", "CRITICAL", t), (2, "U2", "X", "INFO", t), (3, "U9", "X", "ALERT", t)], "id long, cin string, event_type string, severity string, detected_at timestamp")
    m = spark.createDataFrame([("U1", "MH", "24"), ("U2", "GJ", "10")], "cin string, registered_state string, industrial_class string")
    lists = [(1, None, None, "INFO", None, [], True), (2, None, None, "ALERT", None, None, True), (3, "MH", None, "INFO", None, None, True), (4, "MH", "10", "INFO", None, None, True), (5, None, "10", "INFO", ["X"], None, True), (6, None, None, "INFO", None, ["U2"], True), (7, None, None, "INFO", None, None, False)]
    w = spark.createDataFrame(lists, "watchlist_id int, state_filter string, sector_filter string, severity_min string, type_filter array<string>, cin_list array<string>, is_active boolean")
    for most in (100_000, 0):
        got = {(r.watchlist_id, r.event_id) for r in route.match_watchlists(e, w, m, most).collect()}
        assert got == {(2, 1), (2, 3), (3, 1), (5, 2), (6, 2)}


def test_watchlists_by_brute_force(spark):
    """Every state, industry, severity and list filter, known, unknown or missing, sent to every task or joined in slots."""
    t, rank = dt.datetime(2024, 1, 30), {"INFO": 1, "WATCH": 2, "ALERT": 3, "CRITICAL": 4}
    places = {f"U{i}": p for i, p in enumerate(itertools.product(("MH", "GJ", None), ("24", "10", None)))}
    levels = ("INFO", "ALERT", "CRITICAL", "ODD", None)
    events = [(i, cin, kind, level, t) for i, (cin, level, kind) in enumerate(itertools.product((*places, "U99"), levels, ("X", None)))]
    lists = [(i, *x, None, True) for i, x in enumerate(itertools.product(("MH", None), ("24", None), ("INFO", "CRITICAL", "ODD", None), (["X"], None)))]
    e = spark.createDataFrame(events, "id long, cin string, event_type string, severity string, detected_at timestamp")
    m = spark.createDataFrame([(k, *v) for k, v in places.items()], "cin string, registered_state string, industrial_class string")
    w = spark.createDataFrame(lists, "watchlist_id int, state_filter string, sector_filter string, severity_min string, type_filter array<string>, cin_list array<string>, is_active boolean")
    want = sorted((x[0], v[0]) for x in lists for v in events for state, sector in [places.get(v[1], (None, None))] if x[1] in (None, state) and x[2] in (None, sector) and rank.get(v[3], 0) >= rank.get(x[3], 0) and (x[4] is None or v[2] in x[4]))
    for most in (100_000, 0):
        assert sorted((r.watchlist_id, r.event_id) for r in route.match_watchlists(e, w, m, most, slots=5).collect()) == want


def test_directors_by_refresh(spark):
    schema = "cin string, din string, director_name string, designation string, date_of_appointment date, cessation_date date"
    old = spark.createDataFrame([("U1", "D1", "A", "CFO", DAY, None), ("U1", "D2", "B", "Director", DAY, None), ("U1", None, "Old Co", "Auditor", DAY, None)], schema)
    new = spark.createDataFrame([("U1", "D1", "A", "CFO", DAY, DAY), ("U1", "D2", "B", "Director", DAY, DAY), ("U1", None, "New Co", "Auditor", DAY, None), ("U2", None, "Any Co", "Auditor", DAY, None)], schema)
    got = {(r.cin, r.director_name, r.event_type, r.severity) for r in detect.refresh_directors(old, new).collect()}
    assert got == {("U1", "A", "CFO_RESIGNED", "ALERT"), ("U1", "B", "DIRECTOR_RESIGNED", "WATCH"), ("U1", "New Co", "AUDITOR_CHANGED", "ALERT")}
    many = spark.createDataFrame([(f"U{i}", "D9", "C", "Director", DAY, None) for i in range(11)], schema)
    assert {r.event_type for r in detect.refresh_directors(many, many).collect()} == {"DIRECTOR_OVERLOADED"}


def test_new_cases_of_one_number(spark):
    schema = "case_number string, source string, status string"
    old = spark.createDataFrame([("C1", "t", "Open")], schema)
    new = spark.createDataFrame([("C1", "t", "Closed"), ("C1", "t", "Closed"), ("C2", "t", "Open"), ("C2", "t", "Open")], schema)
    table, fresh = src.upsert_cases(old, new)
    assert sorted((r.case_number, r.status) for r in table.collect()) == [("C1", "Closed"), ("C2", "Open")] and fresh.count() == 1


def test_json_of_any_depth(spark):
    deep = '{"x": "no }{ depth"}'
    for i in range(12):
        deep = f'{{"l{i}": [{deep}]}}' if i else '{"rows": [{"dinNumber": "7", "directorName": "N"}]}'
    df = spark.createDataFrame([(1, deep), (2, None), (3, "not json"), (4, '{"a": "}}{{["}')], "k int, doc string")
    assert src.json_depth(df, "doc") == 25
    got = [(r.k, r.din, r.name) for r in src.json_records(df, "k", "doc", {"din": ["din"], "name": ["director_name"]}).collect()]
    assert got == [(1, "7", "N")]


def test_contagion_names_its_chain(spark):
    scores = spark.createDataFrame([("U1", 10.0, "RED"), ("U2", 70.0, "GREEN"), ("U3", 70.0, "GREEN"), ("U4", 70.0, "GREEN")], "cin string, score double, band string")
    edges = spark.createDataFrame([("D1", "U1", None), ("D1", "U2", None), ("D2", "U2", None), ("D2", "U3", None), ("D3", "U3", None), ("D3", "U4", None)], "din string, cin string, cessation_date date")
    got = {r.cin: (r.depth, r.chain, r.band_after) for r in score.propagate(scores, edges, scores.filter("band = 'RED'"), lambda df: df).collect()}
    assert got == {"U2": (1, ["U1", "U2"], "AMBER"), "U3": (2, ["U1", "U2", "U3"], "AMBER")}
    e = score.contagion_events(score.propagate(scores, edges, scores.filter("band = 'RED'"), lambda df: df), F.lit("2024-01-31 00:00:00").cast("timestamp")).filter("cin = 'U3'").first()
    assert (e.event_type, e.data_json) == ("CONTAGION_PROPAGATED", '{"origin_cin":"U1","depth":1,"chain":["U1","U2","U3"]}')


def test_light_resolution(spark):
    m = spark.createDataFrame([("U1", "Apex Steel Works Pvt Ltd"), ("U2", "Bharat Foods Ltd"), ("U3", "Bharat Foods International Ltd")], "cin string, company_name string")
    alias = spark.createDataFrame([("bharti food", "U2")], "normalized_alias string, cin string")
    q = spark.createDataFrame([(1, "Bharti Food Ltd"), (2, "M/s Apex Steel Works Limited"), (3, "Bharat Foods Int Ltd"), (4, "Apex Steal Works Ltd"), (5, "Ramesh Kumar"), (6, "Zzz Qqq Ltd")], "qid int, raw_name string")
    got = {r.qid: (r.cin, r.method) for r in resolve.resolve_light(q, m, alias).collect()}
    assert got == {1: ("U2", "alias"), 2: ("U1", "light_exact"), 3: ("U3", "prefix"), 4: ("U1", "trigram"), 5: (None, "person"), 6: (None, "none")}


def test_centrality(spark):
    """Two directors, three companies: the one that both sit on is the most central; capital of 0 is left out."""
    edges = spark.createDataFrame([("D1", "U1", None), ("D1", "U2", None), ("D2", "U2", None), ("D2", "U3", None), ("D2", "U0", None)], "din string, cin string, cessation_date date")
    capital = spark.createDataFrame([("U1", 1), ("U2", 1), ("U3", 1), ("U0", 0)], "cin string, capital long")
    got = {r.cin: r.centrality for r in signals.centrality(edges, capital, lambda df: spark.createDataFrame(df.collect(), df.schema), rounds=12).collect()}
    # the matrix [[1, 1, 0], [1, 2, 1], [0, 1, 1]] has the main vector (1, 2, 1)
    assert set(got) == {"U1", "U2", "U3"} and got["U2"] == 1.0 and abs(got["U1"] - 0.5) < 1e-4 and abs(got["U3"] - 0.5) < 1e-4

