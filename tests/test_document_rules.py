"""Rules that stand in the documents only (survey O10, O17)."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import detect, score

PAIRS = {
    "UNSTABLE_GROWTH": ("WATCH", ["CAPITAL_INCREASE", "DIRECTOR_RESIGNED"]),
    "NEW_MSME_SELLER": ("INFO", ["NEW_COMPANY", "UDYAM_NEW", "GEM_NEW_SELLER"]),
    "HEALTHY_TRADER": ("INFO", ["IEC_NEW", "GST_RESTORED", "EPFO_HIRING_SURGE"]),
    "MAJOR_EXPANSION": ("INFO", ["CCI_MERGER_APPROVED", "CAPITAL_INCREASE"]),
    "PROJECT_GREENLIGHTED": ("INFO", ["EC_GRANTED", "CPPP_TENDER_EVENT"]),
    "WORKFORCE_REDUCTION": ("ALERT", ["LABOUR_MASS_RETRENCHMENT", "EPFO_CONTRIBUTION_DROP"]),
}


def test_matrix_of_the_documents(spark):
    t, rows = dt.datetime(2024, 1, 30), []
    for rule, (_, kinds) in PAIRS.items():
        rows += [(len(rows) + i, rule, k, t) for i, k in enumerate(kinds)]
        rows.append((len(rows), f"one of {rule}", kinds[0], t))
    e = spark.createDataFrame(rows, "id long, cin string, event_type string, detected_at timestamp")
    m = spark.createDataFrame([(r, "Active") for r in PAIRS], "cin string, status string")
    got = {(r.cin, r.rule, r.severity) for r in score.combine_signals(e, m, F.lit("2024-01-31 00:00:00").cast("timestamp")).collect()}
    assert got == {(rule, rule, severity) for rule, (severity, _) in PAIRS.items()}


def test_batch_rules(spark):
    df = spark.createDataFrame([(1, "Debarment"), (2, "investigation opened"), (3, "Action against director"), (4, "penalty"), (5, "Pledge created"), (6, None)], "id int, txt string")
    run = lambda kind: {r.id: (r.event_type, r.severity) for r in detect.classify_batch(df, kind, "txt", ["id"]).collect()}
    got = run("regulator_order_type")
    assert [got[i] for i in (1, 2, 3, 4)] == [("SEBI_DEBARMENT", "CRITICAL"), ("SEBI_INVESTIGATION", "WATCH"), ("SEBI_DIRECTOR_ACTION", "ALERT"), ("SEBI_PENALTY", "ALERT")]
    assert run("promoter_disclosure") == {5: ("SEBI_PLEDGE_CREATED", "WATCH")}
    assert set(run("vat_backfill").values()) == {("VAT_HISTORICAL_DEFAULT", "WATCH")}


def test_commercial_suits_need_a_claim(spark):
    df = spark.createDataFrame([(1, "suit", 10_000_000), (2, "suit", 10_000_001), (3, "suit", None), (4, "attachment", 5)], "id int, txt string, claim long")
    got = {r.id: r.event_type for r in detect.classify_suits(df, "txt", "claim", ["id"]).collect()}
    assert got == {2: "HIGH_COURT_COMMERCIAL_SUIT", 4: "HIGH_COURT_ATTACHMENT"}
