"""Every company and name, every order, every event and customer is read."""

import os

import pytest

from riskloom.functions import clean
from riskloom.operators import resolve
from riskloom.plans.adapters import Tables
from riskloom.plans.queries import ORACLE, QUERIES, _name_pairs
from tests.compare import same

SF = "/root/testdata/sf0.01"


def _grams(name):
    return {f"  {w} "[i : i + 3] for w in name.split(" ") for i in range(len(w) + 1)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_company_and_name_is_matched(spark):
    t = Tables(spark, SF)
    m, q = _name_pairs(t)
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert m.count() == q.count() == n
    assert {r.qid for r in QUERIES["e5_resolve_light"](spark, SF).collect()} == {r.k for r in m.select("k").collect()}


def test_similarity_join_against_all_pairs(spark):
    """Also companies beyond k = 400 and names off the remainder: `same` by brute force."""
    places, trades = ["Apex", "Bharat", "Crystal"], ["Steel", "Textiles", "Chemical Works"]
    names = [(k, f"{places[k % 3]} {trades[k // 3 % 3]} {k}") for k in range(380, 440)]
    m = spark.createDataFrame([(f"U{k}", n) for k, n in names], "cin string, company_name string")
    q = spark.createDataFrame([(k, n.upper() if k % 2 else n.replace("e", "a")) for k, n in names], "qid int, raw_name string")
    light = lambda df, key, c: df.select(key, clean.name_light(c).alias("name"))
    left, right = light(q, "qid", "raw_name"), light(m, "cin", "company_name")
    got = {(r.qid, r.cin): round(r.sim, 9) for r in resolve.similar_names(left, right, 0.45).collect()}
    want = {}
    for a in left.collect():
        for b in right.collect():
            x, y = _grams(a.name), _grams(b.name)
            s = len(x & y) / len(x | y)
            if s > 0.45:
                want[a.qid, b.cin] = round(s, 9)
    assert got == want and any(qid > 400 for qid, _ in got)


def test_odd_transpositions_round_down():
    """Three letters out of order are one transposition, as in the SQL (found by matching every name)."""
    assert round(resolve._jaro_winkler("abcdefgh", "abdecfgh"), 6) == 0.966667


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_order_event_and_customer_is_read(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "events", "customer")}
    rows = lambda name: QUERIES[name](spark, SF)
    assert rows("a10_upsert_legal_events").count() == n["orders"]
    assert rows("a6_json_records").count() == rows("a7_json_deep_value").count() == n["events"]
    assert rows("j12_wilful_defaulters").select("borrower").distinct().count() == n["customer"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["k6_health_score", "f9_multiple_lenders", "j12_wilful_defaulters"])
def test_whole_inputs_against_sql(spark, name):
    """Neither the query nor its SQL cuts its input."""
    assert "o_orderkey % 10 = 0" not in ORACLE[name] and "c_custkey % 2 = 0)" not in ORACLE[name]
    same(QUERIES[name](spark, SF), ORACLE[name], SF)
