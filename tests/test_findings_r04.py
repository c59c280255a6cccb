"""Findings of round 4, each on the smallest case that shows it."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.operators import detect, similar
from riskloom.streaming import streams
from tests.test_streams import _Clock, _Handle


class _Counted(_Handle):
    """Counts the calls of the state store."""

    def __init__(self):
        super().__init__()
        self.calls, append = 0, self.state.appendValue

        def counted(row):
            self.calls += 1
            append(row)

        self.state.appendValue = counted


def test_held_alerts_share_a_state(monkeypatch):
    """a bucket's alerts are stored as one text for each due time, not one by one; digests stay apart by watchlist and company."""
    p, h = streams.HeldInBlocks(keys=("watchlist_id", "cin")), _Counted()
    p.init(h)
    alert = lambda i, s: {"watchlist_id": i % 2, "cin": f"U{i % 3}", "alert_id": i, "severity": s, "at": 100 - i, "score_before": i, "score_after": None}
    block = lambda rows: pd.DataFrame({"alert": [json.dumps(a) for a in rows]})
    out = lambda blocks: [tuple(r) for b in blocks for r in b.itertuples(index=False)]
    rows = [alert(i, ["ALERT", "INFO"][i >= 60]) for i in range(90)]
    now = out(p.handleInputRows((5,), iter([block(rows[:50]), block([*rows[50:], alert(99, "CRITICAL")])]), _Clock()))
    assert now == [(1, "U0", 1, "CRITICAL", 99, None, [99])]
    assert h.calls == 2 and len(h.timers) == 2
    first = out(p.handleExpiredTimer((5,), _Clock(4), None))
    assert len(first) == 6 and {r[:2]: r[6] for r in first}[0, "U1"] == list(range(58, 3, -6))
    assert {r[:2]: r[4] for r in first}[0, "U1"] == 58
    assert out(p.handleExpiredTimer((5,), _Clock(5), None)) == []
    assert sorted(i for r in out(p.handleExpiredTimer((5,), _Clock(168), None)) for i in r[6]) == list(range(60, 90))
    monkeypatch.setattr(streams, "PIECE", 7)
    list(p.handleInputRows((5,), iter([block(rows[:20])]), _Clock()))
    assert h.calls == 5 and sum(r[2] for r in out(p.handleExpiredTimer((5,), _Clock(4), None))) == 20


def _rows(sets, key, keys):
    table = {key: pa.array(keys), "g": pa.array([0] * len(sets), pa.int32()), "part": pa.array([0] * len(sets), pa.int64())}
    table |= {"n": pa.array([len(s) for s in sets], pa.int32()), "r": pa.array([1] * len(sets), pa.int32()), "ranks": pa.array([np.array(s, "<u2").tobytes() for s in sets], pa.binary())}
    return pa.table(table)


def test_few_pairs_are_compared_member_by_member(monkeypatch):
    """of the pairs that share a trigram only those are counted out that are nearly similar; sets of any size come out right."""
    made = np.random.default_rng(4)
    of = lambda size: [0, *sorted(made.choice(np.arange(1, 4000), size - 1, replace=False).tolist())]
    left = [of(k) for k in [24] * 600 + [20, 30, 300, 400]]
    near = lambda s, k: sorted({0, *s[: len(s) - k], *of(k)})
    right = [near(s, len(s) // 4) for s in left[::9]] + [near(left[-1], 150), near(left[-2], 200), left[0]] + [of(24) for _ in range(600)]
    compared, whole = [], similar._shared
    monkeypatch.setattr(similar, "_shared", lambda a, b: compared.append(len(a)) or whole(a, b))
    schema = pa.schema([("qid", pa.int64()), ("cin", pa.int64()), ("sim", pa.float64())])
    got = similar._similar(0.45, schema, ["g", "part"])(_rows(left, "qid", range(len(left))), _rows(right, "cin", range(len(right))))
    sim = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(i, j, sim(a, b)) for i, a in enumerate(left) for j, b in enumerate(right) if sim(a, b) > 0.45}
    assert {tuple(r.values()) for r in got.to_pylist()} == want and len(want) > 60
    assert sum(compared) < len(want) + len(left) * len(right) // 500


def test_a_directors_borrowers_are_dealt(spark):
    """the rows of one name come from several tasks, and each borrower meets each company once."""
    rows = spark.createDataFrame([(f"B{i}", "Director 1") for i in range(60)], "borrower string, director_name string")
    boards = spark.createDataFrame([("DIRECTOR 1", f"U{i}") for i in range(7)], "director_name string, cin string")
    master = spark.createDataFrame([], "cin string, company_name string")
    found = detect.defaulter_rows(rows, rows.limit(0), master, boards).filter("event_type = 'WILFUL_DEFAULT_DIRECTOR'").withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 420 and len({(r.borrower, r.cin) for r in found}) == 420
    assert len({r.task for r in found}) > 1
