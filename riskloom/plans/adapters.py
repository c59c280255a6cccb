"""The logical tables of the survey, derived from the driver's tables. The texts below run in Spark and in DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CIN = "concat('U', lpad(cast({k} % 100000 as string), 5, '0'), 'MH2015PTC', lpad(cast({k} as string), 6, '0'))"


def cin(k: str) -> str:
    return _CIN.replace("{k}", k)


BASE = "customer orders lineitem events part nation documents pages conversations".split()
#: name: select statement over base tables and earlier entries
VIEWS = {
    "last_order": "select o_custkey, max(cast(o_orderdate as date)) as last_day, max(case when o_orderdate <= timestamp '2000-12-31 00:00:00' then cast(o_orderdate as date) end) as old_day from orders group by o_custkey",
    "company": f"""select {cin("c_custkey")} as cin, c_custkey as k, c_name as company_name, concat('N', cast(c_nationkey as string)) as registered_state, c_mktsegment as industrial_class,
        case when c_custkey % 10 = 9 then 'Struck Off' else 'Active' end as status, make_date(cast(1995 + c_custkey % 7 as int), cast(1 + c_custkey % 12 as int), 1) as date_of_incorporation,
        case when c_custkey % 11 = 0 then null else last_day end as date_of_last_agm, case when c_custkey % 11 = 0 then null else old_day end as old_agm,
        cast(floor(abs(c_acctbal)) as bigint) * 1000 as authorized_capital, cast(floor(abs(c_acctbal)) as bigint) * 800 as paid_up_capital,
        case when c_custkey % 3 = 0 then concat('ABCDE', lpad(cast(c_custkey % 10000 as string), 4, '0'), 'F') end as pan from customer left join last_order on c_custkey = o_custkey""",
    "edge": f"""select lpad(cast(l_partkey as string), 8, '0') as din, {cin("o_custkey")} as cin, concat('Director ', cast(l_partkey % 500 as string)) as director_name, case when l_partkey % 7 = 0 then 'CFO' when l_partkey % 7 = 1 then 'Auditor' else 'Director' end as designation,
        cast(min(l_shipdate) as date) as date_of_appointment, case when count(case when o_orderstatus <> 'F' then 1 end) = 0 then cast(max(l_shipdate) as date) end as cessation_date
        from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1 and o_orderpriority = '1-URGENT' group by l_partkey, o_custkey""",
    "legal": f"""select {cin("o_custkey")} as cin, concat('C', cast(o_orderkey as string)) as case_number, case substring(o_orderpriority, 1, 1) when '1' then 'NCLT_7' when '2' then 'SARFAESI_13_4' when '3' then 'SEC_138' when '4' then 'DRT' else 'HIGH_COURT' end as case_type,
        case when o_orderstatus = 'F' then 'Disposed' else 'Pending' end as status, cast(floor(o_totalprice) as bigint) as amount, cast(o_orderdate as date) as filing_date from orders""",
    "finance": f"""select {cin("o_custkey")} as cin, cast(year(o_orderdate) as int) as financial_year, case when o_custkey % 5 = 0 then null else round(sum(o_totalprice) / (max(abs(c_acctbal)) * 100 + 1), 2) end as debt_to_equity, round(sum(o_totalprice), 2) as revenue, cast(count(*) as bigint) as debt
        from orders join customer on o_custkey = c_custkey group by o_custkey, year(o_orderdate)""",
    "ev": f"""select event_id as id, {cin("user_id")} as cin, user_id, concat('s', cast(event_id % 4 as string)) as source, case event_type when 'error' then 'AGM_OVERDUE' when 'click' then 'SEC138_FILED' when 'view' then 'GST_CANCELLED' when 'purchase' then 'CAPITAL_CHANGE' else 'DIRECTOR_RESIGNED' end as event_type,
        case when value > 200 then 'CRITICAL' when value > 100 then 'ALERT' when value > 20 then 'WATCH' else 'INFO' end as severity, cast(ts as timestamp) as detected_at, props as data_json, value from events""",
    "pull": "select user_id as key, cast(ts as timestamp) as pull_ts, event_id as id, case when value > 100 then 'cancelled' when value > 50 then 'suspended' when value > 2 then 'active' else 'inactive' end as status, cast(floor(value) as int) as complaints, case when value > 100 then 'medium' when value > 20 then 'small' else 'micro' end as classification from events",
    "pred": f"""select event_id as prediction_id, {cin("user_id")} as cin, cast(ts as timestamp) as fired_at, case when value > 200 then 'CRITICAL' when value > 100 then 'ALERT' when value > 20 then 'WATCH' else 'INFO' end as severity,
        case when value > 100 then true end as confirmed, case when value < 5 then true end as false_positive, cast(null as boolean) as expired from events where event_type = 'purchase'""",
    "cost": "select cast(ts as date) as log_date, event_type as service, concat('op', cast(event_id % 3 as string)) as operation, cast(event_id % 7 as bigint) as units, cast(value as decimal(10,4)) as cost_inr from events",
    "watch": """select cast(n_nationkey as int) as watchlist_id, case when n_nationkey % 3 = 0 then concat('N', cast(n_nationkey as string)) end as state_filter, case when n_nationkey % 4 = 1 then 'BUILDING' end as sector_filter,
        case when n_nationkey % 2 = 0 then 'WATCH' else 'ALERT' end as severity_min, case when n_nationkey % 5 = 2 then 'GST_CANCELLED' end as one_type, n_nationkey % 6 = 5 as by_company, n_nationkey <> 24 as is_active from nation""",
    "entry_": f"""select cast(c_nationkey as int) as subscriber_id, {cin("c_custkey")} as cin from customer where c_custkey % 3 = 1""",
    "subscriber": "select cast(n_nationkey as int) as subscriber_id, case n_nationkey % 4 when 0 then 'INFO' when 1 then 'WATCH' when 2 then 'RED' else 'CRITICAL' end as severity_threshold from nation",
}

def oracle(sql: str) -> str:
    """A DuckDB statement over the logical tables."""
    head = ", ".join(f"{name} as ({text})" for name, text in VIEWS.items())
    recursive = "recursive " if sql.lstrip().lower().startswith("with recursive ") else ""
    own = re.sub(r"(?i)^with (?:recursive )?", ", ", sql.lstrip()) if sql.lstrip().lower().startswith("with ") else f" {sql}"
    return f"with {recursive}{head}{own}"


class Tables:
    """Lazily derived logical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = VIEWS[name]
            used = [t for t in [*BASE, *VIEWS] if t != name and re.search(rf"\b(?:from|join) {t}\b", text)]
            for t in used:
                text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
            self._made[name] = self.spark.sql(text, **{t: self.base(t) if t in BASE else getattr(self, t) for t in used})
        return self._made[name]

    @cached_property
    def event_day(self):
        return F.lit("2024-01-31 00:00:00").cast("timestamp")

    @cached_property
    def order_day(self):
        return F.lit("2001-08-02 00:00:00").cast("timestamp")
