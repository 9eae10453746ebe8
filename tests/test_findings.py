"""Queries against their SQL on rows that the small tables lack."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.streaming import threads

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
TEXTS = ["ÍCO CO2 ÉCO2é\nCOÍ HC\nxNOx NOxé PM2.5ê", "A one\n a\tb", "ABCD \nEFGH\nIJ　 KL", " \n \tabcdefg\n\n x", "12345678\t\n a b", "HC_ HC- éHCé mg/lé Đmg/l"]


@pytest.mark.parametrize("name, table, key", [("analyzer_fallback", "benchmark", "item_id"), ("unit_wrap", "documents", "doc_id"), ("unit_wrap_decree", "documents", "doc_id")])
def test_query_on_accents_and_blanks(spark, tmp_path, name, table, key):
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS for _ in range(12))]
    spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(r[names.index(n)] for n in df.columns) for r in cur.fetchall())
    assert sorted(map(tuple, df.collect())) == want


def test_a_few_lookups_lay_out_no_corpus(spark, sf):
    """What asks the corpus once neither shuffles nor writes its texts."""
    for name in ("xref_pass", "ref_pass", "siblings_all", "parent_pull"):
        QUERIES[name](spark, sf)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestone_")]


class Kept:
    """A state variable in memory."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, v):
        self.v = (self.v or []) + v

    def clear(self):
        self.v = None


def test_only_the_turn_left_waiting_has_a_timer():
    """Turns that are decided or replaced in the batch that brings them cost no timer, and their events are kept together."""
    timers, early, waiting = [], Kept(), Kept()
    handle = SimpleNamespace(getListState=lambda *_: early, getValueState=lambda *_: waiting, registerTimer=timers.append)
    machine = threads.TurnMachine(timedelta(days=2))
    machine.init(handle)
    rows = [SimpleNamespace(ms=n * 1000, seq=n, at=datetime.fromtimestamp(n), event=json.dumps({"kind": "ask", "path": "p", "waits": True, "draft": f"d{n}", "approved": False}), kind="ask", path="p", waits=True, draft=f"d{n}", answer=None, approved=False, override=None) for n in range(50)]
    list(machine.handleInputRows(("t",), iter(rows), None))
    assert timers == [0] and len(early.v) == 1
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6)
    out = list(machine.handleExpiredTimer(("t",), now, None))
    assert [r.status for r in out].count("replaced") == 49 and len(out) == 99
    assert timers == [0, 49_000 + 2 * 86_400_000] and waiting.v[1] == 49 and early.v is None


def test_a_line_gets_its_wording_once(spark, sf):
    """No filter on lines makes them anew."""
    plan = QUERIES["line_merge_islands"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Chương IV") == 1
