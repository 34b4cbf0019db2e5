"""Every core query against its SQL oracle, as the driver does; and the contract of the entry module."""

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sluicework import serve
from sluicework.operators.sheets import ALIASES
from sluicework.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents source_registry notice evidence_version evidence_snapshot position_record user_profile major_catalog eval_item".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NaT or v != v else round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_selection_violations(spark):
    got = registry.queries()["selection_violations"](spark, SF).toPandas()
    assert set(got.violation.dropna()) >= {"unknown", "repeated"}
    assert got[got.violation.isna()].groupby("evidence_id").size().max() <= 3  # of each selection


def test_sheet_positions_against_a_loop(spark):
    names = {n: f for f, own in ALIASES.items() for n in own}
    want = []
    for r in spark.read.parquet(f"{SF}/evidence_version.parquet").where("content_type like '%spreadsheet%' or content_type like '%excel%'").select("id", "extracted_text").distinct().collect():
        lines = [(i, [c.strip() for c in x.strip().split("\t")]) for i, x in enumerate((r.extracted_text or "").split("\n")) if "\t" in x.strip()]
        lines = [(i, c) for i, c in lines if len(c) >= 3]
        head = next(((i, c) for i, c in lines if sum(x in names for x in c) >= 3), None)
        for i, cells in lines if head else []:
            if i > head[0] and sum(bool(c) for c in cells) > 1 and sum(c in names for c in cells) < 3:
                own = {names[h]: c for h, c in zip(head[1], cells) if h in names and c}
                if own.keys() & {"position_code", "position_name", "employer"}:
                    want.append((r.id, i, own.get("position_code", "unknown"), own.get("position_name", "unknown")))
    got = registry.queries()["sheet_positions"](spark, SF).select("id", "row_index", "position_code", "position_name").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and got.columns[0] == "id"


def test_core_stands_without_llm():
    code = "import sys; sys.modules['sluicework.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries(); print('fine')"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60).stdout.strip() == "fine"


def test_serving(spark, capsys):
    repo = serve.Repository(spark, SF)
    n = repo.notices("candidate", 5)
    assert n.count() == 5 and {r.decision for r in n.collect()} == {"candidate"} and repo.notices(limit=10**9).count() <= 500
    with pytest.raises(ValueError):
        repo.notices("x")
    key = repo.positions(limit=1).first().id
    assert repo.position(key)["id"] == key and repo.position("none") is None and repo.source_health().count() == 240
    assert serve.main(["list-positions", "--data", SF, "--limit", "2"]) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    said = []

    def broken(m):
        raise OSError("down")

    messages = [{"channel": "a"}, {"channel": "b"}, {"channel": "z"}, {"channel": "a", "attempts": 3}, {"channel": "a", "status": "sent"}]
    assert serve.dispatch(messages, {"a": said.append, "b": broken}) == {"sent": 1, "failed": 1, "unsupported": 1} and messages[1]["attempts"] == 1
    assert serve.dispatch(messages, {"a": said.append, "b": said.append}) == {"sent": 1, "failed": 0, "unsupported": 1}
