"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) > 80 and all(callable(f) for f in queries.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "rank", "label", "score"] and df.count() > 0


def test_core_does_not_import_the_training_data_operators():
    code = "import sys, __spark_entry__, lynceus.plans.registry as r; r.queries(); print(any(m.startswith('lynceus.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip() == "False"
    own = [p for p in (ROOT / "lynceus").rglob("*.py") if p.parent.name != "llm"]
    assert own and not any("lynceus.llm" in p.read_text() or "lynceus import llm" in p.read_text() for p in own)


def test_plans_push_down(spark):
    """Filters and columns reach the scan; equal keys join without a cross product."""
    plan = entry.queries()["star_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThan(l_shipdate" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    scan = next(x for x in plan.splitlines() if "lineitem.parquet" in x)
    assert "l_comment" not in scan and "l_quantity" not in scan
    plan = entry.queries()["manifest_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in next(x for x in plan.splitlines() if "FileScan" in x).split("DataFilters")[0]
