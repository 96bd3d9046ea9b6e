"""Every core query over the smallest tables, beside its SQL; the scan and the joins of some plans; independence of the llm part."""

import ast
from pathlib import Path

import pytest

import oracle
from serat.plans import registry

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert not oracle.compare(spark, DATA, name).startswith("FAIL")


def test_nothing_imports_llm():
    for path in (REPO / "serat").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                named = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
                assert not any("llm" in n for n in named), path


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables aren't here")
@pytest.mark.parametrize("name", ["topic_outliers", "graph_edges", "vector_search", "p2_found", "entity_matches"])
def test_no_cross_products(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
