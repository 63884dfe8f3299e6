"""Queries against SQL where there is some, else that they run; nothing but the package itself is needed."""

import re

import pytest

from hostlens.llm import queries as q
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    assert same_rows(q.QUERIES[name](spark, sf), duck, q.ORACLE_SQL[name]) > 0


def test_every_number_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(q.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_ranking_expressions_stay_in_the_jvm(spark, sf):
    """Operators marked native run no Python on their main path."""
    for name in ("op1_mix_sources", "op2_shard_compaction", "op5_personal_data", "op6_decontaminate"):
        plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name
