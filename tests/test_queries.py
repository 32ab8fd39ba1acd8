"""Every registered query against its SQL, and no plan with a cross join or a whole table in one task."""

import io
import re
from contextlib import redirect_stdout

import pytest

from __spark_entry__ import entry
from qsuite import registry
from qsuite.check import compare, connect
from qsuite.load import load_all

load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def plan_lines(df) -> list[str]:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return [re.sub(r"^[ :+*()\d-]*", "", line) for line in out.getvalue().split("\n")]


# what may go to one task: partial aggregates, rows already cut by a limit, and one row per partition
ONE_TASK = re.compile(r"functions=\[(partial_|merge_|\])|^(LocalLimit|TakeOrdered)|HashAggregate\(keys=\[_part#\d+")


# an approximate index has no SQL; tests/test_ivf.py measures its recall against the exact result
NO_SQL = {"vector_topk_ivf"}


def test_all_but_approximate_queries_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in NO_SQL])
def test_query_matches_sql(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    lines = plan_lines(df)
    assert not [x for x in lines if re.match("CartesianProduct|BroadcastNestedLoopJoin|CollectLimit -1", x)]
    assert not [below for line, below in zip(lines, lines[1:]) if line.startswith("Exchange SinglePartition") and not ONE_TASK.search(below)]
    ok, message = compare(spark, con, sf_dir, lambda *_: df, registry.ORACLES[name])
    assert ok, message


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"batch_id", "staged", "invalid", "duplicate", "existing", "to_process"}
