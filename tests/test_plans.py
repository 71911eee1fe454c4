"""The plans' cost: how often tables are read, and that no window takes all rows into one task."""

import re

import pytest

from sondage.plans import kpi, kpi_queries, monitors, reference_queries
from sondage.sources import audit as source

FOLDER = "/root/testdata/sf0.001"


class Scans:
    """Counts the scans of Parquet in all plans that run."""

    def __init__(self, spark):
        self.spark, self.seen = spark, []

    def plan(self, df):
        self.seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    def count(self):
        return sum(len(re.findall(r"FileScan parquet", p)) for p in self.seen)


@pytest.fixture()
def scans(spark, monkeypatch):
    import sondage.session as session

    found, cut = Scans(spark), session.cut_lineage
    for module in (kpi, monitors, __import__("sondage.functions.quantiles", fromlist=["x"])):
        monkeypatch.setattr(module, "cut_lineage", lambda df: cut(found.plan(df)))
    return found


@pytest.mark.parametrize("by,most", [(None, 8), ("model", 9)])
def test_indicators_read_their_tables_few_times(spark, scans, by, most):
    scans.plan(kpi.compute(kpi_queries.inputs(spark, FOLDER, by))[0])
    assert 0 < scans.count() <= most


def test_monitors_rank_days_not_rows(spark, scans):
    plan = scans.plan(monitors.assess(reference_queries._observed(spark, FOLDER)))._jdf.queryExecution().executedPlan().toString()
    assert scans.count() <= 32
    # What goes into one partition is a row for each day, block or edge: never a scan.
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part.split("\n")[1] if "\n" in part else ""
        assert "FileScan" not in below
    assert source is not None
