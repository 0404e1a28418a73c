"""The limit of a run reaches the lines that are written."""

from strandloom.config import EngineConfig
from strandloom.plans import catalogue, inputs


def test_brief_lines_up_to_the_limit(spark, small):
    rows = inputs.calls(spark, small).filter("circ_type in ('S', 'R')").select("support").collect()
    want = sum((r["support"] or 0) <= EngineConfig().max_support for r in rows)
    assert want > sum((r["support"] or 0) <= 5 for r in rows)
    assert catalogue.queries()["brief_sink_all"](spark, small).count() == want
