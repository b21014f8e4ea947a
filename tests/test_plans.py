"""Plan shape: pushdown, pruning and the broadcast sides that the design relies on."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_paging_pushes_filter_and_prunes(spark):
    p = _plan(E.queries()["q4_query_scores"](spark, SMOKE))
    assert "LessThan(event_id,5000)" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in p
    assert "TakeOrderedAndProject" in p


def test_rules_join_is_broadcast_nested_loop(spark):
    p = _plan(E.queries()["e2_match_rules"](spark, SMOKE))
    assert "BroadcastNestedLoopJoin" in p and "CartesianProduct" not in p


def test_liveness_broadcasts_expected_list(spark):
    p = _plan(E.queries()["q17_service_liveness"](spark, SMOKE))
    assert "BroadcastHashJoin" in p and "BroadcastExchange" in p


def test_feature_vectors_partial_aggregation(spark):
    from lookout.plans import q_detect as QD
    from lookout.operators import features as FE
    p = _plan(FE.feature_vectors(QD.telemetry(spark, SMOKE), 3600))
    assert p.count("HashAggregate") >= 2  # map-side partial + final
