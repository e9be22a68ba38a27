"""What travels: rows that are made of others in great number must not be shuffled."""

import pytest

from rangeweave import catalog


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("),")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


@pytest.mark.parametrize("name", ["background_filter", "filter_smooth"])
def test_weights_are_added_up_where_they_arise(spark, data, name):
    keys = exchanges(getattr(catalog, name)(spark, data))
    assert keys and not [k for k in keys if " i#" in k]


def test_walked_cells_are_added_up_where_they_arise(spark, data):
    keys = exchanges(catalog.occupancy_grid(spark, data))
    assert keys and not [k for k in keys if "key#" in k]


def test_columns_of_a_pair_are_made_once(spark, data):
    plan = catalog.flow_step_full(spark, data)._jdf.queryExecution().executedPlan().toString()
    keys = exchanges(catalog.flow_step_full(spark, data))
    assert plan.count("Scan parquet") == 1 and not [k for k in keys if "key#" in k or " i#" in k]


def test_packets_are_not_searched(spark, data):
    plan = catalog.packet_returns(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan and "hex(packet" not in plan


def test_pairs_of_points_are_no_rows(spark, data):
    plan = catalog.scan_match(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [line for line in plan.splitlines() if "Join [" in line and "tx#" in line]


def test_levels_are_not_collected(spark, data):
    plan = catalog.train_match_levels(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "collect_list" not in plan


@pytest.mark.parametrize("name", ["filtered_states", "foreground_cells", "foreground_boxes"])
def test_cells_learn_of_their_column_without_a_join(spark, data, name):
    df = getattr(catalog, name)(spark, data)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString() and not [k for k in exchanges(df) if " i#" in k]


@pytest.mark.parametrize("name", ["_eval", "_eval_full"])
def test_only_what_the_camera_sees_meets(spark, data, name, monkeypatch):
    given = []
    monkeypatch.setattr(catalog.evaluate, "eval_rows", lambda *inputs: given.extend(inputs[:5]))
    getattr(catalog, name)(spark, data)
    assert len(given) == 5
    for df in given:
        columns = df.select("frame", "i", "j").distinct()
        assert columns.count() == catalog._in_camera(columns).count() > 0


def test_evaluation_in_view_is_that_of_all_columns(spark, data):
    from rangeweave.operators import evaluate, tracks
    from rangeweave.plans import fixtures as fx

    types = tracks.object_at(catalog._places(spark, data), fx.tracks(spark, data), ("frame", "i", "j"))
    want = evaluate.eval_rows(fx.scan_cells(spark, data), catalog.flow_solve(spark, data), catalog.background_filter(spark, data), catalog._match(spark, data), types, fx.CAMERA, fx.SPEC)
    got = catalog._eval(spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
