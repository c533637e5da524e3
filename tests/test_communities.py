"""Tables of communities on a network solved by hand: three origins, two exits, two ways out in hazard."""

import pytest

from egress.operators import communities

ARCS = "unit string, eid long, src long, dst long, capacity_vph double, travel_s double, hazard_max int, length_m double, road_key string, per_lane double, road_class string, lanes_imputed boolean"
ROWS = [
    ("w", 0, 10, 20, 60.0, 4.0, 0, 120.0, "hill", 30.0, "tertiary", False),
    ("w", 1, 11, 20, 40.0, 3.0, 0, 90.0, "mill", 30.0, "tertiary", False),
    ("w", 2, 12, 21, 50.0, 2.0, 0, 150.0, "lake", 30.0, "tertiary", False),
    ("w", 3, 20, 30, 80.0, 5.0, 2, 200.0, "main", 30.0, "primary", True),
    ("w", 4, 21, 31, 35.0, 6.0, 0, 300.0, "east", 30.0, "secondary", False),
    ("w", 5, 21, 20, 25.0, 2.0, 0, 80.0, None, 30.0, "tertiary", False),
    ("w", 6, 20, 31, 20.0, 9.0, 3, 250.0, "old", 30.0, "primary", False),
]
BACK = [("w", 11, 20, 11, 30.0, 3.0, 0, 90.0, "mill", 30.0, "tertiary", False), ("w", 12, 30, 20, 25.0, 5.0, 0, 200.0, "main", 30.0, "primary", False)]
PAIR = "unit string, vid long"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def net(spark, rows=ROWS):
    return table(spark, rows, ARCS), table(spark, [("w", v) for v in (10, 11, 12)], PAIR), table(spark, [("w", 30), ("w", 31)], PAIR), table(spark, [("w", v, 1.0) for v in (10, 11, 12)], PAIR + ", w double")


def test_demand(spark):
    members = table(spark, [("c", 0, 0.0, 0.0), ("c", 1, 10.0, 0.0), ("d", 5, 0.0, 0.0), ("d", 6, 1.0, 0.0)], "unit string, vid long, x double, y double")
    blocks = table(spark, [("c", 1, 1.0, 1.0, 4.0), ("c", 2, -1.0, 0.0, 2.0), ("c", 3, 9.0, 0.0, 5.0), ("c", 4, 8.0, 0.0, 0.0)], "unit string, block long, x double, y double, veh double")
    reach = table(spark, [("c", 0), ("c", 1), ("d", 6)], PAIR)
    got = {(r.unit, r.vid): r.w for r in communities.demand(blocks, members, reach).collect()}
    assert got == {("c", 0): 6.0, ("c", 1): 5.0, ("d", 6): 1.0}
    even = communities.demand(blocks, members, reach, table(spark, [("c",)], "unit string"))
    assert {(r.unit, r.vid): r.w for r in even.collect()} == {("c", 0): 1.0, ("c", 1): 1.0, ("d", 6): 1.0}


def test_ranking(spark):
    arcs, members, targets, weights = net(spark)
    other = table(spark, [("d", 0, 0, 1, 10.0, 1.0, 0, 1.0, None, 1.0, "tertiary", False)], ARCS)
    people = table(spark, [("w", 270, 240.0), ("d", 5, 3.0), ("e", 1, 0.0)], "unit string, population long, vehicles double")
    members = members.union(table(spark, [("d", 0)], PAIR))
    targets = targets.union(table(spark, [("d", 7), ("e", 7)], PAIR))
    weights = weights.union(table(spark, [("d", 0, 3.0)], PAIR + ", w double"))
    rows = communities.rank_communities(arcs.union(other), members, targets, weights, people, {"vh": 3, "h": 2}, 3).collect()
    assert [r.unit for r in rows] == ["d", "w", "e"]  # infinite pressure, 2, unknown
    d, w, e = rows
    assert (d.note, e.note, w.note) == ("no route to any target", "no node inside", None)
    assert (d.stranded_vehicles, d.cut_off, d.managed_vph, e.n_nodes) == (3.0, True, None, 0)
    assert (w.n_disjoint, w.capacity_vph, w.n_disjoint_nohaz_vh, w.capacity_nohaz_vh, w.n_disjoint_nohaz_h, w.capacity_nohaz_h, w.cut_off_nohaz_h) == (3, 135.0, 2, 115.0, 1, 35.0, False)
    assert w.exposed_share == pytest.approx(20 / 135) and w.people_per_capacity == 2.0 and w.tt_min == 8.0 and w.efficiency == pytest.approx((1 / 9 + 2 / 8) / 3)
    assert (w.managed_vph, w.managed_h) == (pytest.approx(120.0), pytest.approx(2.0))
    assert w.strict_vph == pytest.approx(105) and w.rationed_vph > 105 and w.last_h == pytest.approx(240 / 105) and w.gap_last == pytest.approx(1 - 105 / 120)


def test_policies(spark):
    """Each number by hand: lanes turned on the way that binds, then on the whole cut; four roads widened, of equals the one with fewer lane km; an extra road."""
    arcs, members, targets, weights = net(spark, ROWS + BACK)
    vehicles = table(spark, [("w", 240.0)], "unit string, vehicles double")
    extra = table(spark, [("w", 40, 11, 31, 100.0, 9.0, 0, 500.0, None, 30.0, "track", True)], ARCS)
    selfish = table(spark, [("w", 3.2)], "unit string, h double")
    row = communities.policy_table(arcs, members, targets, weights, vehicles, selfish, extra).first()
    assert (row.n_disjoint, row.clear_h_managed, row.clear_h_vh_free, row.clear_h_h_free, row.I1_selfish_last_h) == (3, pytest.approx(2.0), pytest.approx(240 / 115), float("inf"), 3.2)
    assert (row.meets_L1, row.meets_L2, row.meets_L3, row.meets_L4, row.ladder_rung) == (True, True, False, False, 2)
    assert (row.I2_contraflow_h, row.I2_contraflow_km) == (pytest.approx(1.6), pytest.approx(0.29))
    assert (row.I3_widen_h, row.I3_lane_km, row.I3_steps) == (pytest.approx(240 / 180), pytest.approx(0.83), "mill; old; lake; old")
    assert (row.I4_n_disjoint_without, row.I4_n_disjoint_with) == (3, 4)
    assert (row.I4_vh_free_h_without, row.I4_vh_free_h_with, row.I4_fire_road_km_used) == (pytest.approx(240 / 115), pytest.approx(1.6), pytest.approx(0.5))


def test_widening_near_the_unit(spark):
    """Arcs of a road that is widened count only within reach of the unit."""
    arcs, _, targets, weights = net(spark, ROWS + BACK)
    load = table(spark, [("w", 240.0, 135.0)], "unit string, vehicles double, upper double")
    base = table(spark, [("w", 2.0)], "unit string, h double")
    near = table(spark, [("w", 1)], "unit string, eid long")
    told, steps = communities.widened(arcs, weights, targets, load, base, steps=1, near=near)
    assert [(r.step, r.road_key, r.h, r.km) for r in steps.collect()] == [(1, "mill", pytest.approx(240 / 135), pytest.approx(0.09))]
    assert told.first().lane_km == pytest.approx(0.09)


def test_group_evacuation(spark):
    arcs, members, targets, weights = (df.drop("unit") for df in net(spark))
    burned = table(spark, [(3,), (6,)], "eid long")
    out, cut, binding = communities.retro_group(arcs, members, targets, weights, 240.0, burned)
    row = out.first()
    assert (row.n_disjoint, row.mincut_capacity_vph, row.managed_vph, row.managed_h) == (3, 135.0, pytest.approx(120.0), pytest.approx(2.0))
    assert row.mincut_share_in_perimeter == pytest.approx(100 / 135) and row.binding_share_in_perimeter == 0.0
    assert (row.sens_2lane_mincut_vph, row.sens_2lane_managed_vph) == (150.0, pytest.approx(120.0))
    assert sorted((r.eid, r.in_perimeter, r.road_key) for r in cut.collect()) == [(3, True, "main"), (4, False, "east"), (6, True, "old")]
    assert [(r.eid, r.in_perimeter) for r in binding.collect()] == [(1, False)]
