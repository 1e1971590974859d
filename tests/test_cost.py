from __future__ import annotations

import pytest

from tessera.cost import CLOUD, LINKS, Budget, BudgetExceeded, Distance, Meter, Place, PriceTable, Rates, Spread, StorageFacts, Tier


def test_budget_permits_up_to_its_limit():
    m = Meter(Budget(bytes=4e6))
    for _ in range(4):
        m.charge(1e6)
    with pytest.raises(BudgetExceeded, match="bytes"):
        m.charge(1e6)
    assert m.spent.bytes == 5e6
    with pytest.raises(BudgetExceeded):
        m.charge(0)


def test_prices():
    assert CLOUD.byte_usd(Tier.COLD) == pytest.approx(26 * CLOUD.hot_byte)
    assert CLOUD.byte_usd(Tier.HOT, Distance.FAR) == pytest.approx(51 * CLOUD.hot_byte)
    assert CLOUD.retention_usd(1e9, 30) == pytest.approx(0.023, rel=0.01)
    p = PriceTable.from_rates(Rates(4e-7, 0.02, 0.01, 0.023, 0.04, 1e6))
    assert p.hot_byte == pytest.approx(4e-13) and p.far_factor == pytest.approx(51)


def test_waiting_is_shared_by_reads_at_once():
    m = Meter(at_once=4)
    for _ in range(8):
        m.charge(0)
    assert m.spent.wait_s == pytest.approx(8 * LINKS[Distance.LOCAL].latency_s)
    assert m.wait_s == pytest.approx(2 * LINKS[Distance.LOCAL].latency_s)


def test_places_and_facts():
    here = Place.parse("eu/1/a")
    assert here.distance(Place.parse("eu/1/a")) is Distance.LOCAL and here.distance(Place.parse("eu/2")) is Distance.NEAR
    assert here.distance(Place.parse("us/1")) is Distance.FAR and here.distance(Place()) is Distance.FAR
    f = StorageFacts(here)
    f.declare("/d", Tier.HOT, Place.parse("eu/1/a"))
    f.declare("/d/old", Tier.COLD, Place.parse("us"))
    assert f.resolve("/d/old/x").tier is Tier.COLD and f.resolve("/d/new").distance is Distance.LOCAL
    assert f.resolve("/elsewhere").assumed and f.resolve("/elsewhere").distance is Distance.FAR


@pytest.mark.parametrize(("layout", "overlap", "build"), [("clustered", 0.0, False), ("scattered", 1.0, False), ("selective", 0.01, True), ("partial", 0.13, True)])
def test_gate_on_the_four_layouts(layout, overlap, build):
    bounds = [(i * 10.0, i * 10.0 + 9) for i in range(20)] if layout == "clustered" else [(0.0, 100.0)] * 20
    s = Spread.from_bounds(bounds, overlap)
    assert (s.index_advantage() >= 0.10) is build
    assert Spread.from_bounds([None, None]) is None
