"""Units of any kind, and the join beyond the broadcast bound."""

import pytest

from otflow.llm import decontamination as D

TANK = "A tank holds 240 litres of water and loses 8 litres per minute through a small crack, so how long does it take until the tank is empty?"
ITEMS = [(1, TANK), (2, "Which of the following rivers crosses the old border before it turns to the north sea near the lighthouse?"), (3, None), (4, "two words")]
COPIES = {
    1: TANK, 2: TANK.replace("240", "300").replace("8", "5"), 3: TANK.replace("240 litres", "300 gallons").replace("8 litres", "5 gallons"),
    4: TANK.replace("240 litres", "90 kilograms").replace("8 litres", "2 kilograms"), 5: TANK.replace("litres", "LITERS"), 6: TANK.replace("240 litres", "300 gallons").replace("8 litres", "5 pints"),
    7: ITEMS[1][1].upper(), 8: "A tank is a large thing, and the old sea is near the lighthouse.", 9: None, 10: "", 11: TANK + " " + TANK, 12: "plain words " * 1500 + TANK,
}


@pytest.mark.parametrize("bound", [D.BROADCAST_BYTES, -1])
def test_units_and_joins(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_BYTES", bound)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [*COPIES.items(), (1, TANK), (None, TANK)]
    got = sorted((str(r.doc_id), tuple(r.item_ids)) for r in D.judge(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    want = {i: (1,) for i in (1, 2, 3, 4, 5, 11, 12)} | {7: (2,)}
    # two units for one of the item's don't correspond: fewer windows than half
    found = {r.doc_id: r.found for r in D.find(spark.createDataFrame(rows, "doc_id long, text string"), bench, coverage=0.0).collect() if r.item_id == 1}
    assert found[6] < found[3] == found[1]
    assert [x for x in got if x[0] != "6"] == sorted([(str(i), want.get(i, ())) for i in COPIES if i != 6] + [("1", (1,)), ("None", (1,))])
