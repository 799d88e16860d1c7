"""Layout and relational operators on small tables."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import cascade, layout, relational
from foliospark.plans import options


def frame(spark, items):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(items)], "rn int, item string")


@pytest.mark.parametrize(("items", "want"), [(["a"], [("a", "a")]), (["a", "b", "c", "d"], [("a", "b"), ("c", "d")]), (["a", "b", "c"], [("a", "b"), ("c", "c")])])
def test_pairs(spark, items, want):
    pairs = layout.pair_two_up(frame(spark, items), "item").orderBy("pair")
    assert [(r["left"], r["right"]) for r in pairs.collect()] == want


def test_odd_pair_without_duplicate(spark):
    assert layout.pair_two_up(frame(spark, ["a"]), "item", duplicate=False).first()["right"] == ""


def test_cards(spark):
    cells = layout.card_cells(frame(spark, list("abcdefg")))
    assert cells.select("page").distinct().count() == 2
    last = cells.where("item = 'g'").first()
    assert (last["page"], last["local"], last["col"], last["row"], last["x"], last["y"]) == (1, 0, 0, 0, 10.0, 22.0)
    assert [len(r["cards"]) for r in layout.card_pages(cells, ["item"]).orderBy("page").collect()] == [6, 1]
    assert layout.card_cells(frame(spark, ["a"]), columns=0, rows=-1).count() == 1


@pytest.mark.parametrize(("w", "h", "o", "rotated"), [(2000, 1500, {}, True), (1000, 1500, {}, False), (1000, 1000, {}, False), (2000, 1500, {"rotate_threshold": 200.0}, False), (2000, 1500, {"auto_rotate": False}, False), (0, 10, {}, False)])
def test_rotation(spark, w, h, o, rotated):
    df = spark.createDataFrame([(float(w), float(h))], "w double, h double")
    assert layout.place_in_slot(df, "w", "h", layout.TwoUpOptions(**o)).first()["rotated"] is rotated


def test_fit(spark):
    df = spark.createDataFrame([(200.0, 100.0)], "w double, h double")
    contain, cover = (layout.fit(F.col("w"), F.col("h"), 100.0, 100.0, m) for m in ("other", "COVER"))
    assert tuple(df.select(*contain, *cover).first()) == (100.0, 50.0, 200.0, 100.0)


def test_dpi(spark):
    df = spark.createDataFrame([(1600.0, 2200.0), (5000.0, 3000.0)], "w double, h double")
    w, h = layout.capped_dimensions(F.col("w"), F.col("h"), 138.5, 200.0)
    small, large = (tuple(r) for r in df.orderBy("w").select(w, h).collect())
    assert small == (1600, 2200) and large[0] <= 1635 and large[1] <= 2362 and 1.65 <= large[0] / large[1] <= 1.68


@pytest.mark.parametrize(("n", "user", "want"), [(2, 0, (2, 0)), (8, 0, (4, 150)), (25, 0, (5, 300)), (25, 10, (10, 100))])
def test_dispatch(spark, n, user, want):
    assert tuple(spark.range(1).select(layout.dispatch_policy(F.lit(n), F.lit(user)).alias("d")).select("d.*").first()) == want


def test_option_checks():
    assert options.check_aspect("16:9") == "16:9"
    for bad in ("16:10", "AUTO", ""):
        with pytest.raises(ValueError):
            options.check_aspect(bad)
    options.check_grid(2, 3)
    for bad in ((0, 3), (2, 7)):
        with pytest.raises(ValueError):
            options.check_grid(*bad)
    assert layout.TwoUpOptions(margin=0, rotate_threshold=-1, fit="", max_dpi=0, quality=101).settled() == layout.TwoUpOptions()


def test_cascade(spark):
    rows = [(1, True, None, None, None), (2, False, None, False, None), (3, False, None, None, "429"), (4, False, None, True, None), (5, True, "broken", True, None), (6, None, None, True, None)]
    df = spark.createDataFrame(rows, "i int, local boolean, le string, verdict boolean, ve string")
    stage = cascade.cascade_stage(*map(F.col, ("local", "le", "verdict", "ve")))
    assert [r[0] for r in df.orderBy("i").select(stage).collect()] == ["local", "triage", "fail_open", "approved", "approved", "approved"]
    off = cascade.cascade_stage(*map(F.col, ("local", "le", "verdict", "ve")), enabled=False)
    assert {r[0] for r in df.select(off).collect()} == {"approved"}


def test_size_split_and_lists(spark):
    df = spark.createDataFrame([("a", 10240), ("b", 204800), ("c", None)], "name string, size bigint")
    kept, skipped = relational.split_by_size(df, "size", 20480)
    assert [r[0] for r in kept.collect()] == ["b"] and sorted(r[0] for r in skipped.collect()) == ["a", "c"]
    names = spark.createDataFrame([("a",), ("a",), ("c",)], "name string")
    assert sorted(r[0] for r in relational.allow_list(df, names, "name").collect()) == ["a", "c"]


def test_upsert_search_blocks(spark):
    old, new = (spark.createDataFrame(r, "k string, v string") for r in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in relational.upsert(old, new, "k", "v").collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert relational.search(old, "  ", "k", "v").count() == 0 and relational.search(old, "B 2", "k", "v").count() == 1
    lines = spark.createDataFrame([(1, 0, "# First"), (1, 1, "run a"), (1, 2, " "), (1, 3, "run b"), (1, 4, "#Second"), (1, 5, "go")], "p int, n int, line string")
    got = [tuple(r) for r in relational.example_blocks(lines, "p", "n").orderBy("block").select("description", "body").collect()]
    assert got == [("First", "run a run b"), ("Second", "go")]


def test_resolve_paths(spark):
    wanted = spark.createDataFrame([("a - b.png",), ("x.png",), ("none",)], "path string")
    existing = spark.createDataFrame([(0, "A – b.png"), (1, "a – B.png"), (2, "x.png")], "ord int, path string")
    assert {tuple(r) for r in relational.resolve_paths(wanted, existing).collect()} == {("a - b.png", "A – b.png"), ("x.png", "x.png"), ("none", None)}
