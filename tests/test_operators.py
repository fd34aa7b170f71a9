import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nocturne.operators import automata
from nocturne.operators import cohort as C
from nocturne.operators import intervals as I
from nocturne.operators import learning as L


def test_grid_rules(spark):
    rows = spark.createDataFrame([(k, float(t)) for k, t in enumerate((900, 901, 1049, 1050, 1060, 100))], "k int, total double")
    n = {r.k: r["count"] for r in I.segment_grid(rows, "k", "total", 300.0).groupBy("k").count().collect()}
    assert n == {0: 3, 1: 3, 2: 3, 3: 4, 4: 4, 5: 1}
    last = I.segment_grid(rows, "k", "total", 300.0).where("k = 5").first()
    assert (last.duration_sec, last.is_complete) == (100.0, False)


def test_interval_join_is_the_product_with_its_condition(spark):
    r = random.Random(5)
    make = lambda n: [(r.choice("ab"), i, float(s := r.randint(0, 200)), float(s + r.randint(0, 40))) for i in range(n)]
    left, right = make(60), make(60)
    a = spark.createDataFrame(left, "k string, i int, s double, e double")
    b = spark.createDataFrame(right, "k string, j int, x double, y double")
    for touching in (False, True):
        got = sorted((p.i, p.j) for p in I.interval_join(a, b, "k", ("s", "e"), ("x", "y"), 17.0, touching).collect())
        hit = (lambda l, q: l[2] <= q[3] and l[3] >= q[2]) if touching else (lambda l, q: l[2] < q[3] and l[3] > q[2])
        assert got == sorted((l[1], q[1]) for l in left for q in right if l[0] == q[0] and hit(l, q))


def test_empty_tables(spark):
    a = spark.createDataFrame([], "k string, i int, s double, e double")
    b = spark.createDataFrame([], "k string, j int, x double, y double")
    assert I.interval_join(a, b, "k", ("s", "e"), ("x", "y"), 10.0).count() == 0
    empty = spark.createDataFrame([], "y int, p double, age int")
    assert C.auroc(empty, "y", "p").first().auroc is None
    assert C.auroc_age(empty, "y", "p", "age", 2).first().auroc_age is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6), st.integers(50, 60)), min_size=1, max_size=25))
def test_auroc_of_pairs(spark, rows):
    df = spark.createDataFrame([(y, s / 6, a) for y, s, a in rows], "y int, p double, age int")
    for gap, name in ((None, "auroc"), (2, "auroc_age")):
        pairs = [(p, q) for y, p, a in rows if y for z, q, b in rows if not z and (gap is None or abs(a - b) <= gap)]
        want = sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs) if pairs else None
        out = (C.auroc(df, "y", "p") if gap is None else C.auroc_age(df, "y", "p", "age", gap)).first()[name]
        assert out is None if want is None else abs(out - want) < 1e-9


def test_cycles():
    def spans(stages):
        return [(c[1], c[2], c[3]) for c in automata.find_cycles(stages.split(), 5.0)]

    assert spans("W W W") == []
    assert spans("N2 N2 W W W") == [(0, 3, 3)]  # two wake segments belong to the block
    assert spans("N2 W W W N2") == [(0, 2, 2)]  # 5 min and two wake segments make 15
    assert spans("N2 REM N2 REM") == []  # 5 min of NREM are no cycle
    assert spans("N2 N2 N2 REM REM N2 N2 N2") == [(0, 4, 2), (5, 7, 7)]
    assert spans("N2 N2 N2 " + "W " * 11 + "REM") == [(0, 4, 4)]
    assert spans("W " * 4) == [] and spans("") == []


def test_cycles_by_recording(spark):
    rows = [("a", i, s) for i, s in enumerate("N2 N2 N2 REM".split())] + [("b", i, "W") for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i int, s string")
    out = automata.sleep_cycles(df, "k", "i", "s", 5.0).collect()
    assert [(r.k, r.start_idx, r.end_idx, r.rem_min) for r in out] == [("a", 0, 3, 5.0)]


def test_folds_are_stratified_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = L.stratified_folds(df, "id", "y")
    n = {(r.fold, r.y): r["count"] for r in a.groupBy("fold", "y").count().collect()}
    assert len(n) == 10 and all(120 <= v <= 240 for (f, y), v in n.items() if not y)
    assert a.exceptAll(L.stratified_folds(df.repartition(7), "id", "y")).count() == 0


def test_summary_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    rows = {r.k: r for r in df.groupBy("k").agg(*C.summary("v")).collect()}
    assert rows["a"].std == 0.0 and rows["a"].p25 is None
    assert rows["b"].n == 2 and abs(rows["b"].std - 0.5**0.5) < 1e-12
