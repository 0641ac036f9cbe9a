import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm.top_items import LoserTree, top_items

SCHEMA = "q string, f string, score double, id long, cap int, __g string, __run string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), min_size=1, max_size=7))
def test_loser_tree_merges(runs):
    tree = LoserTree([sorted((x, i) for x in r) for i, r in enumerate(runs)])
    out = []
    while (row := tree.pop()) is not None:
        out.append(row)
    assert out == sorted((x, i) for i, r in enumerate(runs) for x in r)


def test_against_brute_force_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.4
        q, f = ("q0", "hot") if hot else (rng.choice(["q1", "q2", None]), rng.choice(["a", "b", None]))
        score = rng.choice([None, float("nan"), 0.5, 0.5, 0.7, rng.random()])
        rows.append((q, f, score, i if rng.random() > 0.01 else None, {"q0": 7, "q1": 0}.get(q, 2), "clash", "clash"))
    got = {(r.q, r.f, r.id) for r in top_items(spark.createDataFrame(rows, SCHEMA).repartition(6), ["q", "f"], "score", "id", "cap").collect()}
    groups = {}
    for q, f, s, i, cap, *_ in rows:
        if s is not None and s == s and i is not None:
            groups.setdefault((q, f, cap), []).append((-s, i))
    assert got == {(q, f, i) for (q, f, cap), v in groups.items() for _, i in sorted(v)[:cap]}


def test_empty(spark):
    assert top_items(spark.createDataFrame([], SCHEMA), ["q", "f"], "score", "id", "cap").count() == 0
