"""What changed between snapshots: patches, states of files, Merkle comparison."""

import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.functions import patches
from stratalog.operators.merkle_diff import merkle_changes
from stratalog.plans.changes import snapshot_changes

SNAPSHOTS = "snapshot_id string, workspace string, ts timestamp, received_at timestamp, is_selective boolean, selected_files array<string>, extra string"
FILES = "snapshot_id string, path string, content string, diff string, base_snapshot_id string, deleted boolean, is_binary boolean, received_at timestamp, ord int, workspace string"
T = datetime(2024, 1, 1)
lines = st.lists(st.sampled_from(["a", "b", "c", "", "x y"]), max_size=12)


def snap(i, n, ws="w", selective=None, selected=None, received=None):
    return (f"s{i}", ws, T + timedelta(hours=n) if n is not None else None, received or T, selective, selected, "clash")


def entry(i, path, content=None, diff=None, base=None, deleted=None, binary=None, received=0):
    return (f"s{i}", path, content, diff, f"s{base}" if base is not None else None, deleted, binary, T + timedelta(minutes=received), 7, "clash")


def changes(spark, snaps, files):
    s, f = spark.createDataFrame(snaps, SNAPSHOTS), spark.createDataFrame(files, FILES)
    return {(r.workspace, r.ord, r.path, r.change_kind) for r in snapshot_changes(s, f).collect()}


@settings(max_examples=150, deadline=None)
@given(lines, lines, st.booleans(), st.booleans())
def test_patch_round_trip(a, b, end_a, end_b):
    old, new = "\n".join(a) + "\n" * end_a, "\n".join(b) + "\n" * end_b
    assert patches.apply(old, patches.make("f", old, new)) == new


def test_patch_without_hunks_changes_nothing_and_a_misfit_is_unknown():
    assert patches.apply("a\n", None) == patches.apply("a\n", "") == patches.apply("a\n", "--- f\n+++ f\n") == "a\n"
    assert patches.apply("a\n", "@@ -1,1 +1,1 @@\n-zzz\n+y\n") is None
    assert patches.apply("q\nq\na\nb\n", "@@ -1,2 +1,2 @@\n a\n-b\n+c\n") == "q\nq\na\nc\n"


def test_states_of_files(spark):
    patch = patches.make("b", "1\n2\n", "1\n3\n")
    found = changes(
        spark,
        [snap(1, 1), snap(2, 2), snap(3, 3, selective=True, selected=["./b", "gone", "new\\x"]), snap(4, 4), snap(5, 4), snap(9, 1, "v"), snap(1, 1), snap(8, None, "empty")],
        [
            entry(1, "a", "x\r\ny\n"), entry(1, "b", "1\n2\n"), entry(1, "gone", "g"), entry(1, "bin", binary=True),
            entry(2, ".\\a", "x\ny\n"), entry(2, "b", "bad", received=1), entry(2, "b", base=1, diff=patch, received=5), entry(2, "gone", base=1), entry(2, "bin", binary=True), entry(2, "bin", binary=True),
            entry(3, "b", "1\n2\n"), entry(3, "new/x", ""), entry(3, "a", "not looked at"),
            entry(4, "b", base=3, diff="--- b\n+++ b\n"), entry(4, "a", deleted=True, content="x"), entry(4, "new/x", base=3),
            entry(5, "b", base=77), entry(5, "bin", "text now"), entry(5, None, "p"), entry(6, "b", "of no snapshot"),
        ],
    )
    assert found == {
        ("w", 2, "b", "changed"),
        ("w", 3, "b", "changed"), ("w", 3, "gone", "removed"), ("w", 3, "new/x", "added"),
        ("w", 4, "a", "removed"), ("w", 4, "bin", "removed"),
        ("w", 5, "b", "changed"), ("w", 5, "bin", "added"), ("w", 5, "new/x", "removed"),
    }


def test_empty_tables(spark):
    assert changes(spark, [], []) == set()
    assert changes(spark, [snap(1, 1), snap(2, 2)], []) == set()


def test_merkle_equals_brute_force(spark):
    rng = random.Random(3)
    rows, want, before = [], set(), {}
    for v in range(1, 9):
        now = {k: d for k, d in before.items() if rng.random() > 0.05}
        for k in range(400):
            if rng.random() < 0.04:
                now[f"k{k}"] = rng.randrange(5)
        if v == 5:
            now = {}
        rows += [("t", v, k, d, 8, "clash") for k, d in now.items()]
        if v > 1:
            want |= {(v, k, "removed" if k not in now else "added" if k not in before else "changed") for k in now.keys() | before.keys() if now.get(k) != before.get(k)}
        before = now
    states = spark.createDataFrame(rows, "scope string, v int, key string, d int, last int, __node string")
    for bits in ((0, 3, 6), (0,), (0, 4, 8, 12)):
        got = merkle_changes(states, ["scope"], "v", "key", "d", "last", bits).collect()
        assert {(r.v, r.key, r.change_kind) for r in got} == want and len(got) == len(want)


def test_merkle_over_ranges(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(300):
        v, before = 1, None
        while v <= 9:
            until = min(10, v + rng.randrange(1, 4))
            d = rng.choice([None, 0, 1, 2])  # None: absent
            if d is not None:
                rows.append(("t" if k % 2 else None, v, until, f"k{k}", d, 9))
            if v > 1 and d != before:
                want.add(("t" if k % 2 else None, v, f"k{k}", "removed" if d is None else "added" if before is None else "changed"))
            v, before = until, d
    states = spark.createDataFrame(rows, "scope string, v int, stop int, key string, d int, last int")
    for bits in (None, (0,), (0, 2, 5)):
        got = [tuple(r) for r in merkle_changes(states, ["scope"], "v", "key", "d", "last", bits, "stop").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert merkle_changes(states.limit(0), ["scope"], "v", "key", "d", "last", None, "stop").count() == 0
