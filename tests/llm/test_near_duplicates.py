import os
import random
import re
import time

from stratalog.llm.components import components
from stratalog.llm.near_duplicates import expand_pairs, members, near_duplicates, near_pairs

SCHEMA = "unit string, id string, content string, k long, g string, part int"


def grams(text, n):
    w = re.findall(r"[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def corpus(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(words))
            what = rng.random()
            if what < 0.4:
                words[at] = "edit" + str(rng.randrange(99))
            elif what < 0.7:
                words.insert(at, "ins")
            elif len(words) > 3:
                words.pop(at)
        rows.append((rng.choice(["chunk", "file"]), f"d{i:04d}", ("\r\n" if rng.random() < 0.1 else " ").join(words)))
    return rows


def brute(rows, n, t, least):
    out = set()
    sets = [(u, i, c.replace("\r\n", "\n"), *grams(c, n)) for u, i, c in rows if c is not None]
    for x, (u, i, c, s, w) in enumerate(sets):
        for v, j, d, r, z in sets[x + 1 :]:
            if u == v and c != d and w >= max(least, n) and z >= max(least, n) and len(s & r) >= t * len(s | r) - 1e-9:
                out.add((u, *sorted((i, j))))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(rng, 260) + [("file", "n1", None), ("file", "n2", ""), ("file", "n3", "one"), ("file", "n4", "É İ ſtraße " * 12)]
    rows += [(u, i + "x", c) for u, i, c in rows[:20]] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    for n, t, least in ((3, 0.6, 30), (5, 0.8, 0), (1, 0.5, 0)):
        pairs = near_pairs(docs, "unit", "content", n, t, least)
        got = {(r["group"], r.id_a, r.id_b) for r in expand_pairs(pairs, members(docs, "id", "unit", "content")).collect()}
        assert got == brute(list(dict.fromkeys(rows)), n, t, least)


def test_a_hot_leader_is_split_into_blocks(spark, monkeypatch):
    import stratalog.llm.near_duplicates as m

    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(words)
        own[rng.randrange(60)] = f"x{i}"
        rows.append(("file", f"d{i:03d}", " ".join(own)))
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)
    monkeypatch.setattr(m, "BLOCK", 7)
    got = {(r["group"], r.id_a, r.id_b) for r in expand_pairs(near_pairs(docs, "unit", "content", 3, 0.6, 30), members(docs, "id", "unit", "content")).collect()}
    assert got == brute(rows, 3, 0.6, 30) and len(got) == 60 * 59 // 2


def test_classes(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [("file", "a", text), ("file", "b", text + " more"), ("file", "c", text), ("file", "d", "else"), ("file", "e", None), ("chunk", "f", text)]
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)
    got = {r.id: r for r in near_duplicates(docs, members(docs, "id", "unit", "content"), "unit", "content", 3, 0.6, 30).collect()}
    assert len(got) == 6 and got["a"].class_id == got["b"].class_id == got["c"].class_id
    assert len({got[x].class_id for x in "adef"}) == 4 and (got["a"].links, got["b"].links, got["d"].links) == (1, 1, 0)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs, members(docs, "id", "unit", "content"), "unit", "content").count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(80)] + [(7, 7), (2, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_pairs_of_copies(spark, monkeypatch):
    import stratalog.llm.near_duplicates as m

    monkeypatch.setattr(m, "COPIES", 4)  # the hot text meets in several parts
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("file", f"a{i:02d}", text.replace(" ", "\r\n" if i % 2 else "\n")) for i in range(23)] + [("chunk", "c1", text), ("chunk", "c2", text), ("chunk", "c2", text)]
    rows += [("file", "s1", "too short"), ("file", "s2", "too short"), ("file", "n1", None), ("file", "n2", None), ("file", "e1", ""), ("file", "e2", "")]
    member = m.members(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA), "id", "unit", "content", 30)
    got = [(r["group"], r.id_a, r.id_b) for r in m.copy_pairs(member).collect()]
    assert len(got) == len(set(got)) == 23 * 22 // 2 + 1 and ("chunk", "c1", "c2") in got and all(a < b for _, a, b in got)
    assert m.copy_pairs(member.limit(0)).count() == 0


def on_disk(spark, near):
    """Bytes of the shuffle files that lie there, and of the tables that ``near`` is read from."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    left = 0
    while files.hasNext():
        f = files.next()
        left += f.length() if f.getName().startswith("shuffle_") else 0
    return left + sum(os.path.getsize(x.removeprefix("file:")) for x in near.inputFiles()) if near is not None else left


def test_disk_with_many_ranges_and_grams_shared_by_chance(spark, monkeypatch):
    import stratalog.llm.near_duplicates as m

    rng = random.Random(3)
    rows = [("file", f"d{i:04d}", " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(60, 400)))) for i in range(1200)]
    words = rows[0][2].split()
    for at in (5, 50):
        words[at] = "edit"
        rows.append(("file", f"e{at}", " ".join(words)))
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(m, "_ranges", lambda docs: 128)  # as for a large input
    before = on_disk(spark, None)
    near = near_pairs(docs, "unit", "content", 3, 0.6, 30)
    size = sum(len(c) for _, _, c in rows)
    for _ in range(50):  # files are removed in the background
        took = on_disk(spark, near) - before
        if took < 3 * size:
            break
        time.sleep(0.2)
    assert took < 3 * size
    assert {(r["group"], r.id_a, r.id_b) for r in expand_pairs(near, members(docs, "id", "unit", "content")).collect()} == {("file", "d0000", "e5"), ("file", "d0000", "e50"), ("file", "e5", "e50")}


def test_texts_stay_at_a_gram_only_with_a_possible_partner():
    import stratalog.llm.near_duplicates as m

    rng = random.Random(4)
    for t in (0.5, 0.6, 0.8, 1.0):
        rows = sorted((rng.randrange(60), n := rng.randrange(1, 30), rng.randrange(1, n + 1)) for _ in range(300))
        got = m.possible(*(m.np.array(x) for x in zip(*rows)), t)
        for i, (g, n, left) in enumerate(rows):
            fits = any(j != i and g == h and min(left, rest) * (1 + t) >= t * (n + k) - 1e-9 for j, (h, k, rest) in enumerate(rows))
            assert got[i] == fits
