from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm.splitting import cut, place, split_oversized

CHUNKS = "chunk_id string, snapshot_id string, file_path string, start_line int, end_line int, content string, metadata struct<lang: string>, piece int, whole string, max_lines int"
LIMITS = "lang string, max_lines int, max_chars int, overlap_lines int"


def count(text):
    return text.count("\n") + (not text.endswith("\n"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["", "a = 1;", "}", "def f():", "x" * 50, "ab; " * 30, "\r"]), max_size=60), st.booleans(), st.integers(1, 12), st.integers(1, 90), st.integers(0, 6))
def test_pieces_are_whole_within_limits_and_overlap(lines, end, max_lines, max_chars, overlap):
    text = "\n".join(lines) + "\n" * end
    pieces = cut(text, max_lines, max_chars, overlap)
    done, last = 0, -1
    for i, (a, b, at, part) in enumerate(pieces):
        assert part == text[at : at + len(part)] and at <= done < at + len(part) or text == ""
        assert len(part) <= max_chars and count(part) <= max_lines
        assert a == text.count("\n", 0, at) and b - a + 1 == count(part)
        if i and a <= last:
            assert last - a + 1 <= max(overlap, 1)
        done, last = at + len(part), b
    assert done == len(text)


def test_overlap_is_exact_where_it_fits():
    text = "".join(f"line {i};\n" for i in range(100))
    pieces = cut(text, 20, 1000, 4)
    assert len(pieces) > 5 and all(p[1] - q[0] + 1 == 4 for p, q in zip(pieces, pieces[1:], strict=False))


def test_cuts_at_blank_lines():
    text = "".join("\n" if i % 10 == 9 else f"s{i}\n" for i in range(40))
    assert all(p[3].endswith("\n\n") for p in cut(text, 20, 1000, 0)[:-1])


def test_place():
    assert place("b\nc", "a\r\nb\r\nc\r\n", 5, 6) == 1
    assert place("a\n", "a\nx\na\n", 2, 2) == 2
    assert place("q", "a", None, 3) == 3 and place("q", None, None, None) == 0


def test_operator_with_dirty_rows(spark):
    big = "".join(f"v{i} = {i}\n" for i in range(12))
    meta = lambda lang: (lang,)
    rows = [
        ("c1", "s", ".\\f", 1, 12, big, meta("PyThon"), 0, "w", 0), ("c1", "s", "f", 1, 12, big, meta("PyThon"), 0, "w", 0),
        ("c2", "s", "f", None, None, big, None, 0, "w", 0), ("c3", "s", "f", 0, 0, None, meta("python"), 0, "w", 0),
        ("c4", "s", "f", 0, 0, "", meta(None), 0, "w", 0), ("c5", "s", "f", 0, 0, "y" * 5000, meta("other"), 0, "w", 0), (None, None, None, None, None, "k", None, None, None, None),
    ]
    limits = spark.createDataFrame([("python", 5, 500, 1), ("*", 80, 4000, 5)], LIMITS)
    files = spark.createDataFrame([("s", "f", "head\n" + big)], "snapshot_id string, path string, content string")
    got = split_oversized(spark.createDataFrame(rows, CHUNKS), limits, files).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {"c1", "c5"}
    own = [r for r in got if r.chunk_id == "c1"]
    assert own[0].start_line == 1 and own[-1].end_line == 12 and all(b.start_line == a.end_line for a, b in zip(own, own[1:], strict=False))
    assert split_oversized(spark.createDataFrame([], CHUNKS), limits).count() == 0
