"""Packing, mixing, residue."""

import random
import re
from re import _constants as K
from re import _parser

import pytest

from stratalog.llm.mixing import draw, pivot, shares
from stratalog.llm.packing import fill_report, pack, pack_histogram
from stratalog.llm import residue as R
from stratalog.llm.residue import evidence, residue
from stratalog.llm.tokens import count, encoder, vocabulary_path

DOCS = "doc_id long, text string, source string, n_tokens int, part int, piece int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], DOCS)


def test_histogram_packing():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randrange(5, 200)
        histogram = {rng.randrange(0, capacity + 1): rng.randrange(1, 300) for _ in range(rng.randrange(1, 30))}
        patterns = pack_histogram(histogram, capacity)
        got = {}
        for pattern, packs in patterns:
            assert packs > 0 and sum(a * b for a, b in pattern) <= capacity
            for length, each in pattern:
                got[length] = got.get(length, 0) + each * packs
        assert got == histogram
        total = sum(a * b for a, b in histogram.items())
        assert sum(n for _, n in patterns) <= 2 * total / capacity + 1  # all but one are more than half full


def test_every_text_is_packed_once(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.choice([0, 1, 3, 40, 300, 1000])), "s") for i in range(200)] + [(900, None, None), (901, "", "s"), (902, "   \n", "s"), (7, "again", "s")]
    specs = spark.createDataFrame([("a", 64, 0), ("b", 100, 3), ("b", 100, 3), ("none", None, 1)], "spec_id string, capacity_tokens int, separator_tokens int")
    packed = pack(docs(spark, rows), specs).collect()
    coder = encoder(vocabulary_path())
    for spec, capacity, separator in (("a", 64, 0), ("b", 100, 3)):
        own = [r for r in packed if r.spec_id == spec]
        room, by = {}, {}
        for r in own:
            room[r.container] = room.get(r.container, -separator) + r.n_tokens + separator
            by.setdefault(r.doc_id, []).append(r)
        assert max(room.values()) <= capacity and set(room) == set(range(len(room)))
        for i, t, _ in rows:
            if i != 7:
                n = count(coder, t) if t else 0
                assert sum(r.n_tokens for r in by[i]) == n and len(by[i]) == max(1, -(-n // capacity))
                assert sorted(r.first_token for r in by[i]) == list(range(0, max(1, n), capacity))
        assert len(by[7]) == 2 or sum(1 for r in by[7] if r.piece == 0) == 2
    report = {r.spec_id: r for r in fill_report(pack(docs(spark, rows), specs), specs).collect()}
    assert set(report) == {"a", "b"} and all(0.9 < r.fill <= 1 for r in report.values())
    assert pack(docs(spark, []), specs).count() == 0


def test_long_texts_are_counted_whole():
    coder = encoder(vocabulary_path())
    text = "several words in a row " * 60_000
    assert abs(count(coder, text) - len(coder.encode_ordinary(text))) <= 8


def test_pivot_keeps_the_mass_and_the_chances():
    rng = random.Random(1)
    total = [0.0, 0.0]
    for _ in range(20_000):
        a, b = pivot(0.3, 10, 0.6, 4, rng.random())
        assert abs(a * 10 + b * 4 - 5.4) < 1e-9 and (a in (0.0, 1.0) or b in (0.0, 1.0))
        total[0] += a
        total[1] += b
    assert abs(total[0] / 20_000 - 0.3) < 0.02 and abs(total[1] / 20_000 - 0.6) < 0.02


def test_shares(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60)), "Big-Source " if i % 2 else "big_source") for i in range(600)]
    rows += [(1000 + i, "tiny text here", "tiny") for i in range(10)] + [(2000, None, "tiny"), (2001, "", "tiny"), (2002, "x", None), (2003, "x", "unnamed")]
    goals = spark.createDataFrame([("m", "big_source", 0.6, 2), ("m", "tiny", 0.3, 4), ("m", "absent", 0.1, 3), ("n", "absent", 1.0, 1), (None, "tiny", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    drawn = draw(docs(spark, rows).repartition(5), goals)
    got = {(r.mix_id, r.source): r for r in shares(drawn, goals).collect()}
    assert got[("m", "tiny")].most_copies == 4 and got[("m", "tiny")].tokens == 120 and got[("m", "absent")].tokens == got[("n", "absent")].tokens == 0
    assert abs(got[("m", "big_source")].tokens - 240) <= 60
    ids = [(r.mix_id, r.doc_id) for r in drawn.collect()]
    assert len(ids) == len(set(ids)) and not {2000, 2001, 2002, 2003} & {i for _, i in ids}
    fixed = {(r.mix_id, r.source): r for r in shares(draw(docs(spark, rows), goals, total_tokens=10_000), goals).collect()}
    assert fixed[("m", "tiny")].tokens == 120 and abs(fixed[("m", "big_source")].tokens - 6000) <= 60
    assert draw(docs(spark, []), goals).count() == 0


@pytest.mark.parametrize(("text", "kind"), [
    ("Title: {{ name | default }}\nSteps: XXXX", "blank"), ("Hello [DATE HERE],", "blank"), ("your restore of <date> has finished.", "blank"), ("## TODO: add version", "blank"), ("Fixes $TICKET$ in a.ts.", "blank"),
    ("Dear null, the review of a.ts by undefined is waiting.", "absent"), ("Score: NaN. Reason: [object Object]", "absent"), ("Lorem ipsum dolor sit amet.", "filler"), ("Sample text. Sample text. Sample text.", "filler"), ("asdf qwer foo bar test blah jkl", "filler"),
    ("Please enable JavaScript to view the panel viewer.", "script"), ("Checking your browser before opening x.example.", "script"), ("404 Not Found", "error"), ("This snapshot could not be loaded. Reference: 8374a129d59c", "error"), ("Votre session a expiré, reconnectez-vous à x.example.", "error"),
])
def test_residue_is_seen(text, kind):
    assert kind in evidence(text) and kind in evidence("A note on how the plank and the column filter one another.\n\n" + text)


@pytest.mark.parametrize("text", [
    "The page not found handler moved to src/a.ts and now logs the missing trigger.", "When the server answers with 404 or 503, `x` waits 36 seconds and tries once more.", "The form writes `{{channel}}` and the renderer fills it from the map before saving.", "```js\nrender('{{silo}}', shift);\n```",
    'Users reported that "access denied" appears after 32 restores; the lock was never released.', "`undefined` is stored as null, so the filter must test for both.", "", "ok", "n/a", "Fixed the 404 on the shift page.", "We replaced the TODO in a with a real check and removed the placeholder icon.", "Generic List<String> of <b>bold</b> text, 5 < 6.",
])
def test_speaking_of_residue_is_none(text):
    assert evidence(text) == set()


def test_operator(spark):
    rows = [(1, "A real note about the tunnel.", "Wiki-Pages "), (2, None, "wiki_pages"), (3, "", None), (4, "Access denied.\n", None), (5, "404 Not Found", "wiki_pages"), (6, "404 Not Found", "wiki_pages")]
    foot = "Please enable JavaScript to view comments."
    rows += [(100 + i, f"A real note, number {i}, on its own topic.\n{foot}", "site") for i in range(30)] + [(200, "Your session has expired.\n" + foot, "site")]
    got = {r.doc_id: r.kinds for r in residue(docs(spark, rows)).collect()}
    assert set(got) == {4, 5, 6, 200} and got[200] == ["error"]
    assert residue(docs(spark, [])).count() == 0


def test_recurrent_fences_still_enclose_code(spark):
    block = "```py\n{}\n```"
    rows = [(i, f"Note {'abcdefghijklmnopqrstuvwxyz'[i]} on a topic.\n" + block.format("x = 1").replace("py", "py" if i % 2 else "ts"), "site") for i in range(26)]
    rows += [(100, f"One.\n{block.format('a()')}\nThis page could not be found.\n{block.format('b()')}\nEnd.", "site"), (101, f"Two.\n{block.format('a()')}\nThen:\n{block.format('Hello {{ name }}')}\nEnd.", "site")]
    assert {r.doc_id: r.kinds for r in residue(docs(spark, rows)).collect()} == {100: ["error"]}


def sample(items, rng):
    """A string that the parsed pattern may match, each alternative by chance."""
    out = ""
    for op, arg in items:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op is K.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], max(arg[0], min(arg[1], arg[0] + 1)))))
        elif op is K.IN:
            kind, a = rng.choice(arg)
            out += chr(a if kind is K.LITERAL else rng.randint(*a)) if kind in (K.LITERAL, K.RANGE) else "7" if a is K.CATEGORY_DIGIT else " " if a is K.CATEGORY_SPACE else "7" if kind is K.NEGATE else "q"
        elif op in (K.ANY, K.NOT_LITERAL):
            out += rng.choice(" q")
    return out


@pytest.mark.parametrize("pattern", [*R.ERROR, *R.SCRIPT, *R.FILLER, *R.ABSENT, *R.BLANK])
def test_each_alternative_hits_a_trigger(pattern):
    rng, trigger, seen = random.Random(3), R._trigger(frozenset()), 0
    for _ in range(600):
        if re.search(pattern, text := sample(_parser.parse(pattern), rng)):
            seen += 1
            assert next(trigger.iter(text.lower()), None) is not None, text
    assert seen


@pytest.mark.parametrize("text", ["This page failed to load.", "The file failed to open.", "http: 404", "Ray: 0123abcd", "This is example content.", "Faux texte."])
def test_evidence_that_had_no_trigger(text):
    assert evidence(text) and evidence("A note on the plank.\n" + text)


def test_filler_of_short_words_only():
    words = frozenset({"amet", "elit", "sed", "quis", "nisi", "enim"})
    assert evidence("Amet elit sed, quis nisi enim.", words, R._trigger(words)) == {"filler"}


@pytest.mark.parametrize("text", ["Something went wrong in the renderer.", "This page could not be found, for it was never released.", "An error occurred while saving the list of names.", "This page could not be found; it may have moved to another address."])
def test_phrases_do_not_hide_notices(text):
    assert evidence(text) == {"error"}


def test_wording_is_learnt_where_it_recurs(spark):
    """A notice of unseen wording, on error pages of many hosts, is evidence where it stands alone; prose beside it is not."""
    odd = "The gremlins ate this bit of the internet again."
    rows = [(i, f"A note on the tunnel, number {i}, in some words of its own.\n404 Not Found\n{odd}\nIt is kept with the others of the week.", f"host{i % 4}") for i in range(12)]
    rows += [(100 + i, f"Another note about topic {i}.\nIt is kept with the others of the week.", f"host{i % 4}") for i in range(8)]
    rows += [(200, f"Some heading\n{odd}", "host9"), (201, f"Some heading, and `{odd}`", "host9"), (202, f"```\n{odd}\n```", "host9")]
    assert {r.doc_id for r in residue(docs(spark, rows)).collect()} == {*range(12), 200}
    assert {r.doc_id for r in residue(docs(spark, rows), learn=False).collect()} == set(range(12))


def test_recurrent_lines_are_counted_by_host(spark):
    foot = "Please enable JavaScript to view comments."
    rows = [(i, f"A real note, number {i}.\n\n{foot}", "a") for i in range(30)] + [(100 + i, f"Other {i}\n{foot}", f"b{i}") for i in range(3)] + [(200 + i, "Twice the same.\n" + foot, "c") for i in range(40)]
    assert {r.doc_id for r in residue(docs(spark, rows)).collect()} == {100, 101, 102, *range(200, 240)}  # copies count once
    assert len(residue(docs(spark, rows), min_docs=10**6).collect()) == 73


@pytest.mark.parametrize(("text", "kind"), [  # wordings found in no table
    ("That document isn't available any more.", "error"), ("HTTP 502 Bad Gateway", "error"), ("The server crashed, incident 83fa20c1.", "error"), ("An unknown error occurred.", "error"), ("You don't have access to this area.", "error"),
    ("Our website needs JavaScript.", "script"), ("Scripting is turned off.", "script"), ("[insert your address here]", "blank"), ("Dummy text goes here until launch", "filler"), ("Hi null, thanks for your order.", "absent"),
])
def test_other_wordings(text, kind):
    assert kind in evidence(text)


def test_draws_do_not_depend_on_tasks(spark, monkeypatch):
    import stratalog.llm.mixing as m

    monkeypatch.setattr(m, "LEAF", 50)
    monkeypatch.setattr(m, "FAN", 3)
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * (900 if i % 97 == 0 else rng.randrange(1, 60))), "a" if i % 3 else "b") for i in range(900)]
    goals = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], "mix_id string, source string, target_share double, max_repeats int")
    one, two = ({(r.doc_id, r.copies) for r in draw(docs(spark, rows).repartition(n), goals, total_tokens=20_000).collect()} for n in (1, 7))
    assert one == two
    assert all(abs(r.actual_share - 0.5) < 0.02 for r in shares(draw(docs(spark, rows), goals, total_tokens=20_000), goals).collect())


def test_long_texts_are_counted_exactly(monkeypatch):
    import stratalog.llm.tokens as t

    coder = encoder(vocabulary_path())
    rng = random.Random(2)
    for piece in (1, 7, 50):
        monkeypatch.setattr(t, "_PIECE", piece)
        for _ in range(60):
            text = "".join(rng.choice(["a", " ", "  ", "\n", " \t", "don't", "1234", "::", "é", " x", "word", "\u3000"]) for _ in range(rng.randrange(0, 200)))
            assert count(coder, text) == len(coder.encode_ordinary(text))
