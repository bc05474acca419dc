import random
import re

import numpy as np
import pyarrow as pa
from helpers import docs

from landstrata.llm import _text, decontam

TOM = "Tom has 5 apples and buys 12 more at the market for 3 dollars each. How many apples does Tom have after he eats 5 of them?"
SHORT = "What is 7 km in miles?"
PROSE = "the river runs along the old wall and turns to the north where a mill stood for many years before the flood came"


def run(spark, rows, items, **more):
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, hash int, place string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs(spark, rows, "hash int, place string, slots string, item_id int"), table, **more).collect()}


def words_of(text):
    """Template words by plain Python."""
    out = []
    pattern = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+", re.A) if text.isascii() else re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
    previous_number = False
    for m in pattern.finditer(text):
        w = m[0]
        before = text[: m.start()].rstrip(" ")
        opening = not before or before[-1] in ".!?:;\n\"("
        if w[0].isdigit():
            kind = 1
        elif previous_number and w.lower() in decontam.UNITS:
            kind = 2
        elif w[0].isupper() and not opening:
            kind = 3
        else:
            kind = 0
        out.append((kind, w.lower()))
        previous_number = kind == 1
    return out


def test_template_words():
    for text in (TOM, SHORT, PROSE, "5kg of x2 and 3.14, or 1,000.5 m. Élan Étoile (Paris) \"Rome", "A1B2 CC 7 Km 8km", ""):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, kind, start, end, row, literal = decontam.template(data, np.array([0, len(data)]))
        got = [(int(k), text.encode()[s:e].decode().lower()) for k, s, e in zip(kind, start, end)]
        assert got == words_of(text), text


def test_exact_and_asked_anew(spark):
    anew = TOM.replace("Tom", "Ann").replace("12", "40").replace("5", "9").replace("dollars", "euros")
    mixed = TOM.replace("Tom has", "Bob has").replace("Tom have", "Eve have").replace("eats 5", "eats 6")
    rows = [(1, f"{PROSE}. {TOM} {PROSE}"), (2, f"{PROSE}\n{anew}\n{PROSE}"), (3, PROSE * 3), (4, mixed), (5, TOM.upper().replace(" ", "*** ")), (6, SHORT),
            (7, f"so {SHORT.replace('7', '9.5')}"), (8, TOM[:40]), (9, None), (10, ""), (None, TOM), (12, (TOM + "\n") * 50)]
    got = run(spark, rows, [(1, TOM), (2, SHORT), (3, None), (4, ""), (1, TOM), (None, "another question that nobody has asked so far in any text at all")])
    found = {d for d, i in got if i == 1}
    assert {1, 2, None, 12} <= found and not found & {3, 6, 7, 8, 9, 10}
    assert {d for d, i in got if i == 2} == {6, 7}
    assert got[1, 1]["changed"] == 0 and got[2, 1]["changed"] == 4 and got[12, 1]["windows"] == got[1, 1]["windows"]


def test_inconsistent_slots_are_not_the_same_question(spark):
    item = "Tom gave Sue 3 pears and then Sue gave Tom 4 pears back so that in the end Tom and Sue had 3 and 4 pears"
    values = iter(range(50, 90))
    broken = re.sub(r"\d", lambda m: str(next(values)), item)
    names = iter("Ann Bob Cat Dan Eve Fay Gus Hal Ida Jon".split())
    broken = re.sub(r"Tom|Sue", lambda m: next(names), broken)
    twin = item.replace("Tom", "Max").replace("Sue", "Zoe").replace("3", "8").replace("4", "6")
    got = run(spark, [(1, "So " + broken), (2, "So " + twin)], [(1, item)])
    assert got.keys() == {(2, 1)}


SUM = "What is 17 plus 25 times 3?"


def test_variants_of_one_item_in_one_document(spark):
    first, second = "What is 12 plus 31 times 4?", "What is 80 plus 99 times 5?"
    many = " ".join(f"What is {i} plus {i + 7} times {i + 3}?" for i in range(40, 90))
    anew = TOM.replace("Tom", "Ann").replace("12", "40").replace("5", "9")
    other = TOM.replace("Tom", "Bob").replace("12", "71").replace("5", "2")
    inserted = [x.replace("at the market", "at the old market") for x in (anew, other)]
    rows = [(1, f"{SUM} {first}"), (2, f"{first} {second}"), (3, f"{many} {SUM} {many}"), (4, many), (5, f"{anew}\n{PROSE}.\n{other}"),
            (6, f"{anew}\n{TOM}\n{other}"), (7, f"{inserted[0]}\n{PROSE}\n{inserted[1]}"), (8, first), (8, second), (9, "What is plus times?")]
    got = run(spark, rows, [(1, SUM), (2, TOM)])
    assert {d for d, i in got if i == 1} == {1, 2, 3, 4, 8} and {d for d, i in got if i == 2} == {5, 6, 7}
    assert got[1, 1]["changed"] == got[3, 1]["changed"] == got[6, 2]["changed"] == 0 and got[2, 1]["changed"] == 3 and got[5, 2]["matched"] == got[5, 2]["windows"]


MARIA = "Maria has 5 apples. Maria buys 12 more apples. Maria then gives 3 apples away. How many apples does Maria have now?"


def test_names_that_open_sentences(spark):
    anna = MARIA.replace("Maria", "Anna").replace("12", "15")
    mixed = "Anna has 5 apples. Eve buys 12 more apples. Zoe then gives 3 apples away. How many apples does Kim have now?"
    got = run(spark, [(1, anna), (2, f"{PROSE}. {anna}"), (3, "Ann runs 9 km daily"), (4, PROSE), (5, mixed), (6, "So Ann runs 9 km daily")], [(1, MARIA), (2, "Tom runs 5 km daily")])
    assert got.keys() == {(1, 1), (2, 1), (3, 2), (6, 2)}
    assert got[1, 1]["matched"] == got[1, 1]["windows"] and got[1, 1]["changed"] == 2


def test_copies_in_small_letters_and_capitals(spark):
    rows = [(i, f"{PROSE} {x}") for i, x in enumerate([MARIA.lower(), MARIA.upper(), TOM.lower(), TOM.upper(), MARIA.lower().replace("12", "15")])]
    got = run(spark, rows, [(1, MARIA), (2, TOM)])
    assert got.keys() == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 1)} and all(r["matched"] == r["windows"] for r in got.values())
    assert got[0, 1]["changed"] == 0 and got[4, 1]["changed"] == 1


def test_equals_brute_force_on_prose(spark):
    rng = random.Random(2)
    words = "the of and in was on that river stone wall mill 12 7 km Paris".split()
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 7, 8, 9, 20, 30])))) for i in range(25)]
    rows = []
    for d in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        if rng.random() < 0.5:
            text += " " + rng.choice(items)[1]
        rows.append((d, text))
    got = {k for k in run(spark, rows, items, width=8)}

    def windows(ws, n):
        return [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]

    def same_template(a, b):
        first = a[0][1] == b[0][1] and a[0][0] == 0 and b[0][0] == 3  # an item's first word inside a sentence
        return all(x[0] == y[0] and (x[0] or x[1] == y[1]) or (first and i == 0) for i, (x, y) in enumerate(zip(a, b)))

    certain = set()
    for d, t in rows:
        for i, q in items:
            qw = words_of(q)
            n = min(8, len(qw))
            asked = windows(qw, n)
            exact = sum(any(w == x for x in windows(words_of(t), n)) for w in asked)
            loose = sum(any(same_template(w, x) for x in windows(words_of(t), n)) for w in asked)
            if loose < 0.5 * len(asked):
                assert (d, i) not in got
            elif exact == len(asked) == loose and not any(k for k, _ in qw):
                certain.add((d, i))
    assert certain <= got and len(got) > 15


def test_empty_tables(spark):
    assert run(spark, [], [(1, TOM)]) == {} and run(spark, [(1, TOM)], []) == {}


def test_windows_do_not_depend_on_the_slice(monkeypatch):
    monkeypatch.setattr(_text, "SLICE", 64)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([TOM, SHORT, TOM])], ["doc_id", "text"])
    small = sorted((r for b in decontam._window_rows(1, [8], None, None)([batch]) for r in b.to_pylist()), key=str)
    monkeypatch.setattr(_text, "SLICE", 1 << 20)
    assert small == sorted((r for b in decontam._window_rows(1, [8], None, None)([batch]) for r in b.to_pylist()), key=str)


NOUNS = ("apple pear lamp chair wheel brick shell stone candle carpet bottle ribbon basket ladder button hammer kettle mirror pillow saddle "
         "anchor barrel blanket bucket cabinet").split()
VERBS = "buys sells paints counts moves stacks cleans borrows gathers throws carries wraps".split()
PLACES = "market harbour station garden library bakery workshop museum stable office".split()
ONE_NAME, OTHER_NAME = "Maria Tom Anna Peter Lucy Omar".split(), ["Mary Ann", "Jean Luc Picard", "Otto", "Rosa Maria Lopez", "Li Wei", "Karim"]
SPELT = "two three four five six seven eight nine ten eleven twelve".split()


def asked(rng, number=str, unit="miles", name="Maria", opens=False):
    a, b, c = rng.choices(NOUNS, k=3)
    there, verb, again = rng.choice(PLACES), rng.choice(VERBS), rng.choice(VERBS)
    start = name if opens else f"At the {there} today {name}"
    return (f"{start} {verb} {number(0)} {a}s and a {b} that lie {number(1)} {unit} from the {c}. Later {name} {again} {number(2)} more. "
            f"How many {unit} does {name} walk with the {a}s and the {b}?")


def other_question(rng):
    """As many numbers, names and units in another wording; ``asked`` with other nouns shares up to half of its windows."""
    a, b = rng.choices(NOUNS, k=2)
    n = [rng.choice([str(rng.randint(2, 90)), rng.choice(SPELT)]) for _ in range(3)]
    return (f"After {n[0]} hours {rng.choice(ONE_NAME)} and {rng.choice(OTHER_NAME)} reach the {rng.choice(PLACES)}, {n[1]} miles away. There he "
            f"{rng.choice(VERBS)} a {a} for {n[2]} dollars while she {rng.choice(VERBS)} the {b}s. Who of them has more {b}s than {rng.choice(ONE_NAME)}?")


def test_recall_for_each_kind_of_change(spark):
    """Fifty questions a kind, asked anew in a longer text: at least nine of ten are found, and nothing in other questions' texts."""
    def digits(rng):
        values = rng.sample(range(2, 90), 3)
        return lambda i: str(values[i])

    def spelt(rng):
        values = rng.sample(SPELT, 3)
        return lambda i: values[i]

    def spelt_in_two(rng):
        values = [f"{t}{rng.choice(' -')}{u}" for t, u in zip(rng.sample("twenty thirty forty fifty".split(), 3), rng.sample(SPELT[:6], 3))]
        return lambda i: values[i]

    kinds = {  # how the item is asked, and how it is asked anew
        "number": (dict(number=digits), dict(number=digits)),
        "number word": (dict(number=spelt), dict(number=spelt)),
        "number word for digits": (dict(number=digits), dict(number=spelt_in_two)),
        "unit": (dict(unit="miles"), dict(unit="kilometers")),
        "unit and number word": (dict(number=spelt, unit="yards"), dict(number=spelt, unit="feet")),
        "name of other length": (dict(name=ONE_NAME), dict(name=OTHER_NAME)),
        "opening name": (dict(name=ONE_NAME, opens=True), dict(name=OTHER_NAME, opens=True, number=digits)),
        "small letters": ({}, {}),
    }
    items, rows, clean, of = [], [], [], {}
    for k, (kind, ways) in enumerate(kinds.items()):
        for i in range(50):
            pair = []
            for at, way in enumerate(ways):
                values = random.Random(f"{k}:{i}:{at}:values")
                way = {a: (v(values) if a == "number" else values.choice(v) if a == "name" else v) for a, v in way.items()}
                way.setdefault("number", digits(random.Random(f"{k}:{i}")))
                pair.append(asked(random.Random(f"{k}:{i}:words"), **way))
            key = k * 1000 + i
            items.append((key, pair[0]))
            rows.append((key, f"{PROSE}. {pair[1].lower() if kind == 'small letters' else pair[1]} {PROSE}."))
            of[key] = kind
            other = random.Random(f"{k}:{i}:clean")
            clean.append((10**6 + key, f"{PROSE}. {other_question(other)} {PROSE}."))
    got = run(spark, rows + clean, items)
    share = {kind: sum((key, key) in got for key, x in of.items() if x == kind) / 50 for kind in kinds}
    assert min(share.values()) >= 0.9, share
    assert not [pair for pair in got if pair[0] >= 10**6]


def test_looser_words():
    def loose(text, opening=False):
        data = np.frombuffer(text.encode(), np.uint8)
        _, kind, start, end, _, place, _ = decontam._loose(data, decontam._template(data, np.array([0, len(data)])), opening)
        return [(int(k), text.encode()[s:e].decode(), int(p)) for k, s, e, p in zip(kind, start, end, place)]

    assert loose("Now twenty-five miles, five km") == [(0, "Now", 0), (1, "twenty-five", 1), (2, "miles", 3), (1, "five", 4), (2, "km", 5)]
    assert loose("so Mary Ann Lee Fox saw him in May")[1:] == [(3, "Mary Ann Lee", 1), (3, "Fox", 4), (0, "saw", 5), (4, "him", 6), (0, "in", 7), (3, "May", 8)]
    assert loose("Jean Luc ran. Ann ran", True) == [(3, "Jean Luc", 0), (0, "ran", 2), (3, "Ann", 3), (0, "ran", 4)]
    assert loose("Jean Luc ran")[:2] == [(0, "Jean", 0), (3, "Luc", 1)] and loose("") == []
