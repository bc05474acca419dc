import random

from helpers import docs

from landstrata.llm import licenses

FULL = dict((t, n) for n, t in licenses.TEMPLATES)


def run(spark, rows):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["license"], r["start"], r["end"], r["differing"])
                  for r in licenses.scan(docs(spark, rows, "license string, start int")).collect())


def test_every_template_is_found_in_prose(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choices("river wall stone mill north old é the and of".split(), k=80)) for _ in range(40)]
    rows, want = [], []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        body = f"{prose[i]}\n{text}\n{prose[-1 - i]}"
        rows.append((i, body))
        start = body.index(text)
        want.append((i, name, start, start + len(text.rstrip(".:,")), 0))
    assert run(spark, rows) == want


def test_wording_differences(spark):
    apache = licenses.TEMPLATES[3][1]
    rows = [(1, apache.replace("may not", "can not")), (2, "Licensed under the Apache License, Version 3.0."), (3, apache.replace("2.0", "9.9")),
            (4, "A license to thrill: the copyright of this licence talk is ours."), (5, apache.upper().replace(" ", "%%% "))]
    got = run(spark, rows)
    assert [(d, n, e) for d, n, _, _, e in got] == [(1, "Apache-2.0", 1), (5, "Apache-2.0", 0)]


def test_several_licenses_nulls_repeats_long(spark):
    two = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    rows = [(1, two), (1, two), (None, two), (2, None), (3, ""), (4, "x " * 100_000 + two), (5, "license " * 3000)]
    got = run(spark, rows)
    assert [(d, n) for d, n, *_ in got] == sorted([(i, n) for i in (-1, 1, 1, 4) for n in ("CC-BY-NC-4.0", "MIT")])


def test_a_notice_inside_long_blocks():
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.15)
    vocabulary = ["w" + "".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    for size in (1000, 5000, 20_000, 100_000):
        for name, notice in licenses.TEMPLATES:
            words = rng.choices(vocabulary, k=size)
            words[::60] = ["copyright"] * len(words[::60])
            at = rng.randrange(size)
            before = " ".join(words[:at])
            text = f"{before}\n{notice}\n{' '.join(words[at:])}"
            assert len(licenses.blocks(text, scanner.longest)) == 1
            got = [(n, e, s, t) for n, _, e, _, s, t in scanner(text)]
            assert got == [(name, 0, len(before) + 1, len(before) + 1 + len(notice.rstrip(".:,")))], (size, notice)


def test_a_notice_at_every_place_of_a_piece_and_several_at_once():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.15)
    notice = licenses.TEMPLATES[1][1]
    for at in range(0, 2 * licenses.PIECE * scanner.reach, 7):
        words = ["copyright" if i % 50 == 0 else f"w{i}" for i in range(1500)]
        text = " ".join([*words[:at], notice, *words[at:]])
        assert [(n, e) for n, _, e, *_ in scanner(text)] == [("MIT", 0)], at
    text = " license ".join([t for _, t in licenses.TEMPLATES] * 5)
    assert sorted(n for n, *_ in scanner(text)) == sorted([n for n, _ in licenses.TEMPLATES] * 5)


def test_another_version_does_not_hide_a_notice():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.15)
    other = "Licensed under the Apache License, Version 3.0. "
    assert [n for n, *_ in scanner(other + "Licensed under the Apache License, Version 2.0.")] == ["Apache-2.0"]
    assert [n for n, *_ in scanner(other + "x " * 20 + "Licensed under the Apache Licence, Version 2.0.")] == ["Apache-2.0"]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_differences_equal_a_full_table():
    def plain(t, b):
        best = None
        for s in range(len(b) + 1):
            for e in range(s, len(b) + 1):
                d = [list(range(e - s + 1))]
                for i, w in enumerate(t, 1):
                    d.append([i])
                    for j in range(1, e - s + 1):
                        d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (w != b[s + j - 1])))
                best = min(best if best is not None else 10**9, d[-1][-1])
        return best

    rng = random.Random(4)
    for _ in range(150):
        t, b = rng.choices("abc", k=rng.randint(1, 5)), rng.choices("abcd", k=rng.randint(1, 8))
        cost, s, e = licenses.differences(t, b)
        assert cost == plain(t, b) and 0 <= s <= e <= len(b)
