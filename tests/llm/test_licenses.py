"""License scan: every window against every template, edits, edge cases."""

import random
import time

import numpy as np
import pytest

from chronowatt.llm import licenses
from chronowatt.llm.common import mix

SF = "/root/testdata/sf0.01"
FILLER = "some ordinary words stand here and say nothing of any terms at all really ".split()


def filler(n, shift=0):
    return " ".join(f"{FILLER[(i + shift) % len(FILLER)]}{(i * 7 + shift) % 13}" for i in range(n))


def plain(text):
    """All windows of a text against all templates: minima over whole windows, then containment."""
    scanner, own, found = licenses.Scanner(licenses.TEMPLATES), licenses.shingles(text), set()
    for number, part in enumerate(scanner.shingles):
        size = scanner.length[number]
        minima = [mix(part ^ seed).min() for seed in licenses._SEEDS]
        for window in range(0, max(1, len(own)), size):
            inside = own[window : window + 2 * size - 1]
            if len(inside) and any(mix(inside ^ seed).min() == least for seed, least in zip(licenses._SEEDS, minima)):
                if len(np.intersect1d(inside, part)) / len(part) >= licenses.CONTAINMENT:
                    found.add(scanner.names[number])
    return found


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
@pytest.mark.parametrize("before", [0, 1, 7, 200])
def test_whole_template_anywhere(name, before):
    text = f"{filler(before)} {licenses.TEMPLATES[name]} {filler(90, 3)}"
    matches = {m[0]: m for m in licenses.Scanner(licenses.TEMPLATES).scan(text)}
    assert name in matches
    got = matches[name]
    words = licenses.words_of(licenses.TEMPLATES[name])
    assert got[3] == 1.0
    assert words in " ".join(licenses.words_of(text).split(" ")[got[1] : got[1] + got[2]])
    assert set(matches) == plain(text)


def test_one_edited_word_in_a_long_template_is_met_and_two_copies_are_two_matches():
    words = licenses.TEMPLATES["MIT permission"].split()
    words[40] = "changed"
    text = f"{' '.join(words)} {filler(300)} {licenses.TEMPLATES['MIT permission']}"
    got = [m for m in licenses.Scanner(licenses.TEMPLATES).scan(text) if m[0] == "MIT permission"]
    assert [m[3] < 1 for m in got] == [True, False]


def test_part_of_a_template_is_no_match():
    words = licenses.TEMPLATES["MIT permission"].split()
    assert not licenses.Scanner(licenses.TEMPLATES).scan(" ".join(words[:40]) + " " + filler(50))
    assert not licenses.Scanner(licenses.TEMPLATES).scan(filler(5_000))


def test_collision_probability_as_stated():
    for share, least in ((1.0, 1 - 1e-9), (0.8, 0.999999)):
        similarity = share / (2 + (1 - share))
        assert 1 - (1 - similarity) ** licenses.BANDS >= least


def held(text, template):
    """Word by word, without the module: the largest share of a template's five-word runs in a stretch of twice its
    length."""
    runs = lambda words: [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    plain_ = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    own, there = runs(plain_(template)), runs(plain_(text))
    best = max((len(set(own) & set(there[i : i + 2 * len(own)])) for i in range(max(1, len(there)))), default=0)
    return best / len(set(own))


@pytest.mark.parametrize("seed", range(6))
def test_notices_between_words_equal_plain_search(seed):
    """Notices in random places, some altered: those held to the share are found, no others."""
    rnd = random.Random(seed)
    names = list(licenses.TEMPLATES)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    parts = []
    for name in rnd.sample(names, 6):
        words = licenses.TEMPLATES[name].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "altered"
        parts += [filler(rnd.randrange(3, 60), rnd.randrange(9)), " ".join(words)]
    text = " ".join(parts)
    found = {m[0]: m[3] for m in scanner.scan(text)}
    for name in names:
        best = held(text, licenses.TEMPLATES[name])
        assert (name in found) == (best >= licenses.CONTAINMENT), (name, best)


def test_altered_notices_take_time_in_proportion():
    words = licenses.words_of(licenses.TEMPLATES["ISC permission"]).split()
    copies = [" ".join([*words[:9], f"changed{i}", *words[10:]]) for i in range(30_000)]
    scanner, seconds = licenses.Scanner(licenses.TEMPLATES), []
    for n in (3_000, 30_000):
        started = time.time()
        assert len(scanner.scan(" ".join(copies[:n]))) >= 1
        seconds.append(time.time() - started)
    # about a million words
    assert seconds[1] < 30 and seconds[1] < 25 * max(seconds[0], 0.1)


def test_usual_wordings_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for text in ("Licensed under the MIT License", "licensed under the GNU GPL version 2.", "// SPDX-License-Identifier: Apache-2.0"):
        assert scanner.scan(f"{filler(20)} {text} {filler(20)}"), text


def test_clashing_columns_are_refused(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, template string")
    with pytest.raises(ValueError, match="template"):
        licenses.scan(docs, keep=("doc_id", "template"))


def test_short_template_is_refused():
    with pytest.raises(ValueError):
        licenses.Scanner({"short": "only four words here"})


def test_query_finds_every_notice_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = licenses.op8_license_scan(spark, SF).toPandas()
    found = set(zip(got["doc_id"], got["template"]))
    notices = {n: licenses.words_of(t) for n, t in licenses.TEMPLATES.items() if n.endswith("notice")}
    want = {(r.doc_id, n) for r in docs.itertuples() for n, t in notices.items() if f" {t} " in f" {licenses.words_of(r.text)} "}
    assert want and want <= found
    assert {(i, n) for i, n in found if n.endswith("notice")} == want


def test_odd_rows(spark):
    note = licenses.TEMPLATES["MIT notice"]
    rows = [(1, None, "c"), (2, "", "c"), (3, "one two", "c"), (None, note, "c"), (4, f"{filler(60_000)} {note}", "c"), (5, note, "c"), (5, note, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, template string")
    got = licenses.scan(docs).toPandas()
    assert sorted(got["doc_id"].fillna(-1)) == [-1, 4, 5, 5]
    assert set(got["template"]) == {"MIT notice"}
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("inserted", [8, 12, 20])
def test_stretched_copies_are_found_at_every_alignment(inserted):
    name = "ISC permission"
    words = licenses.words_of(licenses.TEMPLATES[name]).split(" ")
    half, own = len(words) // 2, set(licenses.shingles(licenses.TEMPLATES[name]).tolist())
    scanner, size = licenses.Scanner({name: licenses.TEMPLATES[name]}), len(words) - 4
    for before in range(size):
        extra = [f"extra{i}" for i in range(inserted)]
        text = " ".join([f"a{i}" for i in range(before)] + words[:half] + extra + words[half:] + [f"z{i}" for i in range(70)])
        held = licenses.shingles(text).tolist()
        # brute force: the best stretch of twice the template's length
        best = max(len(own & set(held[i : i + 2 * size])) for i in range(len(held))) / len(own)
        assert best >= licenses.CONTAINMENT
        assert scanner.scan(text) == [(name, before, len(words) + inserted, pytest.approx(best))]
