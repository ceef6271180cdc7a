"""Labels of edited notices, and chains against all chains."""

import itertools
import random

import pytest

from tallyfin.llm import licences


@pytest.fixture(scope="module")
def scanner():
    return licences.Scanner()


def test_labels_of_notices_edited_at_one_to_three_places(scanner):
    """Every notice of forty words or more keeps its label when words are replaced, inserted or removed at places apart from each other."""
    rng, notices = random.Random(1), 0
    for label, texts in licences.TEMPLATES.items():
        for text in texts:
            notices += 1
            assert label in scanner.scan("x " + text + " y")[5].split(",")
            words = [w.decode() for w in licences.words_of(text)]
            for k in (1, 2, 3) if len(words) >= 40 else ():
                for _ in range(6):
                    edited = list(words)
                    for at in sorted(rng.sample(range(4, len(words) - 4, 8), k), reverse=True):
                        edited[at : at + rng.randrange(2)] = rng.choice([[], ["zzz"], ["some", "more", "words"]])
                    assert label in scanner.scan("before " * 5 + " ".join(edited) + " after" * 3)[5].split(","), (label, edited)
    assert notices >= 30 and len(scanner.sizes) == notices


def test_a_notice_with_a_word_replaced_and_one_inserted(scanner):
    text = licences.TEMPLATES["bsd"][0].replace("binary forms", "binary shapes", 1).replace("must retain", "must always retain")
    *_, labels, score, spans = scanner.scan(text)
    assert labels == "bsd" and 0.9 < score < 1 and len(spans) == 1 and spans[0]["first_word"] == 0


def test_several_notices_of_a_kind_and_ordinary_words(scanner):
    text = licences.TEMPLATES["bsd"][0]
    spans = scanner.scan(f"{text} {'other words here ' * 10} {text}")[7]
    assert [s["label"] for s in spans] == ["bsd", "bsd"] and spans[0]["end_word"] <= spans[1]["first_word"] and {s["cover"] for s in spans} == {1.0}
    half = " ".join(text.split()[:30])
    assert scanner.scan(half)[5] == "" and scanner.scan("the license of the software is provided in the hope that it will be useful")[5] == ""


def test_of_notices_that_differ_in_a_word_one_stands(scanner):
    for label in ("cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"):
        assert scanner.scan(licences.TEMPLATES[label][0])[5] == label
    assert scanner.scan(licences.TEMPLATES["bsd"][-1])[5] == "bsd" and scanner.scan(licences.TEMPLATES["mit"][-1])[5] == "mit"


def test_a_match_hidden_by_a_longer_one_of_another_template(scanner):
    """Words that one template continues further than another still count for the other."""
    words = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    assert "gpl" in scanner.scan(words)[5].split(",")


def brute_chain(matches, size):
    best = 0
    for n in range(1, len(matches) + 1):
        for c in itertools.combinations(sorted(matches), n):
            if all(x[0] < y[0] and x[2] < y[2] and x[1] < y[1] and x[2] + x[1] - x[0] < y[2] + y[1] - y[0] and y[0] <= x[1] + size for x, y in zip(c, c[1:])):
                best = max(best, sum(e - s for s, e, _ in c) - sum(max(0, x[1] - y[0], x[2] + x[1] - x[0] - y[2]) for x, y in zip(c, c[1:])))
    return best


def test_chains_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randrange(8, 30)
        matches = list({(s := rng.randrange(size), s + (n := rng.randrange(2, 7)), rng.randrange(max(1, size - n))) for _ in range(rng.randrange(1, 9))})
        found = licences.chains(matches, size, 1)
        assert found[0][0] == brute_chain(matches, size)
        for (_, a, b), (_, c, d) in itertools.combinations(found, 2):
            assert b <= c or d <= a
    assert licences.chains([], 5, 1) == []
