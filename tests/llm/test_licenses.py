"""Every place that holds a license is found."""

from tessella.llm.licenses import TEMPLATES, Templates

KNOWN = Templates(TEMPLATES, 0.8)


def places(text: str, name: str) -> list:
    return [(m[1], m[2], m[3]) for m in KNOWN.scan(text.encode()) if m[0] == name]


def test_neighbouring_copies_are_all_found():
    grant, notice = TEMPLATES["MIT-grant"], TEMPLATES["MIT-notice"]
    for k in (2, 20):
        assert [n for *_, n in places(" Copyright (c) 2020 Some Body. ".join([grant] * k), "MIT-grant")] == [87] * k
    assert places(f"{notice} {notice}", "MIT-notice") == [(0, 30, 5), (32, 62, 5)]


def test_many_words_may_stand_between():
    text = "Licensed under the terms and the conditions of the well known Apache License, in its Version 2.0."
    assert places(text, "Apache-2.0-notice") == [(0, len(text) - 1, 8)]
    assert places("Released under " + "of some such kind " * 40 + "the MIT License.", "MIT-notice")


def test_too_few_words_are_no_place():
    assert not places("Released under the other terms.", "MIT-notice") and not places("License MIT the under released", "MIT-notice")
