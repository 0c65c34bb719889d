"""Each invented form that the regions of the field have to take in whole."""

from __future__ import annotations

import pytest

from timbral.llm import pii


@pytest.mark.parametrize(
    "kind, form",
    [
        ("card", "1234 - 5678 - 9012 - 3452"), ("card", "1234.5678.9012.3452"), ("card", "1234 5678 9012 3452"), ("card", "1234-5678-9012-3452"), ("card", "1234567890123452"),
        ("email", "name [at] host [dot] com"), ("email", "hanna at mail dot com"), ("email", "hanna at mail dot example dot org"),
        ("email", "hanna At mail Dot com"), ("email", "hanna AT mail DOT com"), ("email", "hanna(At)mail.net"), ("email", "hanna(at)mail.net"), ("email", "ha.nna@mail.example.org"),
    ],
)
def test_form(kind, form):
    for before, after in (("dorab ", " suna"), ("bot ", ". ohas"), ("", "")):
        text = before + form + after
        assert (kind, len(before), len(before) + len(form)) in pii.find(text)[1], (text, pii.find(text)[1])


def test_regions_end():
    """Prose around a number is no part of its region, and regions don't overlap."""
    form = "name (At) host (Dot) example (dot) com"
    assert [form[a:b] for a, b in pii.regions(form)] == [form]
    text = "call me at 555-1234 at home or write to x at y dot z at noon"
    got = list(pii.regions(text))
    assert [text[a:b] for a, b in got] == ["555-1234", "x at y dot z"]


def test_long_lists_are_whole():
    """Every number of a list longer than any part that is scored at a time, with and without blanks."""
    for number, mark in (("(555) 123-4567", ", "), ("+1 (555) 123-4567", ", "), ("(555) 123-4567", "; ")):
        text = mark.join([number] * 300)
        found = {x[1:] for x in pii.find(text)[1]}
        step = len(number) + len(mark)
        assert found == {(i * step, i * step + len(number)) for i in range(300)}


def test_decoded_equals_forward(monkeypatch):
    monkeypatch.setattr(pii, "SCORED_TOKENS", 5)
    w = pii.trained()
    for text, _ in list(pii.invented_lines(seed=5))[:150]:
        for a, b in pii.regions(text):
            cue, tokens = pii.region_tokens(text, a, b)
            spans, x = pii.all_spans(text, tokens, cue)
            if spans:
                _, back = pii.forward(len(tokens), spans, pii.scores(w, x, cue) - pii.MARGIN, True)
                out, j = [], len(tokens)
                while j > 0:
                    if back[j] is None:
                        j -= 1
                    else:
                        (i, k), t = spans[back[j][0]], back[j][1]
                        out.append((pii.KINDS[t], tokens[i][0], tokens[i + k - 1][1]))
                        j = i
                assert pii.decoded(text, tokens, cue, w) == out
