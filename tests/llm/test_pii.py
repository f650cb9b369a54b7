from __future__ import annotations

import hashlib
import random
import re

import pytest

from lodeloom.llm import pii as m


def brute(t: str) -> dict:
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [x.span() for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [x.span() for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))],
        "card": [x.span() for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(x[0])) <= 19 and m.luhn(digits(x[0]))],
        "phone": [x.span() for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(x[0])) <= 15],
    }


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@+- 5()%4x\n0éа٣") for _ in range(rng.randint(0, 60)))
        assert m.plain_spans(t) == brute(t)
        plain, every = m.find_spans(t)
        assert all(set(plain[k]) <= set(every[k]) for k in m.KINDS)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) exam-ple [dot] co dot uk now", "email", "john.doe (at) exam-ple [dot] co dot uk"),
        ("reach bob at mail dot example dot com today", "email", "bob at mail dot example dot com"),
        ("x jоhn@еxample.com y", "email", "jоhn@еxample.com"),
        ("a​b@c​.com", "email", "a​b@c​.com"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one nine eight eight five five five two four eight five.", "phone", "plus one nine eight eight five five five two four eight five"),
        ("ip 10 (dot) 0 (dot) 0 (dot) 1", "ip", "10 (dot) 0 (dot) 0 (dot) 1"),
        ("ann＠site．org", "email", "ann＠site．org"),
        ("𝐚𝐧𝐧@𝓼𝓲𝓽𝓮.org", "email", "𝐚𝐧𝐧@𝓼𝓲𝓽𝓮.org"),
        ("ip ١٠.٠.٠.١ or", "ip", "١٠.٠.٠.١"),
        ("card ४१११ ११११ ११११ ११११ ok", "card", "४१११ ११११ ११११ ११११"),
        ("call plus one double nine triple eight five double five two four eight five.", "phone", "plus one double nine triple eight five double five two four eight five"),
        ("escribe a jane[arroba]example[punto]com hoy", "email", "jane[arroba]example[punto]com"),
        ("jane.doe arroba example punto com ponto br", "email", "jane.doe arroba example punto com ponto br"),
        ("jane {at} example (point) org", "email", "jane {at} example (point) org"),
        ("eva punkt maier (at) seite punkt de", "email", "eva punkt maier (at) seite punkt de"),
        ("dial plus four four twenty seven ninety-one eleven sixty oh five nineteen now", "phone", "plus four four twenty seven ninety-one eleven sixty oh five nineteen"),
        ("ip ten dot twenty dot thirty one dot two", "ip", "ten dot twenty dot thirty one dot two"),
        ("ann (dot) maria dot smith [at] site (dot) org", "email", "ann (dot) maria dot smith [at] site (dot) org"),
        ("a" * 5000 + " [at] " + "b" * 5000 + ".com", "email", "a" * 5000 + " [at] " + "b" * 5000 + ".com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    plain, every = m.find_spans(text)
    assert [text[a:b] for a, b in every[kind]] == [found] and not plain[kind]


def test_disguises_against_the_parts_they_are_made_of():
    """Plain identifiers, each part dressed at random, among plain words: the spans are known from how the text is put together."""
    rng = random.Random(6)
    words = "zero one two three four five six seven eight nine".split()
    math = lambda s: "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in s)
    arabic = lambda s: "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in s)
    for _ in range(3000):
        text, want = "", []
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(["see note, ", "we met there; ", "she said so. ", "(then) "])
            kind = rng.choice(["email", "ip", "phone"])
            if kind == "email":
                at, dot = rng.choice([" (at) ", "[at]", " at ", " @ ", "{@}"]), rng.choice([" dot ", "(dot)", " [.] "])
                one = rng.choice(["ann", "bob.lee", "j-9"]) + at + rng.choice(["site", "ex-ample"]) + dot + "org"
            elif kind == "ip":
                one = arabic(".".join(str(rng.randint(0, 255)) for _ in range(4))) if rng.random() < 0.5 else " dot ".join(str(rng.randint(0, 255)) for _ in range(4))
            else:
                one = "plus " + " ".join(rng.choice(words) for _ in range(rng.randint(9, 12)))
            if rng.random() < 0.3 and kind == "email":
                one = math(one[:2]) + one[2:]
            want.append((kind, len(text), len(text) + len(one)))
            text += one + ", "
        plain, every = m.find_spans(text)
        assert sorted((k, a, b) for k in m.KINDS for a, b in every[k]) == sorted(want), text
        assert not any(plain.values())


@pytest.mark.parametrize("text", ["he is at home. dot it", "one two three go", "version 4.0 of a licence", "un un un un deux", "look at this point in time", "twenty one, twenty two, twenty three", "al punto de venta", "1" * 100_000 + "@" * 1000 + "+1 " * 30_000])
def test_clean_and_hostile_texts(text):
    assert m.find_spans(text)[1] == {k: [] for k in m.KINDS}


def test_rows_and_redaction(odd_docs, no_docs):
    rows = {(r.doc_id, r.spans): r for r in m.find_pii(odd_docs).collect()}
    full = next(r for r in rows.values() if r.doc_id == 7)
    assert (full.n_email, full.n_ip, full.n_card, full.n_phone) == (1, 1, 1, 1)
    assert full.base_sha256 == hashlib.sha256(full.spans.encode()).hexdigest()
    assert m.find_pii(odd_docs).count() == odd_docs.count() and m.find_pii(no_docs).count() == 0
    clean = m.redact_documents(odd_docs)
    assert clean.columns == odd_docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[7] == "write to <EMAIL> or <PHONE> from <IP>, card <CARD>" and texts[2] is None and texts[6] == "x"
    assert m.redact_documents(no_docs).count() == 0


def test_numbers_of_two_digits():
    for text, want in (("plus four four twenty seven", "+4427"), ("twenty oh seven nineteen ninety", "20071990"), ("Seventy-Seven, seventeen, double one", "771711")):
        assert m.Aligned.of(text).rewrite(m.spelled_edits(text)).text == want
