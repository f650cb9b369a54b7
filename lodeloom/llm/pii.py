"""Personal data in text, also behind light disguises, with offsets into the untouched source.

Plain identifiers are found by four patterns in the source itself. Then three transducers rewrite the text one after another
(look-alike letters and invisible characters, spelled digits, at/dot disguises). Each tells which characters it replaces
by what, and their alignments are composed. The same patterns run over the rewritten text, and each find is carried
back through the composed alignment to the source characters it came from.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import batch_of

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts and signs that look like ASCII ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
# Characters that take no room on the page.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Names of the digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# English names of numbers of two digits, and of the tens that a digit may follow.
TEEN_WORDS = {
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
}
TEN_WORDS = {"twenty": "2", "thirty": "3", "forty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9"}
# How "@" and dots are named; the word "point" is too common to count without brackets.
AT_WORDS, DOT_WORDS = ("at", "arroba"), ("dot", "punto", "ponto", "punkt")
BRACKETS = ("()", "[]", "{}", "<>")

#: Kinds of Unicode's compatibility forms that are the same letter in another dress: mathematical letters, full-width ones, ringed ones.
DRESSES = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>")


@functools.cache
def plain_letter(c: str) -> str | None:
    """What a character stands for: an ASCII one, nothing if it is invisible, or None if it stands for itself.

    Decimal digits of all scripts and dressed letters come from Unicode's own tables.
    """
    if c in UNSEEN:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    kind, _, form = unicodedata.decomposition(c).partition(" ")
    if kind in DRESSES and " " not in form:
        letter = chr(int(form, 16))
        return letter if letter.isascii() else LOOK_ALIKES.get(letter)
    return None


NUMBER_WORDS = DIGIT_WORDS | TEEN_WORDS
_WORDS = "|".join(sorted([*NUMBER_WORDS, *TEN_WORDS], key=len, reverse=True))
_ONE = rf"(?:(?:double|triple)[ ]+)?(?:{_WORDS}|[0-9]++)"
#: A run of spelled digits (or digits among them), three words at least; "plus" may lead, "dot" or "point" parts it, "double" and "triple" repeat the digit after them.
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[ -]+)?{_ONE}(?:(?:[ ]*,[ ]*|[ ]?-[ ]?|[ ]+)(?:dot[ ]+|point[ ]+)?{_ONE}){{2,}}(?![^\W_])")
_DIGIT = "|".join(w for w, d in DIGIT_WORDS.items() if d != "0")
SPELLED_PART = re.compile(
    rf"(?i)(?P<times>double|triple)[ ]+(?P<one>{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9](?![0-9]))(?![^\W_])|double|triple"
    rf"|(?P<ten>{'|'.join(TEN_WORDS)})(?:[ -]+(?P<unit>{_DIGIT})(?![^\W_]))?|{_WORDS}|[0-9]+|plus|dot|point|[ ,-]+"
)
#: Digits that a run must spell or show at least.
LEAST_DIGITS = 4
#: A text without any of these words has no run of spelled digits; an article alone makes none.
TELLTALE = frozenset([*NUMBER_WORDS, *TEN_WORDS]) - {"un", "oh", "null"}

def bracketed(words: str) -> str:
    return "|".join(rf"{re.escape(a)}(?:{words}){re.escape(b)}" for a, b in BRACKETS)


_DOT = rf"[ ]*(?:{bracketed('|'.join([*DOT_WORDS, 'point', re.escape('.')]))})[ ]*|[ ]+(?:{'|'.join(DOT_WORDS)})[ ]+"
_NAME = r"[A-Za-z0-9-]+"
#: Where an address may have its "@": in brackets, as a word, or as it is.
AT_MARK = re.compile(rf"(?i){bracketed('|'.join([*AT_WORDS, '@']))}|(?<= )(?:{'|'.join(AT_WORDS)})(?= )|@")
DOMAIN_AFTER = re.compile(rf"(?i){_NAME}+(?:(?:{_DOT}|\.){_NAME}+)++")
DOT_MARK = re.compile(rf"(?i){_DOT}")
#: A text without any of these, in lower case, has no disguised mark.
DISGUISES = [f"{a}{mark}{b}" for mark in (*AT_WORDS, "@", *DOT_WORDS, "point", ".") for a, b in BRACKETS] + [f" {w} " for w in DOT_WORDS] + [" @", "@ "]
IP_DISGUISED = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])")
#: Dots in brackets, as they stand before the rest of a local part.
BRACKETED = tuple(f"{a}{mark}{b}" for mark in (*DOT_WORDS, "point", ".") for a, b in BRACKETS)


@dataclass(frozen=True)
class Aligned:
    """A rewritten text and, for each of its pieces, where it begins and which source characters it stands for."""

    text: str
    at: list[int]
    source: list[tuple[int, int, bool]]

    @classmethod
    def of(cls, text: str) -> Aligned:
        return cls(text, [0], [(0, len(text), True)])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that rewritten characters start to end stand for."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, same), (b, b_end, b_same) = self.source[i], self.source[j]
        return (a + start - self.at[i] if same else a), (b + end - self.at[j] if b_same else b_end)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """Apply edits (start, end, new), in order and disjoint, composing the alignments."""
        if not edits:
            return self
        out, at, source, done, n = [], [], [], 0, 0

        def copy(upto: int) -> None:
            nonlocal n, done
            while done < upto:  # piece by piece of this alignment
                i = bisect_right(self.at, done) - 1
                a, end, same = self.source[i]
                stop = min(upto, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                whole = (a + done - self.at[i], a + stop - self.at[i], True) if same else (a, end, False)
                at.append(n)
                source.append(whole)
                out.append(self.text[done:stop])
                n, done = n + stop - done, stop

        for start, end, new in edits:
            copy(start)
            if new:
                at.append(n)
                source.append((*self.back(start, end), False))
                out.append(new)
                n += len(new)
            done = end
        copy(len(self.text))
        return Aligned("".join(out), at or [0], source or [(0, 0, True)])


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost and disjoint within it, in code points; finds that fail their check are dropped, not retried.

    Time is linear in the text: an address is grown from its "@", and no pattern rescans a run of digits.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if (m := DIGIT.search(text)) is None:
        return found
    first = m.start()
    for m in IP.finditer(text, first):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text, first):
        if m.end() - m.start() <= 37 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if (plus := text.find("+")) >= 0:
        for m in PHONE.finditer(text, plus):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def clear_of(spans: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those of spans that touch none of taken, which are sorted and disjoint."""
    starts = [a for a, _ in taken]
    return [x for x in spans if not (i := bisect_left(starts, x[1])) or taken[i - 1][1] <= x[0]]


def letter_edits(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes, dressed letters and digits of other scripts become ASCII ones; invisible characters go."""
    if text.isascii():
        return []
    odd = [c for c in set(text) if not c.isascii() and plain_letter(c) is not None]
    if not odd:
        return []
    return [(m.start(), m.end(), plain_letter(m[0])) for m in re.finditer(f"[{re.escape(''.join(odd))}]", text)]


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits become digits where LEAST_DIGITS stand in a row; what parts them goes, but for "dot"."""
    edits: list[tuple[int, int, str]] = []
    if TELLTALE.isdisjoint(text.lower().replace(",", " ").replace("-", " ").split()):
        return edits
    for m in SPELLED.finditer(text):
        if not re.search(r"[^\W\d]", m[0]):
            continue
        own, digits = [], 0
        for p in SPELLED_PART.finditer(text, m.start(), m.end()):
            word = p[0].lower()
            if p["times"]:
                one = p["one"].lower()
                new = (2 if p["times"].lower() == "double" else 3) * DIGIT_WORDS.get(one, one)
            elif p["ten"]:
                new = TEN_WORDS[p["ten"].lower()] + (DIGIT_WORDS[p["unit"].lower()] if p["unit"] else "0")
            else:
                new = NUMBER_WORDS.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word)
            digits += len(new) if new and new.isdigit() else len(p[0]) * word[0].isdigit()
            if new or not word[0].isdigit():
                own.append((p.start(), p.end(), new or ""))
        if digits >= LEAST_DIGITS:
            edits += own
    return edits


def spaces_before(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] == " ":
        at -= 1
    return at


def local_before(text: str, at: int, least: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Where the local part that ends at a position begins, not before least, and the edits of the disguised dots in it. Linear, whatever its length."""
    start, edits = at, []
    while True:
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        end = spaces_before(text, start, least)
        if mark := next((b for b in BRACKETED if text[max(least, end - len(b)) : end].lower() == b), None):
            dot = spaces_before(text, end - len(mark), least)
        elif end < start and (word := next((w for w in DOT_WORDS if text[max(least, end - len(w)) : end].lower() == w), None)) and (dot := spaces_before(text, end - len(word), least)) < end - len(word):
            pass
        else:
            return start, edits[::-1]
        if start == at or dot <= least or text[dot - 1] not in LOCAL or text[dot - 1] == ".":
            return start, edits[::-1]
        edits.append((dot, start, "."))
        start = dot


def mark_edits(text: str) -> list[tuple[int, int, str]]:
    """Disguised "@" and dots become plain within what then reads as an address; also dots between the parts of an IP.

    From each mark the address is grown to both sides, so that its length has no bound and time is linear. A spelled "at", or
    a plain "@" without spaces, counts only where a dot of the domain is disguised as well.
    """
    if not any(map(text.lower().__contains__, DISGUISES)):
        return []
    edits, done = [], 0
    for mark in AT_MARK.finditer(text):
        if mark.start() < done:
            continue
        before, after = spaces_before(text, mark.start(), done), mark.end()
        while after < len(text) and text[after] == " ":
            after += 1
        domain = DOMAIN_AFTER.match(text, after)
        if domain is None or before <= done or text[before - 1] not in LOCAL:
            continue
        dots = list(DOT_MARK.finditer(text, *domain.span()))
        bare = mark[0].lower() in AT_WORDS or (mark[0] == "@" and before == mark.start() and after == mark.end())
        if bare and not dots:
            continue
        _, own = local_before(text, before, done)
        edits += [*own, (before, after, "@"), *((d.start(), d.end(), ".") for d in dots)]
        done = domain.end()
    taken = sorted((a, b) for a, b, _ in edits)
    for m in IP_DISGUISED.finditer(text):
        new = [(d.start(), d.end(), ".") for d in DOT_MARK.finditer(text, *m.span())]
        edits += clear_of(new, taken)
    return sorted(e for e in edits if text[e[0] : e[1]] != e[2])


def find_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans of the source, and all spans: the plain ones and, disjoint from those of their kind, the disguised."""
    plain = plain_spans(text)
    first = Aligned.of(text)
    seen = first
    for edits_of in (letter_edits, spelled_edits, mark_edits):
        seen = seen.rewrite(edits_of(seen.text))
    if seen is first:
        return plain, plain
    every = {k: list(v) for k, v in plain.items()}
    for kind, spans in plain_spans(seen.text).items():
        every[kind] += clear_of([seen.back(*span) for span in spans], plain[kind])
    return plain, {k: sorted(v) for k, v in every.items()}


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str) -> str:
    """Put <EMAIL>, <IP>, <CARD>, <PHONE> for all found; where finds of two kinds overlap, the one that starts first stands for both."""
    spans = sorted((a, -b, k) for k, v in find_spans(text)[1].items() for a, b in v)
    if not spans:
        return text
    out, done = [], 0
    for a, minus_b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{k.upper()}>"]
        done = max(done, -minus_b)
    return "".join([*out, text[done:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def find_pii(docs: DataFrame) -> DataFrame:
    """The personal data of every document: counts and digest of plain spans, all spans, and how many were disguised.

    A null text counts as empty; doc_id is carried as it is, null or repeated; other columns are ignored; an empty table
    gives no rows. Every row is handled by itself, so nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                plain, every = find_spans(text or "")
                counts = [len(plain[k]) for k in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(listed(plain).encode()).hexdigest(), listed(every), sum(map(len, every.values())) - sum(counts)))
            if rows:
                yield batch_of(rows, FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FOUND)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind in angle brackets.

    A null text stays null, all columns stay, and n_chars, where there is one, follows the text.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    done = docs.withColumn("text", clean(F.col("text").cast("string")))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
