"""Text and hash expressions as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucn"



def _plain_letters() -> dict[str, str]:
    """Letters of Latin blocks whose canonical decomposition is one ASCII letter and marks; combining marks go."""
    latin = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    bare = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)) for c in latin}
    return {c: b.lower() for c, b in bare.items() if len(b) == 1 and b.isascii()}


_LETTERS = _plain_letters()
#: Letters with marks, then combining marks, which have no counterpart; and the letters without marks.
MARKED, UNMARKED = "".join(_LETTERS) + "".join(map(chr, range(0x300, 0x370))), "".join(_LETTERS.values())


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def folded(x: Column) -> Column:
    """Lower case without accents, other characters as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def normalized(x: Column) -> Column:
    """Lower case, letters of all Latin blocks without their marks, other characters as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), MARKED, UNMARKED), "[^a-z0-9]+", " "))


def normalized_text(x: str) -> str:
    """What normalized makes of a fixed text."""
    bare = x.lower().translate(str.maketrans(MARKED[: len(UNMARKED)], UNMARKED, MARKED[len(UNMARKED) :]))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())


def words(x: Column) -> Column:
    """Of a normalised text."""
    return F.filter(F.split(x, " "), lambda t: t != "")


def tokens(x: Column, least: int = 3) -> Column:
    """Runs of ASCII letters and digits of at least so many characters, in lower case."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def ngrams(words: Column, most: int = 3) -> Column:
    """Phrases of 1 to most consecutive words, the longest first."""

    def of_size(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*(of_size(n) for n in range(most, 0, -1)))


def without_html(x: Column) -> Column:
    """Line breaks kept, tags as spaces, six entities decoded, runs of spaces squeezed."""
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" *\n *", "\n"), r"^\s+|\s+$", "")


def xor_hash36(x: Column) -> Column:
    """A 32-bit multiply-by-33-and-xor hash over ASCII characters, in base 36."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda a, c: (a * 33).bitwiseXOR(c) % F.lit(2**32))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def message_time(x: Column) -> Column:
    """HH:MM of the first "at 9", "at 14:30", "at 9 pm", or else of the first "3:45pm", "9 PM"; null where there is none or it is no time."""
    first = r"(?i)\bat\s+(\d{1,2})(?::(\d{2}))?\b\s*(am|pm)?\b"
    second = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
    pick = lambda g: F.when(x.rlike(first), F.regexp_extract(x, first, g)).otherwise(F.regexp_extract(x, second, g))
    hour, minute, half = F.when(pick(1) != "", pick(1).cast("int")), F.when(pick(2) != "", pick(2).cast("int")).otherwise(0), F.lower(pick(3))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when((hour < 24) & (minute < 60), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))
