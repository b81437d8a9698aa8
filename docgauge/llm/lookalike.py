"""Look-alike characters: letters of other scripts drawn as Latin ones, odd spaces and characters without a face."""

from __future__ import annotations

import unicodedata

# Letters of Cyrillic and Greek whose usual glyph is that of a Latin letter, in the same order.
CYRILLIC, CYRILLIC_LATIN = "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYX3aesijopcyxdqwhl"
GREEK, GREEK_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονια", "ABEZHIKMNOPTYXovia"
# Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters that leave no mark: soft hyphen, zero-width and direction marks, variation selectors.
UNSEEN = "[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff]"
#: White space that is drawn like a space.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Hyphens that are drawn like the ASCII one.
HYPHENS = "‐‑"
#: Full-width ASCII, by rule.
FULL = "".join(chr(0xFF01 + i) for i in range(94))
FULL_LATIN = "".join(chr(0x21 + i) for i in range(94))



def _accented() -> tuple[dict[str, str], dict[str, str]]:
    """Composed letters of both scripts on a look-alike base, as the Latin base with the same marks: those that have one
    composed Latin character, and those that need several."""
    base = dict(zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN))
    one, more = {}, {}
    for c in (*map(chr, range(0x370, 0x530)), *map(chr, range(0x1F00, 0x2000))):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in base:
            latin = unicodedata.normalize("NFC", base[d[0]] + d[1:])
            (one if len(latin) == 1 else more)[c] = latin
    return one, more


ACCENTED, ACCENTED_MORE = _accented()
#: A class that holds all of ``ACCENTED_MORE``, for a cheap test.
MORE = "[" + "".join(c for c in ACCENTED_MORE if c < "\u1f00") + "\u1f00-\u1fff]"

FROM = CYRILLIC + GREEK + "".join(ACCENTED) + FULL + SPACES + HYPHENS
TO = CYRILLIC_LATIN + GREEK_LATIN + "".join(ACCENTED.values()) + FULL_LATIN + " " * len(SPACES) + "-" * len(HYPHENS)
assert len(FROM) == len(TO)

#: For Python's str.translate: the letters only.
TO_LATIN = dict(zip(map(ord, CYRILLIC + GREEK), CYRILLIC_LATIN + GREEK_LATIN))


#: Characters that ``visible`` may change, for a cheap test before the mapping: all but ASCII, Latin letters and the
#: usual punctuation and currency signs. A few ranges, since a class of many single characters is slow.
HIDDEN = r"[^\x00-\x7f\x{a1}-\x{ac}\x{ae}-\x{24f}\x{2012}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}]"


def visible(c):
    """Column of the text as it is drawn: look-alikes as Latin letters, plain spaces, no unseen characters."""
    from pyspark.sql import functions as F

    out = F.translate(F.regexp_replace(c, UNSEEN, ""), FROM, TO)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    table = F.create_map(*[F.lit(x) for pair in ACCENTED_MORE.items() for x in pair])
    letters = F.transform(F.split(out, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(c.rlike(MORE), F.array_join(letters, "")).otherwise(out)
