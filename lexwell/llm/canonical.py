"""Problem 6: one consistent form for texts that look the same but are stored in different characters.

Method: quick-check properties find the unstable segments of a text, only those are normalised, with the character
before them as context, and the result is spliced into the unchanged rest. A character is stable if it is in composed
form, has no compatibility form that looks the same, is not invisible, is no special space and resembles no letter of
another script. ASCII texts pass untouched.

The form: canonical composition (NFC); full-width, half-width, font and ligature forms replaced by their plain
characters; every space of its own width a plain space; invisible characters removed; line ends one ``\\n``; look-alike
letters written in the script of their word. Superscripts, fractions and enclosed forms stay: they do not look the same.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwell.llm.common import saved, ship

# Letters that look like a Latin letter (Unicode confusables, the upright everyday shapes only).
CYRILLIC_LOOKS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅҮԚԜ", "aeopcyxijshdqwABEKMHOPCTXIJSYQW"))
GREEK_LOOKS = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"))
CHEROKEE_LOOKS = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
ARMENIAN_LOOKS = dict(zip("օՕսհՏ", "oOuhS"))
LATIN_LOOKS = dict(zip("ɑɡꓲ", "agI"))
# Compatibility tags whose characters look like their plain form.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
# Invisible characters besides those of category Cf.
INVISIBLE = "\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

# Where characters are assigned; the planes between hold none that change.
ASSIGNED = (range(0x80, 0x32000), range(0xE0000, 0xE0200))
ROMAN = range(0x2160, 0x2180)  # numerals that look like the letters they are made of

_TO_LATIN = CYRILLIC_LOOKS | GREEK_LOOKS | CHEROKEE_LOOKS | ARMENIAN_LOOKS
_TO_CYRILLIC = {latin: cyrillic for cyrillic, latin in reversed(CYRILLIC_LOOKS.items())}
_GREEK_BY_LATIN = {latin: greek for greek, latin in GREEK_LOOKS.items()}


def _plain(c: str) -> str | None:
    """What a character becomes before composition; None if it stays."""
    kind = ud.category(c)
    if c in INVISIBLE or kind == "Cf" or (kind == "Mn" and ud.name(c, "").startswith("VARIATION SELECTOR")):
        return ""
    if c in LATIN_LOOKS:
        return LATIN_LOOKS[c]
    if kind == "Zs" and c != " ":
        return " "
    if c in "\u2028\u2029":
        return "\n"
    if c in "\u2010\u2011":
        return "-"
    tag = ud.decomposition(c).split(" ")
    if tag[0] in SAME_LOOK_TAGS or (tag[0] == "<compat>" and ("LIGATURE" in ud.name(c, "") or c in "…µ" or ord(c) in ROMAN)):
        return "".join(_plain(x) or x for x in (chr(int(h, 16)) for h in tag[1:]))
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[frozenset[str], re.Pattern, dict[int, str]]:
    """The characters that fail the quick check, the pattern of unstable segments, the table of plain characters.

    "Maybe" fails too: characters that compose with the one before them, whether combining or, like the vowels and finals
    of Hangul, not.
    """
    plain, unstable, composing = {}, [], set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
    codes = [code for part in ASSIGNED for code in part if ud.category(chr(code)) not in ("Cn", "Cs", "Co")]
    for code in codes:
        pair = ud.decomposition(chr(code)).split(" ")
        if len(pair) == 2 and not pair[0].startswith("<"):
            composing.add(chr(int(pair[1], 16)))
    for code in codes:
        c = chr(code)
        p = _plain(c)
        if p is not None:
            plain[code] = p
        if p is not None or ud.combining(c) or c in composing or not ud.is_normalized("NFC", c):
            unstable.append(code)
    ranges, start = [], None
    for code, following in zip(unstable, unstable[1:] + [-1]):
        start = code if start is None else start
        if following != code + 1:
            ranges.append(re.escape(chr(start)) + ("-" + re.escape(chr(code)) if code > start else ""))
            start = None
    return frozenset(map(chr, unstable)), re.compile(f"[{''.join(ranges)}]+"), plain


_LOOKS = frozenset(_TO_LATIN)
_WORD = re.compile(r"[^\W\d_]+")


def _script(word: str) -> str:
    """The script a word is certain to be in: that of its letters without a double; '' if none."""
    found = {""}
    for c in word:
        if c in _TO_LATIN:
            continue
        if c < "ɐ":
            if c not in _TO_CYRILLIC:
                found.add("latin")
        elif "Ͱ" <= c < "Ѐ":
            found.add("greek")
        elif "Ѐ" <= c < "԰":
            found.add("cyrillic")
        elif "Ꭰ" <= c <= "᏿" or "ꭰ" <= c <= "ꮿ":
            found.add("cherokee")
        elif "԰" <= c < "֐":
            found.add("armenian")
    for script in ("cherokee", "armenian", "cyrillic", "greek", "latin"):
        if script in found:
            return script
    return ""


@lru_cache(maxsize=200_000)
def _in_script(word: str, ambiguous: str) -> str:
    script = _script(word) or ambiguous
    if script in ("cherokee", "armenian"):
        return word
    if script == "cyrillic":
        if any(c in _TO_CYRILLIC or (c in _TO_LATIN and c not in CYRILLIC_LOOKS) for c in word):
            return "".join(_TO_CYRILLIC.get(_TO_LATIN.get(c, c) if c not in CYRILLIC_LOOKS else c, c) for c in word)
        return word
    if script == "greek":
        return "".join(_GREEK_BY_LATIN.get(_TO_LATIN.get(c, c), c) for c in word)
    return "".join(_TO_LATIN.get(c, c) for c in word)


def _mostly(text: str) -> str:
    """The script for words made only of look-alike letters: the one most letters without a double are in."""
    cyrillic = len(re.findall(r"[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁ]", text))
    return "cyrillic" if cyrillic > len(re.findall(r"[b-df-hklmnrtuvwzDFGJLNQRUVWZ]", text)) else "latin"


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; null gives null, empty gives empty."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    unstable, segment, plain = _tables()
    used = set(text)
    if not used.isdisjoint(unstable):
        parts, done = [], 0
        for m in segment.finditer(text):
            start = max(done, m.start() - 1)  # the character before may compose with the segment
            parts += (text[done:start], ud.normalize("NFC", text[start : m.end()].translate(plain)))
            done = m.end()
        text = "".join((*parts, text[done:]))
        if not ud.is_normalized("NFC", text):  # a removed character stood between a letter and its mark
            text = ud.normalize("NFC", text)
        used = set(text)
    if not used.isdisjoint(_LOOKS):
        mostly = _mostly(text)
        text = _WORD.sub(lambda m: w if (w := m.group()).isascii() else _in_script(w, mostly), text)
    return text


def canonical_column(text: Column) -> Column:
    """``canonical`` as a column; Arrow batches, one Python call per text that is not ASCII."""

    @F.pandas_udf("string")
    def form(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(canonical, na_action="ignore")

    return F.when(text.rlike(r"[^\x00-\x0c\x0e-\x7f]"), form(text)).otherwise(text)


def form_classes(df: DataFrame, record: str, text: Column) -> DataFrame:
    """(record, form, stored): for each record the hash of the form of its text and of the text as stored, 128 bits each.

    Records with equal ``form`` look the same, those with equal ``stored`` are the same. Rows with null text or id have
    no row; equal rows repeat. Every text is brought to its form once; the result is a written table.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(record).alias("r"), text.alias("t")).where(F.col("t").isNotNull() & F.col("r").isNotNull())
    return saved(rows.select("r", F.md5(canonical_column(F.col("t"))).alias("form"), F.md5("t").alias("stored"))).withColumnRenamed("r", record)


def variants(classes: DataFrame, record: str) -> DataFrame:
    """(record, form, stored, variants, copies): how many different texts have the record's form, how many records its text."""
    texts = classes.groupBy("form", "stored").agg(F.count(F.lit(1)).alias("copies"))
    forms = texts.groupBy("form").agg(F.count(F.lit(1)).alias("variants"))
    return classes.join(texts.join(forms, "form"), ["form", "stored"]).select(record, "form", "stored", "variants", "copies")


def same_looking_pairs(df: DataFrame, record: str, text: Column, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs (a < b) of records whose texts are different character sequences with the same canonical form.

    Only hashes of the texts are moved. Records with the same text form one class; the classes of a form are paired, and
    only pairs of classes are expanded to their records, so copies are never compared with each other. Null texts take
    part in nothing; empty texts are equal and give no pair. The result is as large as the definition asks for.
    """
    classes = form_classes(df, record, text).withColumnRenamed(record, "r")
    several = classes.groupBy("form").agg(F.min("stored").alias("x"), F.max("stored").alias("y")).where("x <> y").select("form")
    kept = saved(classes.join(several, "form", "left_semi"))
    texts = kept.select("form", "stored").distinct()
    x, y = texts.select("form", F.col("stored").alias("x")), texts.select("form", F.col("stored").alias("y"))
    pairs = x.join(y, "form").where("x < y")
    a, b = kept.select("form", F.col("stored").alias("x"), F.col("r").alias("p")), kept.select("form", F.col("stored").alias("y"), F.col("r").alias("q"))
    both = pairs.join(a, ["form", "x"]).join(b, ["form", "y"]).where("p <> q")
    return both.select(F.least("p", "q").alias(record + suffixes[0]), F.greatest("p", "q").alias(record + suffixes[1])).distinct()
