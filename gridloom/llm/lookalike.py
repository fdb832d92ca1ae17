"""One spelling for text that looks the same: forms, blanks, invisible characters,
accents and look-alike letters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look alike, a line each: Latin, Cyrillic, Greek ('-': none).
LOOK_ALIKE = """
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y У Υ
Z - Ζ
V Ѵ -
G Ԍ -
W Ԝ -
Q Ԛ -
a а -
c с ϲ
d ԁ -
e е -
h һ -
i і ι
j ј ϳ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
u - υ
v ѵ ν
w ԝ -
x х χ
y у -
"""
# Pairs that look alike only inside a word of the other letters: Latin, Greek.
IN_WORD = "a α\nk κ\nt τ\ny γ\nn η"
# Letters of one script that don't count as that script's where they stand alone as a unit.
UNITS = frozenset("m mm cm dm km kg kN kPa MPa Hz kW".split())
# Default-ignorable code points outside the general categories Cf and Cc.
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
# Fixed value: blanks that no category of space covers.
OTHER_BLANKS = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029\u2800"
# Kinds of compatibility characters that are a letter, digit or sign of another width or form.
FORMS = ("<wide>", "<narrow>", "<font>", "<square>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Distinct values whose result is kept by each worker.
CACHE = 200_000

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")


def _tables() -> dict[str, dict[str, str]]:
    """For each script, the letters of the others that look like one of its own."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for line in LOOK_ALIKE.split("\n"):
        row = line.split(" ")
        if len(row) == 3:
            for s, own in zip(SCRIPTS, row):
                for other in row:
                    if own != "-" and other not in ("-", own):
                        to[s][other] = own
    return to


TO = _tables()
TO_IN_WORD = {"LATIN": {g: c for c, g in (x.split() for x in IN_WORD.split("\n"))}, "GREEK": {}, "CYRILLIC": {}}


@lru_cache(65_536)
def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK or OTHER of a letter; empty for what is no letter."""
    if not c.isalpha() or c in "\u00aa\u00ba\u00b5":
        return ""
    name = unicodedata.name(c, "").split(" ", 1)[0]
    return name if name in SCRIPTS else "OTHER"


@lru_cache(65_536)
def shape(c: str) -> tuple[str, str]:
    """What becomes of one character, and why: '' (ordinary), 'invisible', 'blank', 'form'."""
    if c < "\x7f" and c not in OTHER_BLANKS and (c >= " " or c == "\n"):
        return c, ""
    if c == "\u00b5":  # the micro sign is a sign
        return c, ""
    kind = unicodedata.category(c)
    if c in OTHER_BLANKS or (kind == "Zs" and c != " "):
        return " ", "blank"
    if kind in ("Cf", "Cc") or c in IGNORABLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0000 <= ord(c) <= 0xE0FFF or 0x2065 == ord(c):
        return "", "invisible"
    how = unicodedata.decomposition(c)
    if how.startswith(FORMS):
        return unicodedata.normalize("NFKC", c), "form"
    if how.startswith(("<compat>", "<circle>")) and kind[0] in "LN":
        return unicodedata.normalize("NFKC", c), "form"
    if how and not how.startswith("<") and unicodedata.normalize("NFC", c) != c:
        return unicodedata.normalize("NFC", c), "form"
    return c, ""


WORD = re.compile(r"[^\W\d_]+")
RAISED = "²³¹⁰ªº"


def _alike(c: str, table: dict[str, str]) -> str | None:
    """The letter of `table` that looks like c, with c's accents."""
    if c in table:
        return table[c]
    parts = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", table[parts[0]] + parts[1:]) if len(parts) > 1 and parts[0] in table else None


def _plain_letters(line: str) -> str:
    """One line with look-alike letters in the script that the line is written in.

    The script is the one into which the fewest letters can't be turned (then the one
    with most letters, then the first of SCRIPTS). A word wholly of another script stays
    if one of its letters looks like none of that script; so do single letters
    that look like none of it. Units don't count."""
    words = [w for w in WORD.finditer(line) if w.group().rstrip(RAISED) not in UNITS]
    count = dict.fromkeys(SCRIPTS, 0)
    for w in words:
        for c in w.group():
            s = script(c)
            if s in count:
                count[s] += 1
    used = [s for s in SCRIPTS if count[s]]
    if len(used) < 2:
        return line
    def strange(s: str) -> int:
        return sum(1 for w in words for c in w.group() if script(c) in count and script(c) != s and _alike(c, TO[s]) is None)
    main = min(used, key=lambda s: (strange(s), -count[s], SCRIPTS.index(s)))
    out = list(line)
    for w in words:
        kinds = {script(c) for c in w.group()} & set(SCRIPTS)
        if kinds <= {main}:
            continue
        mixed = len(kinds) > 1
        table = TO[main] | TO_IN_WORD[main] if mixed else TO[main]
        if not mixed and any(script(c) in count and _alike(c, table) is None for c in w.group()):
            continue
        for i in range(w.start(), w.end()):
            if script(out[i]) != main:
                out[i] = _alike(out[i], table) or out[i]
    return "".join(out)


def spelling(text: str) -> tuple[str, str]:
    """The ordinary spelling of a text, and what was odd about it: a comma list of
    invisible, blank, form, accent, letter; empty for ordinary text."""
    if text.isascii() and text.isprintable():
        return text, ""
    why: set[str] = set()
    out = []
    for c in text:
        new, kind = shape(c)
        out.append(new)
        if kind:
            why.add(kind)
    plain = "".join(out)
    composed = unicodedata.normalize("NFC", plain)
    if composed != plain or any(unicodedata.combining(c) for c in composed):
        why.add("accent")
    lines = composed.split("\n")
    plain = "\n".join(_plain_letters(x) for x in lines)
    if plain != composed:
        why.add("letter")
    return plain, ",".join(sorted(why))


def spell(text: str) -> tuple[str, str, str]:
    """(spelling, odd, key) of a text. The key is equal for texts that look equal but for letter
    case and runs of blanks: the spelling in NFKC (so that fractions, raised and circled
    signs are digits and letters too), fully case-folded, composed again, the Turkish
    i's as one letter."""
    plain, odd = spelling(text)
    folded = unicodedata.normalize("NFKC", plain).casefold().replace("i\u0307", "i").replace("ı", "i")
    return plain, odd, re.sub(r" +", " ", unicodedata.normalize("NFKC", folded)).strip()


def compare_key(text: str) -> str:
    return spell(text)[2]


def per_value(f, cache: int = CACHE):
    """A vectorised version of f that runs it once for each distinct value of a batch,
    and keeps results for following batches up to `cache` values."""
    kept: dict = {}

    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        got = []
        for v in distinct:
            if v not in kept:
                if len(kept) >= cache:
                    kept.clear()
                kept[v] = f(v)
            got.append(kept[v])
        got.append(None)
        return pd.Series([got[i] for i in codes], index=values.index, dtype=object)

    return run


def odd_characters(c: Column) -> Column:
    """False for texts in which nothing can be odd; checked before anything goes to Python."""
    return F.rlike(c, F.lit(r"[^\x20-\x7E\n]"))


def spell_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, field_name, value, spelling, odd, compare_key for each non-null value of the columns.

    Empty text stays empty. Long texts are treated whole. One narrow stage."""
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns])
    rows = df.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.field_name", "f.value").where(F.col("value").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", spelling string, odd string, compare_key string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = per_value(spell)
        for b in batches:
            got = one(b["value"])
            yield b.assign(spelling=[g[0] for g in got], odd=[g[1] for g in got], compare_key=[g[2] for g in got])

    return rows.mapInPandas(run, schema)
