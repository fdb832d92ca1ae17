"""Text decoded with the wrong character encoding: found and restored.

A token's characters are mapped back to the bytes of a legacy encoding. An automaton
over the byte structure finds the maximal well-formed multibyte spans, and only those
are decoded. Bytes of one single-byte encoding read as another have no such
structure: for them all tokens are re-read under pairs of encodings. Either is
accepted by statistics of character triples over the whole corpus, kept in tables
of fixed size."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.lookalike import SCRIPTS, per_value, script, spelling

# Encodings under which multibyte text is misread.
READ_AS = "cp1252 latin-1 cp1254 cp1250 cp1251 cp1253 cp437 cp850 cp857 cp852 cp866 mac_roman".split()
# Fixed values: (misread as, written in) for single-byte text.
MISREAD_AS = "cp1252 latin-1 cp1254 cp1250 cp1251 cp1253 cp437 cp850 mac_roman".split()
WRITTEN_IN = "cp1254 cp1252 cp1250 cp1251 cp1253 cp437 cp850 cp852 cp857 cp866 cp737 cp860 cp861 mac_roman mac_turkish mac_latin2 mac_greek mac_cyrillic mac_iceland koi8-r iso8859-2 iso8859-5 iso8859-7".split()
LOST = "�"
#: Slots in each of the two rows of the sketch; they bound what is gathered and sent (4 MB).
SLOTS = 1 << 19
#: Mean log count by which a single-byte reading must be better, and must reach at least.
BETTER = 2.2
AT_LEAST = 0.7
#: Counts from which a character is one that the corpus writes.
KNOWN = 3
DIGITS = re.compile(r"\d+")
BLANK = re.compile(r"([ \t\r\n]+)")
CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def _decode_table(name: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(None)
    return out


DECODE = {e: _decode_table(e) for e in {*READ_AS, *MISREAD_AS, *WRITTEN_IN}}
#: Bytes that an encoding leaves undefined are commonly kept as control characters.
ENCODE = {e: {chr(b) if c is None else c: b for b, c in reversed(list(enumerate(t)))} for e, t in DECODE.items()}


def multibyte_spans(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, code point) of the well-formed UTF-8 sequences of two bytes or more
    in a list of byte values (-1: no byte), left to right, none overlapping. No
    overlong forms, surrogates, or values beyond U+10FFFF."""
    out = []
    state = need = point = start = 0
    low, high = 0x80, 0xBF
    for i, b in enumerate(codes):
        if state:
            if low <= b <= high:
                point = point << 6 | (b & 0x3F)
                low, high = 0x80, 0xBF
                state -= 1
                if not state:
                    out.append((start, i + 1, point))
                continue
            state = 0
        low, high = 0x80, 0xBF
        if 0xC2 <= b <= 0xDF:
            need, point = 1, b & 0x1F
        elif 0xE0 <= b <= 0xEF:
            need, point = 2, b & 0x0F
            low, high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
        elif 0xF0 <= b <= 0xF4:
            need, point = 3, b & 0x07
            low, high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
        else:
            continue
        state, start = need, i
    return out


def decode_spans(token: str, read_as: str) -> str | None:
    """The token with its multibyte spans decoded; None where it has none."""
    table = ENCODE[read_as]
    spans = multibyte_spans([ord(c) if c < "\x80" else table.get(c, -1) for c in token])
    if not spans:
        return None
    out, at = [], 0
    for a, b, point in spans:
        out += [token[at:a], chr(point)]
        at = b
    return "".join([*out, token[at:]])


def is_whole(token: str, read_as: str) -> bool:
    """Whether every character beyond ASCII lies in a multibyte span."""
    table = ENCODE[read_as]
    spans = multibyte_spans([ord(c) if c < "\x80" else table.get(c, -1) for c in token])
    return sum(b - a for a, b, _ in spans) == sum(c >= "\x80" for c in token)


def _one_script(text: str) -> bool:
    """Whether all characters beyond ASCII are letters, and all letters of one script."""
    return all(c < "\x80" or c.isalpha() for c in text) and len({script(c) for c in text if c.isalpha()}) < 2


def _shape(token: str) -> str:
    """How a token counts: lower case, digit runs as one, ends marked."""
    return "\x02" + DIGITS.sub("0", token).replace("İ", "i").lower() + "\x03"


_CASE = str.maketrans({"İ": "i", "I": "i", "ı": "i", "\u0307": ""})


def _same_letters(a: str, b: str) -> bool:
    return a.translate(_CASE).casefold() == b.translate(_CASE).casefold()


def _slots(text: str) -> tuple[int, int]:
    """The places of a text in the two rows of the table; the same in every process."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return zlib.crc32(raw) % SLOTS, SLOTS + zlib.adler32(raw + raw[::-1], zlib.crc32(raw[::-1])) % SLOTS


class Statistics:
    """Counts of character triples and of characters over a corpus, as a count-min
    sketch of two rows. Both kinds share it: a character is a key of length one."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def count(self, text: str) -> float:
        a, b = _slots(text)
        return float(min(self.table[a], self.table[b]))

    def _log(self, triple: str) -> float:
        seen = min(self.count(c) for c in triple)
        return math.log(self.count(triple) + 0.3 * min(1.0, seen / 50) + 0.02)

    def score(self, token: str) -> float:
        """Mean log count of the triples that hold a character beyond ASCII, or of all
        if none does."""
        n = _shape(token)
        triples = [n[i : i + 3] for i in range(len(n) - 2)]
        logs = [self._log(g) for g in triples if not g.isascii()] or [self._log(g) for g in triples]
        return sum(logs) / len(logs)

    def gain(self, old: str, new: str) -> tuple[float, float]:
        """Scores of two readings of equal length over the triples in which they differ."""
        a, b = _shape(old), _shape(new)
        if len(a) != len(b):
            return self.score(old), self.score(new)
        at = [i for i in range(len(a) - 2) if a[i : i + 3] != b[i : i + 3]]
        if not at:
            return 0.0, 0.0
        return sum(self._log(a[i : i + 3]) for i in at) / len(at), sum(self._log(b[i : i + 3]) for i in at) / len(at)


def gather(values: DataFrame) -> Statistics:
    """Statistics of a one-column DataFrame of all texts. Each worker counts its own
    partitions; what is shuffled and gathered has 2 * SLOTS rows at most, however large
    the corpus."""
    name = values.columns[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(2 * SLOTS, np.int64)
        words: Counter = Counter()

        def flush() -> None:
            for w, n in words.items():
                s = _shape(w)
                for key in (*(s[i : i + 3] for i in range(len(s) - 2)), *s):
                    for k in _slots(key):
                        table[k] += n
            words.clear()

        for b in batches:
            codes, distinct = pd.factorize(b[name])
            for v, n in zip(distinct, np.bincount(codes[codes >= 0], minlength=len(distinct))):
                for w in BLANK.split(v)[::2]:
                    if w:
                        words[w] += int(n)
            if len(words) > 200_000:
                flush()
        flush()
        used = np.flatnonzero(table)
        yield pd.DataFrame({"slot": used, "n": table[used]})

    got = values.where(F.col(name).isNotNull()).mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(2 * SLOTS, np.float32)
    table[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.float32)
    return Statistics(table)


class Restorer:
    """Judges texts by a corpus's statistics; one instance per worker."""

    def __init__(self, stats: Statistics):
        self.stats = stats
        self.token = per_value_one(self._token)

    def _readings(self, token: str) -> Iterator[str]:
        """The token with its bytes re-read under each pair of single-byte encodings."""
        for wrong in MISREAD_AS:
            table = ENCODE[wrong]
            codes = [ord(c) if c < "\x80" else table.get(c, -1) for c in token]
            if -1 in codes:
                continue
            for right in WRITTEN_IN:
                if right != wrong:
                    d = DECODE[right]
                    chars = [chr(b) if b < 0x80 else d[b] for b in codes]
                    if None not in chars:
                        yield "".join(chars)

    def _unlayered(self, token: str) -> str | None:
        """The best reading after one or more rounds of decoding multibyte spans. Where the
        text as it stands is the more usual one, a certain reading is still taken, of several the
        last layer's: so a garble counts as one however common it is. Each decoding shortens
        the text, so rounds end by themselves."""
        seen = {token}
        layer = [token]
        best: tuple[bool, float, str] | None = None
        certain: tuple[int, float, str] | None = None
        sure = {token}
        depth = 0
        while layer:
            depth += 1
            following = []
            for t in layer:
                for e in READ_AS:
                    new = decode_spans(t, e)
                    if new is not None and new not in seen:
                        seen.add(new)
                        following.append(new)
                        found = self._plausible(new), self.stats.score(new), new
                        if best is None or found > best:
                            best = found
                        if t in sure and is_whole(t, e):
                            sure.add(new)
                            if found[0] and self._certain(t, new):
                                certain = max(certain or (0, 0.0, ""), (depth, *found[1:]))
            layer = following
        if best is None or not best[0] or best[1] < self._base(token):
            return certain[2] if certain else None
        return best[2]

    def _certain(self, old: str, new: str) -> bool:
        """Judges a reading that leaves no character of the old text undecoded, by nothing that the
        old text's own rows count for: its letters are of one script, and the corpus writes all
        its characters beyond ASCII, or it is all letters where the old text isn't."""
        if len({script(c) for c in new if c.isalpha()}) > 1:
            return False
        if all(c < "\x80" or self.stats.count(c.lower()) >= KNOWN for c in new):
            return True
        return _one_script(new) and not _one_script(old) and not any(c.isspace() or c == "\xad" for c in old)

    def _plausible(self, text: str) -> bool:
        """Without control characters, and of characters that the corpus has or that are
        letters of its scripts."""
        return not CONTROL.search(text) and all(c < "\x80" or script(c) in SCRIPTS or self.stats.count(c.lower()) > 0 for c in text)

    def _base(self, token: str) -> float:
        """How usual a token is, written so or in its ordinary spelling."""
        plain, odd = spelling(token)
        score = self.stats.score(token)
        return max(score, self.stats.score(plain)) if odd and plain else score

    def _token(self, token: str) -> tuple[frozenset[str], str]:
        """(how it is wrongly decoded, restored): of span (multibyte spans), single_byte
        (bytes of one single-byte encoding read as another) and lost (signs for lost characters)."""
        how = set()
        now = self._unlayered(token) or token
        if now != token:
            how.add("span")
        if LOST not in token:
            plain, odd = spelling(token)
            usual = self.stats.score(plain) if odd and plain else AT_LEAST
            best: tuple[float, str] | None = None
            for new in dict.fromkeys(self._readings(token)):
                if new == token or _same_letters(new, token) or CONTROL.search(new):
                    continue
                before, after = self.stats.gain(token, new)
                if after >= max(before + BETTER, usual, AT_LEAST) and (best is None or after > best[0]):
                    best = after, new
            if best and (now == token or self.stats.score(best[1]) > self.stats.score(now)):
                now, how = best[1], {"single_byte"}
        if LOST in now or CONTROL.search(now):
            how.add("lost")
        return frozenset(how), now

    def text(self, text: str) -> tuple[bool, str, bool, str]:
        """(is wrongly decoded in whole or in part, the text with all that could be
        restored, whether nothing of it is lost, how: a comma list)."""
        if text.isascii():
            return False, text, True, ""
        parts = BLANK.split(text)
        how: set[str] = set()
        for i in range(0, len(parts), 2):
            if not parts[i].isascii():
                one, parts[i] = self.token(parts[i])
                how |= one
        return bool(how), "".join(parts), "lost" not in how, ",".join(sorted(how))


def per_value_one(f, cache: int = 200_000):
    kept: dict = {}

    def run(v):
        if v not in kept:
            if len(kept) >= cache:
                kept.clear()
            kept[v] = f(v)
        return kept[v]

    return run


def restore(rows: DataFrame, column: str, stats: Statistics) -> DataFrame:
    """All columns of `rows`, restored, is_whole, and how (a comma list of span, single_byte,
    lost), for the rows whose `column` was wrongly decoded. Null, empty and ASCII texts
    never are, and aren't sent to Python. One narrow stage."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored string, is_whole boolean, how string"
    sent = rows.sparkSession.sparkContext.broadcast(stats.table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = per_value(Restorer(Statistics(sent.value)).text)
        for b in batches:
            got = judge(b[column])
            b = b.assign(restored=[g[1] for g in got], is_whole=[g[2] for g in got], how=[g[3] for g in got])
            yield b[[g[0] for g in got]]

    return rows.where(F.rlike(F.col(column), F.lit(r"[^\x00-\x7F]"))).mapInPandas(run, schema)
