"""Byte-level pair encoding with a public vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the vocabulary's texts are cut into words; blanks are Unicode's White_Space.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept with their ids by each worker, and the longest of them in bytes.
CACHE = 200_000
CACHED_BYTES = 48
#: Characters of text worked on at once.
BATCH_CHARS = 2_000_000
NO_RANK = np.int32(2**31 - 1)
#: Words of more bytes take rounds of one rank each, which touch only what they merge.
LONG_BYTES = 256
#: Pairs that such rounds hold sorted by rank at once.
NEAR = 16_384


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable
    Latin-1 characters for themselves, all others by their order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pairs:
    """The merges of a vocabulary as arrays: keys of symbol pairs in order, with the
    rank of each and the symbol that it becomes; and the symbol of each byte."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, becomes: np.ndarray, first: np.ndarray):
        self.keys, self.ranks, self.becomes, self.first = keys, ranks, becomes, first

    @classmethod
    def read(cls, path: str | Path) -> Pairs:
        """From a vocabulary file with 'vocab' and ordered 'merges'."""
        model = json.loads(Path(path).read_text("utf-8"))["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            first[byte] = ids[letter]
        return cls(keys[order], order.astype(np.int32), np.array([ids[a + b] for a, b in merges], np.int64)[order], first)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NO_RANK, merged symbol) of each pair, by binary search over the sorted keys."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], NO_RANK), self.becomes[at]

    def _merge_long(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of the symbols left when all pairs are merged, lowest rank first.

        Symbols are linked to their neighbours, and each holds the rank of the pair that it
        begins. A round takes the places of the lowest rank from an index by rank, merges
        them left to right, and looks up only the pairs beside them. The index holds the
        next NEAR pairs sorted, all others unsorted. Words don't share pairs, so that all go
        through the same rounds."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.r_[word[1:] != word[:-1], True]
        after[ends] = -1
        before[np.r_[0, np.flatnonzero(ends)[:-1] + 1]] = -1
        rank = np.full(n, NO_RANK, np.int32)
        into = np.zeros(n, np.int64)
        inner = np.flatnonzero(~ends)
        rank[inner], into[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        far = [(rank[inner], inner)]
        near: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def file(ranks: np.ndarray, places: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            ranks, places = ranks[by], places[by]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
            for r, part in zip(ranks[cuts].tolist(), np.split(places, cuts[1:])):
                if r not in near:
                    near[r] = []
                    heapq.heappush(order, r)
                near[r].append(part)

        while True:
            if not order:
                ranks, places = (np.concatenate(x) for x in zip(*far))
                open_ = (ranks != NO_RANK) & (rank[places] == ranks)
                ranks, places = ranks[open_], places[open_]
                if not len(ranks):
                    break
                size = max(NEAR, len(ranks) // 16)
                limit = np.partition(ranks, size)[size] if len(ranks) > size else NO_RANK
                now = ranks <= limit
                far = [(ranks[~now], places[~now])]
                file(ranks[now], places[now])
            lowest = heapq.heappop(order)
            places = np.unique(np.concatenate(near.pop(lowest)))
            places = places[rank[places] == lowest]
            if not len(places):
                continue
            runs = np.r_[True, after[places[:-1]] != places[1:]]
            count = np.arange(len(places))
            places = places[(count - np.maximum.accumulate(np.where(runs, count, 0))) % 2 == 0]
            gone = after[places]
            following = after[gone]
            symbols[places] = into[places]
            symbols[gone], rank[gone] = -1, NO_RANK
            after[places] = following
            has = following >= 0
            before[following[has]] = places[has]
            rank[places[~has]] = NO_RANK
            left = before[places]
            beside = np.unique(np.r_[left[left >= 0], places[has]])
            if len(beside):
                ranks, into[beside] = self._ranks(symbols[beside], symbols[after[beside]])
                rank[beside] = ranks
                now = ranks <= limit
                now &= ranks != NO_RANK
                if now.any():
                    file(ranks[now], beside[now])
                later = ~now & (ranks != NO_RANK)
                if later.any():
                    far.append((ranks[later], beside[later]))
        left = symbols >= 0
        return word[left], symbols[left]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in one array, and where each word ends in it.

        In a round, each word that still has a known pair merges all places of its
        lowest-ranked one, left to right; words without one leave the array. Long words
        would hold the whole array in it for as many rounds as they have ranks; they have
        rounds of their own."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word: list[np.ndarray] = []
        done_ids: list[np.ndarray] = []
        long = sizes[word] > LONG_BYTES
        if long.any():
            at, ids = self._merge_long(symbols[long], word[long])
            done_word.append(at)
            done_ids.append(ids)
            symbols, word = symbols[~long], word[~long]
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int32)
            if len(symbols) > 1:
                same = word[:-1] == word[1:]
                rank[:-1][same] = self._ranks(symbols[:-1][same], symbols[1:][same])[0]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff(np.r_[starts, len(word)]))
            out = each == NO_RANK
            if out.any():
                done_word.append(word[out])
                done_ids.append(symbols[out])
            places = np.flatnonzero((rank == each) & ~out)
            if len(places):
                runs = np.r_[True, np.diff(places) != 1]
                since = np.arange(len(places)) - np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))
                places = places[since % 2 == 0]
                symbols[places] = self.becomes[np.searchsorted(self.keys, symbols[places] << 32 | symbols[places + 1])]
                out[places + 1] = True
            symbols, word = symbols[~out], word[~out]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.cumsum(np.bincount(word, minlength=len(words)))


class Encoder:
    """Texts to ids; keeps the ids of short words that it has met."""

    def __init__(self, pairs: Pairs):
        self.pairs = pairs
        self.cut = regex.compile(CUT, regex.V1).findall
        self.kept: dict[str, np.ndarray] = {}

    def _words(self, cut: list[list[str]]) -> dict[str, np.ndarray]:
        new = list({w for ws in cut for w in ws if w not in self.kept})
        raw = [w.encode("utf-8", "replace") for w in new]
        ids, ends = self.pairs.encode(raw)
        if len(self.kept) + len(new) > CACHE:
            here = {w: self.kept[w] for ws in cut for w in ws if w in self.kept}
            self.kept = {}
        else:
            here = self.kept
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        fresh = {}
        for w, b, i, j in zip(new, raw, starts, ends):
            (self.kept if len(b) <= CACHED_BYTES and len(self.kept) < CACHE else fresh)[w] = ids[i:j]
        return {**here, **self.kept, **fresh} if fresh or here is not self.kept else self.kept

    def texts(self, texts: Iterable[str]) -> list[np.ndarray]:
        cut = [self.cut(t) if t else [] for t in texts]
        known = self._words(cut)
        none = np.zeros(0, np.int32)
        return [np.concatenate([known[w] for w in ws]) if ws else none for ws in cut]

    def batches(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The same in parts of BATCH_CHARS characters or one text."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield self.texts(part)
                part, size = [], 0
        if part:
            yield self.texts(part)


def _mapped(df: DataFrame, id_cols: list[str], text: str, vocabulary: str, only_counts: bool) -> DataFrame:
    pairs = Pairs.read(vocabulary)
    sent = df.sparkSession.sparkContext.broadcast((pairs.keys, pairs.ranks, pairs.becomes, pairs.first))
    chosen = df.select(*id_cols, F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pairs(*sent.value))
        for b in batches:
            at = 0
            for got in encoder.batches(b.column(len(id_cols)).to_pylist()):
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                if only_counts:
                    made = pa.array(sizes, pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(got) if got else [], pa.int32()))
                own = [b.column(i).slice(at, len(got)) for i in range(len(id_cols))]
                at += len(got)
                yield pa.RecordBatch.from_arrays([*own, made], names=[*id_cols, "n_tokens" if only_counts else "ids"])

    return chosen.mapInArrow(run, f"{types}, {'n_tokens bigint' if only_counts else 'ids array<int>'}")


def token_ids(df: DataFrame, id_cols: list[str], text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """id_cols and ids of every row, whole texts, special tokens' strings as ordinary text.
    A null and an empty text give an empty list. One narrow stage; the vocabulary's
    arrays (1 MB) are read on the driver and sent."""
    return _mapped(df, id_cols, text, vocabulary, False)


def token_counts(df: DataFrame, id_cols: list[str], text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """id_cols and n_tokens of every row."""
    return _mapped(df, id_cols, text, vocabulary, True)


def id_bytes(vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> list[bytes]:
    """What each id of a byte-level vocabulary stands for."""
    letters = byte_letters()
    vocab = json.loads(Path(vocabulary).read_text("utf-8"))["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        if all(c in letters for c in word):
            out[i] = bytes(letters[c] for c in word)
    return out


def texts_of(df: DataFrame, id_cols: list[str], ids: str = "ids", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """id_cols and the text that the ids of every row stand for; an empty list gives an
    empty text. One narrow stage."""
    sent = df.sparkSession.sparkContext.broadcast(id_bytes(vocabulary))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"".join(map(sent.value.__getitem__, x)).decode("utf-8", "replace") for x in b.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*id_cols, "text"])

    return df.select(*id_cols, F.col(ids).alias("_ids")).mapInArrow(run, f"{types}, text string")
