"""Abusive, hateful or sexual passages: a bidirectional gated recurrent network with
attention pooling over word and character inputs, trained and run in numpy.

A document is cut into overlapping windows of words that cover it whole; its score is that
of its highest window. Labels are per document and some are wrong, so training
alternates between fitting windows and choosing which windows a label is about."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.lookalike import spelling
from gridloom.session import scratch_root

WINDOW, STRIDE = 20, 10
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN = 20, 28, 24
#: Labelled documents of each kind that the network is fitted on at most, and the longest text among them.
MAX_ABUSIVE, MAX_OTHER, MAX_CHARS = 1_500, 9_000, 10_000
#: Log odds of its words that a window needs to stand for the label: about three words or
#: word pairs seen in three abusive documents and no other.
EVIDENCE = 4.0
#: Windows of no label that an epoch draws at least.
EPOCH_WINDOWS = 10_000
THRESHOLD = 0.5
SEED = 11
#: Distinct raw words whose form each worker keeps.
CACHE = 200_000
#: Longer runs without blanks are read in pieces: cut at signs, and every so many characters with half as many shared.
PIECE = 40

# Signs that stand for letters in disguised words.
SIGNS = str.maketrans("@$013457", "asoieast")
_INNER = re.compile(r"[^\W_]")
_SPLIT = re.compile(r"\S+")
_EDGE = re.compile(r"^([\"'“”„»«(\[]*)(.*?)([\"'“”„»«)\].,;:!?…]*)$", re.S)
_LONG = re.compile(r"(.)\1{2,}")
_SINGLE = re.compile(r"^[^\W_](?:[^\w\s]|_)(?:[^\W_](?:[^\w\s]|_))+[^\W_]$")
_PART = re.compile(r"[^\W_]+|[\W_]+")


def pieces(raw: str) -> Iterator[str]:
    """A blank-separated run as words of bounded length that cover it whole. Letters set apart
    by signs are joined first, as in word_form."""
    if len(raw) <= PIECE:
        yield raw
        return
    raw = re.sub(r"[\W_]", "", raw) if _SINGLE.match(raw) else raw
    for m in _PART.finditer(raw):
        part = m.group()
        step = PIECE // 2 if _INNER.match(part) else PIECE
        for at in range(0, max(1, len(part) - PIECE + step), step):
            yield part[at : at + PIECE]


def word_form(raw: str) -> list[str]:
    """The normal form of one blank-separated word, with quotes and sentence ends as
    forms of their own. Digits inside a word are read as the letters they look like,
    a letter repeated three times or more counts once, letters set apart by signs are joined."""
    raw = spelling(raw)[0].replace("İ", "i").casefold()
    before, word, after = _EDGE.match(raw).groups()
    out = ['"'] if any(c in "\"“”„»«" for c in before) else []
    if word:
        if _SINGLE.match(word):
            word = re.sub(r"[\W_]", "", word)
        if any(c.isalpha() for c in word):
            if any(c in "@$" for c in word) or (word[0].isalpha() and re.search(r"[^\W\d_]\d[^\W\d_]|[^\W\d_]{2}\d", word) and "-" not in word):
                word = word.translate(SIGNS)
            word = re.sub(r"\d+", "0", word)
            word = _LONG.sub(r"\1", word)
        else:
            word = "0" if any(c.isdigit() for c in word) else word[:1]
        out.append(word)
    if any(c in "\"“”„»«" for c in after):
        out.append('"')
    if any(c in ".!?…" for c in after):
        out.append("!" if "!" in after else ".")
    return out


def grams(word: str) -> list[int]:
    """Slots of a word's letter groups of two to four, ends marked."""
    w = f"<{word}>"
    found = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) % GRAM_SLOTS for g in dict.fromkeys(found)] or [0]


class Words:
    """Numbers for word forms, as they are met."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.forms: list[str] = [""]
        self.raw: dict[str, list[int]] = {}

    def of(self, text: str | None) -> list[int]:
        out: list[int] = []
        for m in _SPLIT.finditer(text or ""):
            raw = m.group()
            got = self.raw.get(raw)
            if got is None:
                got = []
                for piece in pieces(raw):
                    for f in word_form(piece):
                        if f not in self.number:
                            self.number[f] = len(self.forms)
                            self.forms.append(f)
                        got.append(self.number[f])
                if len(raw) <= 10 * PIECE:
                    self.raw[raw] = got
            out += got
        return out

    def full(self) -> bool:
        return len(self.forms) > CACHE or len(self.raw) > 2 * CACHE


def windows(ids: list[int]) -> np.ndarray:
    """All windows of a document, the last one flush with its end; 0 pads short ones."""
    n = len(ids)
    if not n:
        return np.zeros((0, WINDOW), np.int64)
    starts = list(range(0, max(1, n - WINDOW + 1), STRIDE))
    if starts[-1] + WINDOW < n:
        starts.append(n - WINDOW)
    out = np.zeros((len(starts), WINDOW), np.int64)
    for k, s in enumerate(starts):
        part = ids[s : s + WINDOW]
        out[k, : len(part)] = part
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row number."""
    order = np.argsort(rows, kind="stable")
    own, first = np.unique(rows[order], return_index=True)
    out = np.zeros((n, values.shape[1]), np.float32)
    out[own] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters by name in one dict, so that they can be sent and updated alike."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = SEED):
        if p is None:
            r = np.random.default_rng(seed)
            d, h = WORD_DIM + GRAM_DIM, HIDDEN
            f = lambda *s, k=None: (r.standard_normal(s) * (k or 1 / math.sqrt(s[0]))).astype(np.float32)
            p = {"word": f(WORD_SLOTS, WORD_DIM, k=0.1), "gram": f(GRAM_SLOTS, GRAM_DIM, k=0.1)}
            for s in "fb":
                p |= {f"x{s}": f(d, 3 * h), f"h{s}": f(h, 3 * h), f"a{s}": np.zeros(3 * h, np.float32), f"c{s}": np.zeros(h, np.float32)}
            p |= {"wa": f(2 * h, h), "ba": np.zeros(h, np.float32), "va": f(h), "wo": f(2 * h), "bo": np.array([-1.0], np.float32)}
        self.p = p

    def inputs(self, forms: list[str]) -> dict:
        """Slots of the given word forms."""
        word = np.array([zlib.crc32(b"w" + f.encode("utf-8", "replace")) % WORD_SLOTS for f in forms], np.int64)
        per = [grams(f) for f in forms]
        sizes = np.array([len(x) for x in per], np.int64)
        return {"word": word, "gram": np.concatenate([np.array(x, np.int64) for x in per]), "starts": np.r_[0, np.cumsum(sizes)[:-1]], "sizes": sizes}

    @staticmethod
    def some(i: dict, rows: np.ndarray) -> dict:
        """The slots of some of the forms."""
        sizes = i["sizes"][rows]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.repeat(i["starts"][rows] - starts, sizes) + np.arange(sizes.sum())
        return {"word": i["word"][rows], "gram": i["gram"][at], "starts": starts, "sizes": sizes}

    def vectors(self, i: dict) -> np.ndarray:
        chars = np.add.reduceat(self.p["gram"][i["gram"]], i["starts"], axis=0) / np.sqrt(i["sizes"])[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][i["word"]], chars], axis=1)

    def projected(self, v: np.ndarray) -> dict[str, np.ndarray]:
        return {s: v @ self.p[f"x{s}"] + self.p[f"a{s}"] for s in "fb"}

    def forward(self, proj: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows of ids into the rows of proj."""
        p, h = self.p, HIDDEN
        b, t = ids.shape
        mask = (ids != 0).astype(np.float32)
        states = np.empty((t, b, 2 * h), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for s, order, at in (("f", range(t), 0), ("b", range(t - 1, -1, -1), h)):
            hs = np.zeros((b, h), np.float32)
            for k in order:
                x = proj[s][ids[:, k]]
                u = hs @ p[f"h{s}"]
                rz = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                un = u[:, 2 * h :] + p[f"c{s}"]
                n = np.tanh(x[:, 2 * h :] + r * un)
                m = mask[:, k : k + 1]
                new = hs + m * (1 - z) * (n - hs)
                if keep:
                    saved[s].append((k, hs, r, z, un, n, m))
                hs = new
                states[k, :, at : at + h] = hs
        e = np.tanh(states @ p["wa"] + p["ba"])
        score = e @ p["va"] + (mask.T - 1) * 1e9
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, (mask, states, saved, e, w, pooled)) if keep else logit

    def gradient(self, i: dict, ids: np.ndarray, goal: np.ndarray, weight: np.ndarray, drop: np.random.Generator | None) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted cross entropy of windows against goals."""
        p, h = self.p, HIDDEN
        v = self.vectors(i)
        if drop is not None:  # whole words lose their word part, so that characters must do
            v[:, :WORD_DIM] *= (drop.random((len(v), 1)) > 0.3).astype(np.float32)
            v *= (drop.random(v.shape) > 0.1).astype(np.float32) / 0.9
        proj = self.projected(v)
        logit, (mask, states, saved, e, w, pooled) = self.forward(proj, ids, True)
        prob = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - goal * logit)).sum() / weight.sum())
        d = (weight * (prob - goal) / weight.sum()).astype(np.float32)
        g: dict[str, np.ndarray] = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["wo"]
        ds = w[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", states, dp)
        dscore = w * (dw - (w * dw).sum(0))
        g["va"] = np.einsum("tb,tbh->h", dscore, e)
        de = dscore[:, :, None] * p["va"] * (1 - e * e)
        t, b = dscore.shape
        g["wa"] = states.reshape(t * b, -1).T @ de.reshape(t * b, -1)
        g["ba"] = de.sum((0, 1))
        ds += de @ p["wa"].T
        dv = np.zeros_like(v)
        for s, at in (("f", 0), ("b", h)):
            u, gu, gc = p[f"h{s}"], np.zeros_like(p[f"h{s}"]), np.zeros(h, np.float32)
            steps: list[np.ndarray] = []
            dh = np.zeros((b, h), np.float32)
            for k, hs, r, z, un, n, m in reversed(saved[s]):
                dh = dh + ds[k][:, at : at + h]
                step = m * dh
                dn = step * (1 - z) * (1 - n * n)
                dz = step * (hs - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dr, dz, dn * r], axis=1)
                dx = np.concatenate([dr, dz, dn], axis=1)
                gu += hs.T @ du
                gc += du[:, 2 * h :].sum(0)
                dh = dh - step * (1 - z) + du @ u.T
                steps.append(dx * m)
            at_k = [k for k, *_ in reversed(saved[s])]
            dproj = _summed(ids[:, at_k].T.ravel(), np.concatenate(steps), len(v))
            g[f"h{s}"], g[f"c{s}"], g[f"x{s}"], g[f"a{s}"] = gu, gc, v.T @ dproj, dproj.sum(0)
            dv += dproj @ p[f"x{s}"].T
        g["word"] = (i["word"], dv[:, :WORD_DIM])
        g["gram"] = (i["gram"], np.repeat(dv[:, WORD_DIM:] / np.sqrt(i["sizes"])[:, None].astype(np.float32), i["sizes"], axis=0))
        return g, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.003):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        scale = self.rate * math.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            if isinstance(x, tuple):
                rows, back = np.unique(x[0], return_inverse=True)
                one = _summed(back, x[1], len(rows))
                m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * one
                v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * one * one
                self.p[k][rows] -= scale * (m / (np.sqrt(v) + 1e-8)) + self.rate * 1e-3 * self.p[k][rows]
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * x
                self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
                self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _first_guess(docs: list[np.ndarray], labels: np.ndarray, ends: frozenset[int], prior: float = 5.0) -> list[np.ndarray]:
    """For each window, how much its words and the word pairs inside its sentences speak
    for the label: the sum of its three strongest log odds, each drawn to the base rate
    as if seen in `prior` more documents."""
    def features(w: np.ndarray) -> set:
        ids = [int(x) for x in w if x]
        return {x for x in ids if x not in ends} | {(x, y) for x, y in zip(ids, ids[1:]) if x not in ends and y not in ends}
    per = [[features(w) for w in d] for d in docs]
    pos, neg = Counter(), Counter()
    for fs, y in zip(per, labels):
        (pos if y > 0.5 else neg).update(set().union(*fs) if fs else ())
    base = float((labels > 0.5).mean())
    def odds(f) -> float:
        p = (pos[f] + prior * base) / (pos[f] + neg[f] + prior)
        return math.log(p / (1 - p)) - math.log(base / (1 - base)) if pos[f] >= 2 else 0.0
    known = {f: odds(f) for f in pos}
    return [np.array([sum(sorted((max(0.0, known.get(f, 0.0)) for f in w), reverse=True)[:3]) for w in fs]) for fs in per]


def _fit(slots: dict, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, epochs: int, seed: int, hard: np.ndarray | None = None) -> Network:
    """A network fitted on windows x[pos] against x[neg], of which each epoch draws others,
    and x[hard], which count as often as x[pos], so that a sentence is scored by how often it
    is labelled so."""
    rng = np.random.default_rng(seed)
    net = Network(seed=seed)
    adam = Adam(net.p)
    for epoch in range(epochs):
        some = rng.permutation(neg)[: max(EPOCH_WINDOWS, 4 * len(pos))]
        times = max(1, min(8, len(some) // max(1, 4 * len(pos))))
        rows = rng.permutation(np.concatenate([np.repeat(pos, times), np.repeat(rng.permutation(hard)[: 4 * EPOCH_WINDOWS // times], times) if hard is not None else some[:0], some]))
        if epoch == epochs - 2:
            adam.rate /= 4
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            used, local = np.unique(x[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            if used[0] != 0:  # 0 is padding everywhere
                used, local = np.r_[0, used], local + 1
            goal = np.isin(part, pos).astype(np.float32)
            g, _ = net.gradient(net.some(slots, used), local, goal, np.ones(len(part), np.float32), rng)
            norm = math.sqrt(sum(float(np.square(v[1] if isinstance(v, tuple) else v).sum()) for v in g.values()))
            if norm > 5:
                g = {n: (v[0], v[1] * (5 / norm)) if isinstance(v, tuple) else v * (5 / norm) for n, v in g.items()}
            adam.step(g)
    return net


def train(texts: list[str], labels: np.ndarray, passes: int = 3, folds: int = 2, epochs: int = 6, seed: int = SEED) -> Network:
    """Fits the network on labelled texts of which some labels are wrong.

    In each pass, every fold's windows are scored by a network fitted on the other
    folds: a window stands for the label abusive if such a document's held-out score
    is high there; documents whose held-out scores contradict their label are left out. The
    last network is fitted on all that remain. Without labels of both kinds the result
    finds nothing."""
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [windows(words.of(t)) for t in texts]
    filled = [k for k, d in enumerate(docs) if len(d)]
    docs, labels = [docs[k] for k in filled], np.asarray(labels, float)[filled]
    if not docs or not (labels > 0.5).any() or not (labels <= 0.5).any():
        net = Network(seed=seed)
        net.p["wo"][:] = 0
        net.p["bo"][:] = -10
        return net
    slots = Network(seed=seed).inputs(words.forms)
    x = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    abusive = (labels > 0.5)[owner]
    fold = rng.integers(0, folds, len(docs))[owner]
    ends = frozenset(words.number[f] for f in (".", "!", '"', "0") if f in words.number)
    guess = np.concatenate(_first_guess(docs, labels, ends))
    top = np.repeat(np.maximum.reduceat(guess, starts), sizes)
    pos = abusive & (guess >= np.maximum(top * 0.9, EVIDENCE))
    neg = ~abusive & (top < 2 * EVIDENCE)
    hard = np.zeros(len(x), bool)
    for k in range(passes):
        prob = np.zeros(len(x), np.float32)
        for f in range(folds):
            a, b = np.flatnonzero(pos & (fold != f)), np.flatnonzero(neg & ~hard & (fold != f))
            if len(a) and len(b):
                net = _fit(slots, x, a, b, epochs, seed + 10 * k + f, np.flatnonzero(hard & (fold != f)))
                held = np.flatnonzero(fold == f)
                prob[held] = scores(net, net.projected(net.vectors(slots)), x[held])
        top = np.repeat(np.maximum.reduceat(prob, starts), sizes)
        if not (abusive & (top >= 0.9) & (guess >= EVIDENCE)).any():
            break
        pos = abusive & (top >= 0.9) & (prob >= 0.9 * top) & (guess >= EVIDENCE)
        neg = (~abusive & (top < 0.9)) | (abusive & (top >= 0.8) & (prob < 0.02))
        # Windows of other documents that look abusive: ordinary sentences, and some abusive ones
        # without their label.
        hard = ~abusive & (prob >= 0.03)
    return _fit(slots, x, np.flatnonzero(pos), np.flatnonzero(neg & ~hard), epochs + 2, seed, np.flatnonzero(hard))


def scores(net: Network, proj: dict[str, np.ndarray], x: np.ndarray, batch: int = 2048) -> np.ndarray:
    return np.concatenate([_sigmoid(net.forward(proj, x[i : i + batch])) for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)


class Scorer:
    """Scores whole documents; one instance per worker. Projections of words met are kept."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.words = Words()
        self.proj = {s: np.zeros((1024, 3 * HIDDEN), np.float32) for s in "fb"}
        self.done = 0

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's score of each; 0 for null and blank texts."""
        if self.words.full():
            self._reset()
        out = np.zeros(len(texts))
        part, owner, n = [], [], 0
        for k, t in enumerate(texts):
            w = windows(self.words.of(t))
            if len(w):
                part.append(w)
                owner.append(np.full(len(w), k))
                n += len(w)
            if n >= 8192 or k == len(texts) - 1:
                if part:
                    self._grow()
                    np.maximum.at(out, np.concatenate(owner), scores(self.net, self.proj, np.concatenate(part)))
                part, owner, n = [], [], 0
        return out

    def _grow(self) -> None:
        forms = self.words.forms
        if self.done < len(forms):
            new = self.net.projected(self.net.vectors(self.net.inputs(forms[self.done :])))
            for s in "fb":
                if len(forms) > len(self.proj[s]):
                    self.proj[s] = np.concatenate([self.proj[s], np.zeros((len(forms), 3 * HIDDEN), np.float32)])
                self.proj[s][self.done : len(forms)] = new[s]
            self.done = len(forms)


def sample_labelled(documents: DataFrame, labels: DataFrame, max_abusive: int = MAX_ABUSIVE, max_other: int = MAX_OTHER, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Texts and mean labels of a bounded sample: the labelled documents of each kind that come
    first in the order of a seeded hash of their doc_id. They are chosen from the labels
    alone; only their texts are fetched. Null labels count as none; null texts and those
    longer than MAX_CHARS aren't fitted on (they are scored like all others); equal texts are
    one, with the mean of their labels."""
    one = labels.where(F.col("is_abusive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("is_abusive").alias("y"))
    one = one.withColumn("k", F.xxhash64("doc_id", F.lit(seed)))
    ids = one.where("y >= 0.5").orderBy("k", "doc_id").limit(max_abusive).unionAll(one.where("y < 0.5").orderBy("k", "doc_id").limit(max_other)).drop("k")
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)).join(F.broadcast(ids), "doc_id")
    per: dict[str, list[float]] = {}
    place: dict[str, int] = {}
    for r in rows.withColumn("k", F.xxhash64("text", F.lit(seed))).collect():
        per.setdefault(r["text"], []).append(r["y"])
        place[r["text"]] = r["k"]
    texts = sorted(per, key=lambda t: (place[t], t))
    return texts, np.array([sum(per[t]) / len(per[t]) for t in texts], np.float64)


def fitted(documents: DataFrame, labels: DataFrame) -> Network:
    """The network for these labels, from the shared folder if it was fitted on the same
    sample before, by whichever query: its name is a hash of the sample and of all settings."""
    spark = documents.sparkSession
    texts, y = sample_labelled(documents, labels)
    h = hashlib.sha256(repr((np.__version__, WINDOW, STRIDE, WORD_SLOTS, GRAM_SLOTS, WORD_DIM, GRAM_DIM, HIDDEN, EVIDENCE, EPOCH_WINDOWS, PIECE, SEED)).encode())
    for t, one in zip(texts, y):
        raw = t.encode("utf-8", "replace")
        h.update(b"%d %r " % (len(raw), one) + raw)
    path = f"{scratch_root(spark)}/gridloom-network-{h.hexdigest()[:32]}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return Network({r["name"]: np.frombuffer(bytes(r["raw"]), np.float32).reshape(r["size"]).copy() for r in spark.read.parquet(path).collect()})
    net = train(texts, y)
    rows = [(k, bytearray(np.ascontiguousarray(v, np.float32).tobytes()), list(v.shape)) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, raw binary, size array<int>").coalesce(1).write.mode("overwrite").parquet(path)
    return net


def score_documents(documents: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """keep and score (0 to 1) of every document. Null, empty and blank texts score 0.
    One narrow stage; the network (4 MB) is sent to each worker."""
    sent = documents.sparkSession.sparkContext.broadcast(net.p)
    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = documents.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Network(sent.value))
        for b in batches:
            yield b[keep].assign(score=scorer.texts(b["_text"].tolist()))

    return rows.mapInPandas(run, f"{types}, score double")
