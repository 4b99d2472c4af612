"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares two words by their common letter triples, in order but with gaps, each weighted
by ``DECAY`` to the length it spans (up to ``SPAN`` letters), normalised to 1 for equal words; values under
``NEAR`` count as 0. Inserted characters thus cost some weight only. Letters spelled one by one are read as one
word, signs inside words are left out, and common digit-for-letter swaps are undone.

A text is split into sentences. A sentence is compared with a landmark by its best word, and a document scores as its
best sentence: one insult in a long text counts in full, and what is said in other sentences adds nothing.

Landmarks are the ``LANDMARKS`` words and beginnings of words (``PREFIX`` letters) whose document
frequency differs most (chi-square) between the labelled classes, and ``COMMON`` words of clean text:
of the frequent ones, those most like the former. Kernel values to them, times the inverse
root of the landmarks' own kernel matrix, are the Nystrom features of a linear machine (squared hinge,
Newton steps). It is trained on sentences: those of clean documents are clean; of a toxic document the one sentence that
the machine of the last of ``TURNS`` turns scores highest is toxic, at first the one nearest to the landmarks. The
best sentence's margin becomes a probability by a logistic fit on the same documents.

Fitting takes at most about ``PER_CLASS`` labelled rows a class, drawn by hash, and of each at most ``SENTENCES``
different sentences, those nearest to landmarks (documented bounds); scoring covers every word of every text.

Defined results: null and empty texts score as texts without any known word. Without labels of both
classes every text scores 0 (or 1, if only toxic rows were labelled). Null labels teach nothing; of
conflicting labels the larger counts. Texts of equal sentences score alike; repeated rows and null ids are each scored;
empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, plus, table, tuned
from .language_id import fold

LETTERS = 40
DECAY = 0.6
SPAN = 6
NEAR = 0.45
LANDMARKS = 96
COMMON = 64
#: Frequent words of clean text among which those are sought.
FREQUENT = 20_000
PREFIX = (4, 5, 6, 7, 8)
PER_CLASS = 6_000
SENTENCES = 8
TURNS = 3
LONG = 24
MEMO = 300_000

#: Signs that stand for letters.
SWAPS = str.maketrans("013457@$", "oieastas")

_STARTS = {}
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def words_of(text: str | None) -> set[str]:
    """Distinct words as the kernel sees them; runs of single letters count as one word too."""
    out: set[str] = set()
    run: list[str] = []
    for w in (text or "").lower().split():
        if not w.isalpha():
            core = w.strip(".,;:!?\"'()|-*#%$&[]{}<>/\\_~`^+=")
            w = core if core.isalpha() else "".join(c for c in core.translate(SWAPS) if c.isalpha())
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.add(f"<{''.join(run)}>")
        run = []
        if len(w) > 2:
            out.add(f"<{w}>")
    if len(run) > 2:
        out.add(f"<{''.join(run)}>")
    return out


def _codes(words: list[str], n: int) -> np.ndarray:
    """Letters as small numbers; the ends of a word, ``<`` and ``>``, are letters of their own."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
    return np.where((c >= 97) & (c <= 122), c - 97, np.where(c == 60, 26, np.where(c == 62, 27, 28 + c % 12))).astype(np.int64)


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the triples of a word of n letters."""
    if n not in _STARTS:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN - 1)) for k in range(j + 1, min(n, i + SPAN))]
        _STARTS[n] = np.array(at, np.int64).reshape(-1, 3), np.array([DECAY ** (k - i + 1) for i, _, k in at])
    return _STARTS[n]


def _windows(words: list[str]) -> tuple[list[str], list[int]]:
    """Words of over LONG letters are compared window by window, half a window apart."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for a in range(0, max(1, len(w) - LONG // 2), LONG // 2) if len(w) > LONG else (0,):
            parts.append(w[a : a + LONG])
            owner.append(i)
    return parts, owner


def _norms(idx: np.ndarray, weight: np.ndarray) -> np.ndarray:
    order = np.argsort(idx, axis=1, kind="stable")
    s, w = np.take_along_axis(idx, order, 1), weight[order]
    run = np.concatenate([np.zeros((len(s), 1), bool), s[:, 1:] == s[:, :-1]], axis=1)
    total = np.zeros(len(s))
    acc = np.zeros(len(s))
    for t in range(s.shape[1]):
        acc = np.where(run[:, t], acc, 0.0) + w[:, t]
        last = ~run[:, t + 1] if t + 1 < s.shape[1] else np.ones(len(s), bool)
        total += np.where(last, acc * acc, 0.0)
    return np.sqrt(total)


class Kernel:
    """Normalised kernel values of words to a list of landmarks; values under NEAR count as 0."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.t = np.zeros((LETTERS**3, len(landmarks)), np.float32)
        for m, w in enumerate(landmarks):
            w = w[:LONG]
            at, weight = _triples(len(w))
            c = _codes([w], len(w))[0]
            np.add.at(self.t[:, m], (c[at[:, 0]] * LETTERS + c[at[:, 1]]) * LETTERS + c[at[:, 2]], weight)
        self.t /= np.maximum(np.sqrt((self.t**2).sum(axis=0)), 1e-12)
        self.most = self.t.max(axis=1, initial=0.0)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are near some landmark, and their values to all of them."""
        parts, owner = _windows(words)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            by.setdefault(len(p), []).append(i)
        found: dict[int, np.ndarray] = {}
        for n, rows in by.items():
            at, weight = _triples(n)
            if not len(at):
                continue
            low = float(np.sqrt((weight**2).sum()))  # no word of n letters has a smaller norm
            for a in range(0, len(rows), 4096):
                some = rows[a : a + 4096]
                c = _codes([parts[i] for i in some], n)
                idx = (c[:, at[:, 0]] * LETTERS + c[:, at[:, 1]]) * LETTERS + c[:, at[:, 2]]
                ok = np.flatnonzero(self.most[idx] @ weight >= NEAR * low)
                if not len(ok):
                    continue
                idx = idx[ok]
                k = np.zeros((len(ok), self.t.shape[1]), np.float32)
                for t in range(idx.shape[1]):
                    k += np.float32(weight[t]) * self.t[idx[:, t]]
                k /= _norms(idx, weight)[:, None]
                k[k < NEAR] = 0
                for r in np.flatnonzero(k.any(axis=1)):
                    o = owner[some[ok[r]]]
                    found[o] = np.maximum(found[o], k[r]) if o in found else k[r]
        keys = sorted(found)
        return np.array(keys, np.int64), np.array([found[o] for o in keys], np.float32).reshape(len(keys), self.t.shape[1])


class Features:
    """Of texts the kernel values of their sentences; MEMO bounds what is remembered."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.seen, self.rows = kernel, set(), {}

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, best value to each landmark) of the different sentences that are near some landmark. A word
        that is near none adds nothing, so a text's other sentences are all alike: no value at all."""
        split = [words_of(t) for t in texts]
        if len(self.seen) > MEMO:
            self.seen, self.rows = set(), {}
        new = list(set().union(*split) - self.seen) if split else []
        at, values = self.kernel.near(new)
        self.rows.update((new[i], v) for i, v in zip(at, values, strict=True))
        self.seen.update(new)
        owner, found = [], []
        for i, (t, ws) in enumerate(zip(texts, split, strict=True)):
            near = self.rows.keys() & ws
            if not near:
                continue
            if len(near) == 1:  # whichever sentence holds it
                sentences = {frozenset(near)}
            else:
                sentences = {frozenset(near & words_of(x)) for x in _SENTENCE.split(t)} - {frozenset()}
                # a spelled word may go over a sentence's end
                sentences |= {frozenset([w]) for w in near - frozenset().union(*sentences)}
            for x in sorted(sentences, key=sorted):
                owner.append(i)
                found.append(np.maximum.reduce([self.rows[w] for w in x]))
        return np.array(owner, np.int64), np.array(found, np.float32).reshape(len(owner), len(self.kernel.landmarks))


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability of y as a logistic function of the margin, by Newton steps on smoothed targets. The rarer class weighs
    more, by the root of its rarity: the share of toxic rows among the labelled ones is not that of the corpus."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    each = np.sqrt(np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg)))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = np.maximum(each * p * (1 - p), 1e-9)
        g = np.array([(each * (p - t) * m).sum() + 1e-3 * a, (each * (p - t)).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class ToxicityModel:
    """The first landmarks (telling) are those of toxic text; all, if not given."""

    def __init__(self, landmarks: list[str], telling: int | None = None):
        self.kernel, self.telling = Kernel(landmarks), telling
        own = np.zeros((len(landmarks), len(landmarks)))
        at, values = self.kernel.near(landmarks)
        if len(at):
            own[at] = values
        own = (own + own.T) / 2
        e, v = np.linalg.eigh(own + 1e-3 * np.eye(len(landmarks)))
        self.root = v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-3))) @ v.T
        self.w, self.a, self.b = np.zeros(len(landmarks) + 1), 0.0, -40.0

    def fit(self, owner: np.ndarray, k: np.ndarray, y: np.ndarray, c: float = 1.0) -> None:
        """y: 1 toxic, 0 clean, of documents; owner, k: their sentences' kernel values. Classes weigh alike."""
        y = np.asarray(y)
        if len(set(y.tolist())) < 2:
            self.b = 40.0 if len(y) and y[0] > 0 else -40.0
            return
        # every document also has a sentence without any value
        owner, k = np.concatenate([owner, np.arange(len(y))]), np.concatenate([k, np.zeros((len(y), k.shape[1]), np.float32)])
        x = np.c_[k @ self.root, np.ones(len(k))].astype(np.float32)
        margin = k[:, : self.telling].sum(axis=1)
        for _ in range(TURNS):
            best = _best(owner, margin, len(y))
            rows = np.concatenate([best[y > 0], np.flatnonzero(y[owner] == 0)])
            # a clean document's sentences weigh as one
            share = 1 / np.bincount(owner, minlength=len(y))[owner[rows]]
            share[y[owner[rows]] > 0] = 1.0
            self.w = _machine(x[rows], np.where(y[owner[rows]] > 0, 1.0, -1.0), share, c)
            margin = x @ self.w
        self.a, self.b = _logistic(margin[_best(owner, margin, len(y))], y)

    def score(self, owner: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from their sentences' kernel values."""
        m = np.full(n, self.w[-1])
        if len(owner):
            np.maximum.at(m, owner, np.c_[k @ self.root, np.ones(len(k))] @ self.w)
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -40, 40)))


def _best(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of each document (all have a sentence) its sentence of the largest value, the first on ties."""
    order = np.lexsort((np.arange(len(owner)), -value, owner))
    return order[np.searchsorted(owner[order], np.arange(n))]


def _machine(x: np.ndarray, s: np.ndarray, share: np.ndarray, c: float) -> np.ndarray:
    """Weights of a linear machine of squared hinge, by Newton steps; s: 1 or -1; share: weights within a class."""
    weight = c * share * np.where(s > 0, share.sum() / (2 * share[s > 0].sum()), share.sum() / (2 * share[s < 0].sum()))
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = s * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(reg + (xa * wa[:, None]).T @ xa, (xa * (wa * s[active])[:, None]).sum(axis=0))
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _apart(words: list[str], most: int) -> list[str]:
    """The first words of a ranking that are not nearly the same as an earlier one."""
    if not words:
        return []
    at, values = Kernel(words).near(words)
    own = np.zeros((len(words), len(words)))
    own[at] = values
    out: list[int] = []
    for i in range(len(words)):
        if len(out) < most and not any(own[i, j] > 0.85 for j in out):
            out.append(i)
    return [words[i] for i in out]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn from labelled rows. Labels are drawn by hash first, so that the documents, which are large,
    meet a side of bounded size and are not shuffled."""
    tuned(docs.sparkSession)
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & F.col("_key").isNotNull()).groupBy("_key").agg(F.max("_y").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in rows.groupBy((F.col("_y") > 0).cast("int").alias("_y")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ToxicityModel([])
    whole = 1 << 30
    share = F.when(F.col("_y") > 0, F.lit(min(whole, whole * per_class // sizes.get(1, 1)))).otherwise(F.lit(min(whole, whole * per_class // sizes.get(0, 1))))
    sample = rows.where(F.pmod(F.xxhash64("_key"), F.lit(whole)) < share)
    drawn = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key").select("_text", "_y")

    def frequencies(batches):
        n: dict[str, list[int]] = {}
        docs_seen = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs_seen[y > 0] += 1
                words = words_of(t)
                for w in words | {w[: p + 1] for w in words for p in PREFIX if len(w) > p + 2}:
                    n.setdefault(w, [0, 0])[y > 0] += 1
        n[""] = docs_seen
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["word", "clean", "toxic"])

    counts = drawn.mapInArrow(lean(frequencies), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = {r["word"]: r for r in counts.where("word = ''").collect()}.get("")
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    a, b = F.col("toxic"), F.col("clean")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    cross = (a * d - b * c).cast("double")
    chi = cross * cross * (n0 + n1) / ((a + b) * (c + d + 1e-9) * F.lit(max(n1, 1)) * F.lit(max(n0, 1)))
    words = counts.where("word <> ''")
    telling = _apart([r["word"] for r in words.where((a >= 3) & (cross > 0)).orderBy(chi.desc(), "word").limit(LANDMARKS * 6).collect()], LANDMARKS)
    frequent = [r["word"] for r in words.where((cross <= 0) & F.col("word").endswith(">")).orderBy(b.desc(), "word").limit(FREQUENT).collect()]
    at, values = Kernel(telling).near(frequent) if telling else (np.array([], np.int64), np.zeros((0, 0)))
    alike = [frequent[at[i]] for i in np.argsort(-values.sum(axis=1), kind="stable")[:COMMON]]
    model = ToxicityModel(telling + alike, len(telling))
    held = docs.sparkSession.sparkContext.broadcast(model.kernel.landmarks)

    first = len(telling)

    def features(batches):
        f = Features(Kernel(held.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                owner, k = f.batch(part.column(0).to_pylist())
                keep = [[] for _ in range(part.num_rows)]
                for j in np.argsort(-k[:, :first].sum(axis=1), kind="stable"):
                    if len(keep[owner[j]]) < SENTENCES:
                        keep[owner[j]].append(k[j].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(x) for x in keep], pa.binary()), part.column(1)], names=["k", "y"])

    # at most two times PER_CLASS rows, a few KB each; in an order of their own, as sums depend on it
    got = sorted((bytes(r["k"]), int(r["y"] > 0)) for r in drawn.mapInArrow(lean(features), "k binary, y int").collect())
    k = np.frombuffer(b"".join(x for x, _ in got), "<f4").reshape(-1, max(1, len(model.kernel.landmarks)))
    owner = np.repeat(np.arange(len(got)), [len(x) // (4 * k.shape[1]) for x, _ in got])
    model.fit(owner, k[:, : len(model.kernel.landmarks)], np.array([y for _, y in got]))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score, and nearest array<string>: landmarks that some word is near."""
    tuned(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = plus(rows.drop("_text").schema, "score double, nearest array<string>")

    def run(batches):
        m = held.value
        f = Features(m.kernel)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                owner, k = f.batch(some.column(0).to_pylist())
                near: list[set[int]] = [set() for _ in range(some.num_rows)]
                for o, r in zip(owner, k, strict=True):
                    near[o].update(np.flatnonzero(r).tolist())
                names = [[m.kernel.landmarks[j] for j in sorted(x)] for x in near]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(m.score(owner, k, some.num_rows), pa.float64()), pa.array(names, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    found = score(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
