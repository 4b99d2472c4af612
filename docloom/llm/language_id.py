"""Language identification by mixture inference.

Each text is a bag of character trigrams drawn from a mixture of languages and a uniform background.
Expectation-maximisation estimates the proportions from the trigram likelihoods; the language set is
grown in the order of the full mixture's proportions and chosen by penalised likelihood (half of
``PENALTY`` times log n for each language). The prediction is the set's largest language, the score
its proportion, background included.

Likelihoods are learned from a hash sample of at most about ``PER_LANGUAGE`` labelled texts a language
(a documented bound for fitting; larger samples move no held-out figure). They are
trigram counts in 2^16 hashed cells, summed in Spark; the broadcast model has 2^16 floats a language.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where
nothing was learned. Rows with a null language, or an empty one, teach nothing. Ties go to the first language
in sorted order. Repeated rows and null ids are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, plus, table, tuned

CELLS = 1 << 16
PER_LANGUAGE = 2_000
ROUNDS = 12
PENALTY = 6.0
UND = "und"

_letters = None


def _table() -> np.ndarray:
    """Code point to itself, or to a space where it is no letter (first plane)."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)
    return _letters


def cells(text: str | None) -> np.ndarray:
    """Hashed trigrams of the letters, lower-cased; other characters are one blank. Empty without a letter."""
    if not text:
        return np.empty(0, np.uint16)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    high = c > 0xFFFF
    if high.any():
        c = np.where(high & np.array([chr(x).isalpha() if x > 0xFFFF else False for x in c.tolist()]), c, np.where(high, 32, _table()[np.minimum(c, 0xFFFF)]))
    else:
        c = _table()[c]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.uint16)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)


class Mixture:
    """Likelihoods of the learned languages, the last column being the background."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        smooth = 0.05
        p = (counts + smooth) / (counts.sum(axis=0, keepdims=True) + smooth * CELLS)
        self.languages = languages
        self.p = np.concatenate([p, np.full((CELLS, 1), 0.2 / CELLS)], axis=1)

    @staticmethod
    def em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood; p: likelihoods of each distinct cell, n: its count."""
        k = p.shape[1]
        pi = np.full(k, 1.0 / k)
        total = n.sum()
        for _ in range(rounds):
            r = p * pi
            s = r.sum(axis=1)
            pi = (n / s) @ r / total
        return pi, float(n @ np.log(p @ pi))

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The language, its proportion, and the chosen set with proportions."""
        h = cells(text)
        if not len(h) or not self.languages:
            return UND, 0.0, []
        cell, n = np.unique(h, return_counts=True)
        p, n = self.p[cell], n.astype(float)
        pi, _ = self.em(p, n)
        order = np.argsort(-pi[:-1], kind="stable")
        best = None
        for k in range(1, len(order) + 1):
            if k > 1 and pi[order[k - 1]] < 0.01:
                break
            chosen = [*order[:k].tolist(), len(self.languages)]
            part, ll = self.em(p[:, chosen], n)
            value = ll - 0.5 * PENALTY * k * np.log(n.sum() + 1)
            if best is None or value > best[0]:
                best = (value, chosen[:-1], part)
        _, chosen, part = best
        found = sorted(((self.languages[c], float(x)) for c, x in zip(chosen, part, strict=False)), key=lambda x: (-x[1], x[0]))
        return found[0][0], min(1.0, max(0.0, found[0][1])), found


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Mixture:
    tuned(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(language).alias("lang"), F.col(key).alias("key")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Mixture([], np.zeros((CELLS, 0)))
    whole = 1 << 30
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(whole, whole * per_language // n)))])
    sample = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(whole)) < F.element_at(share, F.col("lang"))).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang] += np.bincount(cells(t), minlength=CELLS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    languages = sorted(sizes)
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((CELLS, len(languages)))
    got = sample.mapInArrow(lean(count), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    for r in got.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("x")).toLocalIterator():  # at most CELLS cells a language
        cell, n = zip(*r["x"], strict=True)
        counts[list(cell), at[r["lang"]]] = n
    return Mixture(languages, counts)


def identify(docs: DataFrame, model: Mixture, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score and languages array<struct<lang, share>> (the chosen set)."""
    tuned(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = plus(rows.drop("_text").schema, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m = held.value
        for b in batches:
            found = [m.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"lang": a, "share": s} for a, s in x[2]] for x in found], kind)], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
