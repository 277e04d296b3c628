"""Hierarchical language ID: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import in_workers, lean, sample_rows

#: Language -> family; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sr": "slavic",
}
UNKNOWN = "und"
SYMBOLS = 64
SIZE = SYMBOLS**3
PIECE = 1 << 20  # bytes of a text that are counted at once


def _alphabet() -> np.ndarray:
    """Byte -> one of 64 symbols: 0 for what is no letter, 1 to 26 for a to z in either case, the rest for other bytes."""
    to = np.zeros(256, np.int32)
    for k in range(26):
        to[ord("a") + k] = to[ord("A") + k] = k + 1
    to[128:] = 27 + np.arange(128) % 37
    return to


ALPHABET = _alphabet()


def trigrams(text: bytes) -> np.ndarray:
    """Codes of the trigrams of symbols, one for each byte that starts or ends at a letter; runs of no letter are one."""
    b = np.frombuffer(b" " + text + b" ", np.uint8)
    if len(text) and b.max() >= 0xC3:  # the two-byte capitals of Latin-1 count as small letters
        capital = np.zeros(len(b), bool)
        capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        if capital.any():
            b = b + np.where(capital, np.uint8(0x20), np.uint8(0))
    s = ALPHABET[b]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    if len(s) < 3:
        return np.zeros(0, np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, shares of the text); a text longer than a piece is counted piece by piece."""
    total = np.zeros(SIZE) if len(text) > PIECE else None
    if total is None:
        codes, n = np.unique(trigrams(text), return_counts=True)
    else:
        for k in range(0, len(text), PIECE):
            total += np.bincount(trigrams(text[max(0, k - 2):k + PIECE]), minlength=SIZE)
        codes = np.flatnonzero(total)
        n = total[codes]
    return codes, n / max(1, n.sum())


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of a linear SVM (squared hinge loss) by dual coordinate descent; the last weight is the bias."""
    w, alpha = np.zeros(SIZE + 1), np.zeros(len(rows))
    rng, scaled = np.random.default_rng(seed), []
    for codes, share in rows:
        x = np.append(share * SCALE, 1.0)
        scaled.append((np.append(codes, SIZE), x, float(x @ x) + 0.5 / cost))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, q = scaled[i]
            grad = side[i] * float(w[at] @ x) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - grad / q)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * side[i] * x
                alpha[i] = new
    return w


SCALE = 40.0


class Discriminator:
    """Pairwise SVMs among names; the winner has most votes, ties go to the larger sum of margins."""

    def __init__(self, names: list[str], rows: list, labels: list[str], cost: float):
        self.names, self.pairs = sorted(names), []
        for a, b in combinations(self.names, 2):
            at = [i for i, x in enumerate(labels) if x in (a, b)]
            side = np.array([1.0 if labels[i] == a else -1.0 for i in at])
            w = train_svm([rows[i] for i in at], side, cost)
            self.pairs.append((a, b, (w[:SIZE] * SCALE).astype(np.float32), float(w[SIZE])))

    def decide(self, margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """(name, confidence 0 to 1): the least confident of the winner's duels counts."""
        votes, sums, least = defaultdict(int), defaultdict(float), defaultdict(lambda: np.inf)
        for (a, b), m in margins.items():
            votes[a if m >= 0 else b] += 1
            for x, v in ((a, m), (b, -m)):
                sums[x] += v
                least[x] = min(least[x], v)
        best = max(self.names, key=lambda x: (votes[x], sums[x], x))
        return best, 1.0 if len(self.names) == 1 else float(1 / (1 + np.exp(-4 * least[best])))


class LanguageModel:
    """``samples``: ((codes, shares) of a text's trigrams, language)."""

    def __init__(self, samples: list[tuple[tuple[np.ndarray, np.ndarray], str]], families: dict[str, str] = FAMILIES, cost: float = 1.0):
        rows, langs = [x for x, _ in samples], [x for _, x in samples]
        kin = [families.get(x, x) for x in langs]
        self.family = Discriminator(sorted(set(kin)), rows, kin, cost) if samples else None
        self.inside = {f: Discriminator(sorted({x for x, g in zip(langs, kin, strict=True) if g == f}), rows, langs, cost) for f in sorted(set(kin))}

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and score of a text with a letter; all its trigrams count. No training rows: unknown."""
        if self.family is None:
            return UNKNOWN, 0.0
        every = [self.family, *self.inside.values()]
        sums, n = [np.zeros(len(d.pairs)) for d in every], 0
        for k in range(0, len(text), PIECE):
            codes = trigrams(text[max(0, k - 2):k + PIECE])
            n += len(codes)
            for total, d in zip(sums, every, strict=True):
                for p, pair in enumerate(d.pairs):
                    total[p] += float(pair[2][codes].sum(dtype=np.float64))
        margins = [{(a, b): s / max(1, n) + bias for (a, b, _, bias), s in zip(d.pairs, total, strict=True)} for d, total in zip(every, sums, strict=True)]
        family, sure = self.family.decide(margins[0])
        at = list(self.inside).index(family)
        lang, surer = self.inside[family].decide(margins[1 + at])
        return lang, sure * surer


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, held_out: int | None = 2, most: int = 2400) -> LanguageModel:
    """Fit on at most ``most`` documents with a text and a language, outside the fold ``held_out``.

    Trigrams of the whole texts are counted by the executors; the driver gets a number for each distinct trigram.
    Of rows that share a doc_id one is used (see ``sample_rows``). No usable row gives a model that knows nothing.
    """
    usable = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    if held_out is not None:
        usable = usable.where(fold(F.col("doc_id")) != held_out)

    def features(_, text, lang):
        codes, share = counted(text)
        if len(codes):
            yield codes.astype("<i4").tobytes(), share.astype("<f4").tobytes(), lang

    rows = in_workers(sample_rows(usable, "doc_id", ["text", "lang"], most), features, "codes binary, share binary, lang string").collect()
    rows = sorted((bytes(r["codes"]), bytes(r["share"]), r["lang"]) for r in rows)
    return LanguageModel([((np.frombuffer(c, "<i4"), np.frombuffer(x, "<f4").astype(float)), lang) for c, x, lang in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; nothing but the text is used.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows are repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: a weight for each trigram and pair of languages
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(letter, F.col("text").cast("binary")).alias("text"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.predict(x.as_py()) if x.is_valid else (UNKNOWN, 0.0) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose language is found with ``least_score``; ``und`` texts go. All columns stay.

    A winner of one duel scores 0.5 or more, so with at most two names at each level every score is 0.25 or more:
    the default then rejects ``und`` only, and letter junk or a language that was not learned stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([sent.value.predict(bytes(x))[1] if x is not None else 0.0 for x in texts], dtype=float)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    judged = lean(docs).withColumn("__score", score(F.when(letter, F.col("text").cast("binary"))))
    return judged.where(F.col("__score") >= least_score).select(*docs.columns)
