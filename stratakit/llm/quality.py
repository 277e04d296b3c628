"""Quality rules: base statistics of a text, and a linear-chain CRF that marks lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import in_workers, lean, rows_of_keys
from stratakit.llm.substrings import MIX, rolled

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
DIGITS = b"0123456789"
FEATURES = ("any", "no word", "1-2 words", "3-7 words", "8-20 words", "over 20 words", "some symbols", "many symbols", "capitals", "repeats a line", "bars", "ends a sentence", "few distinct words", "half distinct words", "exclaims", "digits", "first", "last")
NO_WORD = 1
SEGMENT = 64  # lines of a training sequence


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by windows of ``window`` words that are found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    code = np.fromiter((number(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    h = rolled((code.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[2]), window)
    order = np.argsort(h, kind="stable")
    alike = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(alike):
        return 0
    a, b = order[alike], order[alike + 1]
    if all((code[a + k] == code[b + k]).all() for k in range(window)):
        at = np.concatenate((a, b))
    else:  # two windows share a hash: compare the windows themselves
        seen: dict[bytes, int] = {}
        hits: set[int] = set()
        for i in range(n):
            first = seen.setdefault(code[i:i + window].tobytes(), i)
            if first != i:
                hits |= {first, i}
        at = np.array(sorted(hits), np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.unique(at), 1)
    np.add.at(change, np.unique(at) + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def without(text: bytes, which: bytes) -> int:
    """How many bytes of ``text`` are in ``which``."""
    return len(text) - len(text.translate(None, which))


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(features by line, words by line, lines that have a word and equal an earlier one)"""
    x = np.zeros((len(lines), len(FEATURES)))
    n_words = np.zeros(len(lines), np.int64)
    seen: set[bytes] = set()
    twice = 0
    for k, line in enumerate(lines):
        words = line.split()
        n = n_words[k] = len(words)
        f = [0, 1 if n == 0 else 2 if n < 3 else 3 if n < 8 else 4 if n <= 20 else 5]
        if n:
            if line in seen:
                twice += 1
                f.append(9)
            seen.add(line)
            symbols = without(line, SYMBOLS)
            if symbols:
                f.append(7 if symbols > 0.3 * n else 6)
                if line.count(b"|") > 0.2 * n:
                    f.append(10)
            capitals = without(line, CAPITALS)
            if capitals > without(line, SMALL):
                f.append(8)
            if line.rstrip(SPACE)[-1:] in (b".", b"!", b"?"):
                f.append(11)
            if n >= 8:
                distinct = len(set(words))
                if distinct < 0.7 * n:
                    f.append(12 if distinct < 0.35 * n else 13)
            if line.count(b"!") > 0.3 * n:
                f.append(14)
            if without(line, DIGITS) > 0.3 * len(line):
                f.append(15)
        x[k, f] = 1
    x[0, 16] = x[-1, 17] = 1
    return x, n_words, twice


class LineCRF:
    """Two states, 0 boilerplate and 1 content; weights for features, transitions and the start.

    ``least_share``: a text whose content lines hold a smaller share of its words is not kept.
    """

    def __init__(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray, least_share: float = 0.5):
        self.emit, self.step, self.start, self.least_share = emit, step, start, least_share

    @classmethod
    def train(cls, sequences: list[tuple[np.ndarray, np.ndarray]], weights: list[float] | None = None, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
        """Maximum likelihood by Adam over (features, states) sequences; no sequence gives a model that keeps all."""
        nf = len(FEATURES)
        theta = np.zeros(2 * nf + 6)
        if not sequences:
            return cls(np.zeros((nf, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))
        weight = np.array(weights if weights is not None else [1.0] * len(sequences), float)
        weight /= weight.sum()
        by_length = sorted(range(len(sequences)), key=lambda k: -len(sequences[k][1]))
        sequences, weight = [sequences[k] for k in by_length], weight[by_length]
        lengths = np.array([len(y) for _, y in sequences])
        longest = int(lengths[0])
        going = [int((lengths > t).sum()) for t in range(longest + 1)]  # the first so many sequences have a line t
        on = np.arange(longest) < lengths[:, None]
        y = np.zeros(on.shape, np.int64)
        y[on] = np.concatenate([b for _, b in sequences])
        x = np.concatenate([a for a, _ in sequences])  # rows of features in the order of ``on``
        by_line = np.repeat(weight, lengths)[:, None]
        pairs = np.bincount((2 * y[:, :-1] + y[:, 1:])[on[:, 1:]], np.repeat(weight, lengths - 1), 4)
        goal = np.concatenate(((x.T @ (np.eye(2)[y[on]] * by_line)).ravel(), pairs, np.bincount(y[:, 0], weight, 2)))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, rounds + 1):
            emit, step, start = theta[:2 * nf].reshape(nf, 2), theta[2 * nf:-2].reshape(2, 2), theta[-2:]
            e = np.zeros((*on.shape, 2))
            e[on] = x @ emit
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                n = going[t]
                ahead[:n, t] = np.logaddexp(ahead[:n, t - 1, :1] + step[0], ahead[:n, t - 1, 1:] + step[1]) + e[:n, t]
            for t in range(longest - 2, -1, -1):
                n = going[t + 1]
                then = e[:n, t + 1] + back[:n, t + 1]
                back[:n, t] = np.logaddexp(then[:, :1] + step[:, 0], then[:, 1:] + step[:, 1])
            total = np.logaddexp(ahead[:, 0, 0] + back[:, 0, 0], ahead[:, 0, 1] + back[:, 0, 1])
            p = np.exp((ahead + back)[on] - np.repeat(total, lengths)[:, None]) * by_line
            both, place = on[:, 1:], np.repeat(total, lengths - 1)
            moves = [float((np.exp(ahead[:, :-1, i][both] + step[i, j] + (e + back)[:, 1:, j][both] - place) * np.repeat(weight, lengths - 1)).sum()) for i in (0, 1) for j in (0, 1)]
            first = np.exp(ahead[:, 0] + back[:, 0] - total[:, None]) * weight[:, None]
            g = np.concatenate(((x.T @ p).ravel(), moves, first.sum(axis=0))) - goal + ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        return cls(theta[:2 * nf].reshape(nf, 2), theta[2 * nf:-2].reshape(2, 2), theta[-2:])

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best state of each line, by Viterbi; a tie goes to content."""
        e = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            f0, f1 = one + s10 >= zero + s00, one + s11 >= zero + s01
            back.append((f0, f1))
            zero, one = (one + s10 if f0 else zero + s00) + e0, (one + s11 if f1 else zero + s01) + e1
        state = int(one >= zero)
        out = [state]
        for f in reversed(back):
            state = int(f[state])
            out.append(state)
        return np.array(out[::-1])


def judge(text: bytes, crf: LineCRF) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content share, base_failed, kept, marks)"""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - without(text, SPACE)
    x, by_line, twice = line_features(text.split(b"\n"))
    repeats = repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    states = crf.decode(x)
    share = float((by_line * states).sum()) / n if n else 0.0
    return n, chars, without(text, SYMBOLS), twice, repeats, share, failed, bool(not failed and share >= crf.least_share), (states + ord("0")).astype(np.uint8).tobytes().decode()


def segments(lines: int, most: int) -> list[tuple[int, int]]:
    """Segments of the lines 0 to ``lines``: all of them, or ``most`` at even distances over the whole text."""
    starts = list(range(0, lines, SEGMENT))
    if len(starts) > most:
        starts = [starts[k * len(starts) // most] for k in range(most)]
    return [(k, min(k + SEGMENT, lines)) for k in starts]


def packed(x: np.ndarray) -> np.ndarray:
    """One number a line, a bit a feature."""
    return (x.astype(np.int64) << np.arange(len(FEATURES))).sum(axis=1).astype("<i4")


def unpacked(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)


def line_states(good: list[np.ndarray], bad: list[np.ndarray], rounds: int = 3) -> list[np.ndarray]:
    """States of the lines of bad documents, from evidence on each line: the log odds of its features.

    Lines of good documents are content. At first all lines of bad ones count as boilerplate; then those whose
    features are likelier among content become content, and the odds are taken anew. The likeliest line of a bad
    document is boilerplate in any case. A line without a word has the state of the line before it.
    """
    worded = lambda x: x[:, NO_WORD] == 0
    states = [np.zeros(len(x), np.int64) for x in bad]
    for _ in range(rounds):
        rates = []
        for wanted in (0, 1):
            rows = [x[worded(x) & (y == wanted)] for x, y in zip(bad, states, strict=True)] + ([x[worded(x)] for x in good] if wanted else [])
            n = sum(map(len, rows))
            rates.append((sum((x.sum(axis=0) for x in rows), np.zeros(len(FEATURES))) + 0.5) / (n + 1.0))
        odds = np.log(rates[0]) - np.log(rates[1])
        odds[[0, NO_WORD, 16, 17]] = 0.0  # neither the constant nor a line's place is evidence
        states = []
        for x in bad:
            value, has = x @ odds, worded(x)
            y = np.where(value > 0, 0, 1)
            if has.any():
                y[np.flatnonzero(has)[value[has].argmax()]] = 0
            at = np.maximum.accumulate(np.where(has, np.arange(len(x)), -1))
            states.append(np.where(at >= 0, y[np.maximum(at, 0)], 0))
    return states


def spliced(good: list[np.ndarray], bad: list[np.ndarray], states: list[np.ndarray], n: int, seed: int = 21) -> list[tuple[np.ndarray, np.ndarray]]:
    """``n`` seeded sequences in which runs of lines of good documents and of boilerplate lines follow each other."""
    junk = [x[y == 0] for x, y in zip(bad, states, strict=True) if (y == 0).any()]
    if not good or not junk:
        return []
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        parts, marks = [], []
        for k in range(int(rng.integers(2, 5))):
            state = (k + len(out)) % 2
            lines = (good if state else junk)[int(rng.integers(len(good if state else junk)))]
            a = int(rng.integers(len(lines)))
            parts.append(lines[a:a + int(rng.integers(1, 9))].copy())
            marks.append(np.full(len(parts[-1]), state))
        x = np.concatenate(parts)
        x[:, 16:18] = 0
        x[0, 16] = x[-1, 17] = 1
        out.append((x, np.concatenate(marks)))
    return out


def best_cut(shares: np.ndarray, good: np.ndarray) -> float:
    """The share below which documents go: most good ones kept and bad ones dropped, both counted as rates; of equal
    cuts the one in the widest gap. One kind alone gives a half."""
    if good.all() or not good.any():
        return 0.5
    at = np.unique(np.concatenate((shares, [0.0, 1.0])))
    cuts, gaps = (at[1:] + at[:-1]) / 2, np.diff(at)
    value = [(shares[good] >= c).mean() + (shares[~good] < c).mean() for c in cuts]
    return float(max(zip(np.round(value, 9), gaps, cuts, strict=True))[2])


def fit(docs: DataFrame, labels: DataFrame, most: int = 1600, most_segments: int = 16) -> LineCRF:
    """Fit on at most ``most`` labelled documents, half of either quality; reruns agree.

    Of a longer text ``most_segments`` segments of 64 lines are used, spread evenly over all of it. Executors turn
    lines into features; no text reaches the driver. States of lines come from ``line_states``, and ``spliced``
    sequences join the documents', so that training sequences change state. The least share of content is set on the
    same documents, those that the base rules drop aside. Documents with contrary labels, or none, are left out; of
    rows that share a doc_id one is used. Nothing to learn from gives a model that keeps all lines.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__k")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("__hi")).where("quality = __hi and quality in (0, 1)").select("__k", "quality")
    ids = docs.select(F.col("doc_id").cast("long").alias("__k"))
    usable = marks.join(ids, "__k", "left_semi")
    picked = [tuple(r) for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("__k"), "__k").limit(most // 2).collect()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    keys = docs.sparkSession.createDataFrame(picked, "__k long, quality int")
    untrained = LineCRF.train([])

    def features(doc_id, text, quality):
        x, by_line, _ = line_features(text.split(b"\n"))
        failed = judge(text, untrained)[6]
        for a, b in segments(len(x), most_segments):
            yield doc_id, a, quality, failed, packed(x[a:b]).tobytes(), by_line[a:b].astype("<i8").tobytes()

    found = in_workers(rows_of_keys(texts, "doc_id", ["text"], keys), features, "doc_id long, at long, quality int, failed boolean, codes binary, words binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["at"]))
    x = [unpacked(np.frombuffer(r["codes"], "<i4")) for r in rows]
    good, bad = ([f for f, r in zip(x, rows, strict=True) if r["quality"] == q] for q in (1, 0))
    states = line_states(good, bad)
    kinds = ([(f, np.ones(len(f), np.int64)) for f in good], list(zip(bad, states, strict=True)), spliced(good, bad, states, max(len(good), len(bad))))
    crf = LineCRF.train([s for kind in kinds for s in kind], [1 / len(kind) for kind in kinds for _ in kind])  # each kind weighs the same
    shares: dict[int, list] = {}
    for f, r in zip(x, rows, strict=True):
        if not r["failed"]:
            words = np.frombuffer(r["words"], "<i8")
            held = shares.setdefault(r["doc_id"], [0, 0, r["quality"]])
            held[0] += int((words * crf.decode(f)).sum())
            held[1] += int(words.sum())
    judged = [(a / n, q) for a, n, q in shares.values() if n]
    crf.least_share = best_cut(np.array([a for a, _ in judged]), np.array([q == 1 for _, q in judged], bool)) if judged else 0.5
    return crf


def quality_rules(docs: DataFrame, crf: LineCRF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept, marks)
    for each row of ``docs``; kept if the base rules pass and lines marked as content hold the model's least share of
    the words. ``marks`` has a character for each line: 1 content, 0 boilerplate.

    Null text counts as empty: no words, so base_failed, and one line. Texts are judged whole; repeated rows are
    repeated; a tie of two line labellings goes to content. Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # a weight for each feature
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept", "marks"]
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_(), pa.string()]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(judge(x.as_py() or b"", sent.value) for x in batch.column(1)), strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], ["doc_id", *names])

    return rows.mapInArrow(judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean, marks string")

