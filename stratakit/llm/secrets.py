"""Secret scans: fixed patterns, and tokens that a character Markov model finds random rather than spelled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import checkpointed, in_workers, lean, sample_rows

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: What a match of ASSIGN must contain, in small letters: the scan with ASSIGN starts only where one is found.
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
JOINTS = TOKEN_BYTES[62:]
ACCESS_LEAST, HEX_LEAST, ASSIGN_LEAST, TOKEN_LEAST = 16, 32, 8, 20
REDACTED = "[REDACTED]"
PLAIN = (b"identifier", b"configuration", b"document", b"directory")

IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[list(TOKEN_BYTES)] = True
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(TOKEN_BYTES)] = np.arange(len(TOKEN_BYTES))
N = len(TOKEN_BYTES)


def token_runs(text: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of token bytes, ``least`` or longer, as byte spans."""
    if len(text) < least:
        return []
    outside = np.flatnonzero(~IN_TOKEN[np.frombuffer(text, np.uint8)])
    edges = np.concatenate(([-1], outside, [len(text)]))
    long = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, of the fixed patterns; leftmost and without overlap for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        # Latin-1 makes each byte a character, so that spans are in bytes; (?a) keeps letters to ASCII
        for m in ASSIGN.finditer(text.decode("latin-1")):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end()))
    for a, b in token_runs(text, ACCESS_LEAST):
        part = text[a:b]
        found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part)]
        found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part)]
    return sorted(found)


class Markov:
    """A chain of second order over token bytes, smoothed by the first order."""

    def __init__(self, samples: list[bytes]):
        one, two = np.ones((N, N)), np.zeros((N * N, N))
        for x in samples:
            s = SYMBOL[np.frombuffer(x, np.uint8)]
            np.add.at(one, (s[:-1], s[1:]), 1)
            np.add.at(two, (s[:-2] * N + s[1:-1], s[2:]), 1)
        one /= one.sum(axis=1, keepdims=True)
        back = np.tile(one, (N, 1)) * 8.0
        self.first = np.log(one).astype(np.float32)
        self.second = np.log((two + back) / (two + back).sum(axis=1, keepdims=True)).astype(np.float32)

    def score(self, s: np.ndarray) -> float:
        return float(self.first[s[0], s[1]] + self.second[s[:-2] * N + s[1:-1], s[2:]].sum(dtype=np.float64))


class SecretModel:
    """Log-likelihood ratio, in nats a character, of the random chain against the chain of ordinary words."""

    def __init__(self, random: list[bytes], ordinary: list[bytes], threshold: float = 0.7):
        self.random, self.ordinary, self.threshold = Markov(random), Markov(ordinary), threshold

    def ratio(self, token: bytes) -> float:
        s = SYMBOL[np.frombuffer(token, np.uint8)]
        return (self.random.score(s) - self.ordinary.score(s)) / len(s)

    def is_secret(self, token: bytes) -> bool:
        """Longer than the least length, letters and digits mixed, more than a few distinct bytes, and random by the ratio."""
        kinds = sum(1 for k in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") if len(token.translate(None, k)) < len(token))
        return kinds >= 2 and len(set(token)) >= 8 and self.ratio(token) > self.threshold


def uncovered(runs: list[tuple[int, int]], base: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """What sorted ``base`` spans leave of each run: the pieces of ``least`` bytes or more."""
    out, k = [], 0
    for a, b in runs:
        while k < len(base) and base[k][2] <= a:
            k += 1
        at = k
        while at < len(base) and base[at][0] < b:
            if base[at][0] - a >= least:
                out.append((a, base[at][0]))
            a, at = max(a, base[at][2]), at + 1
        if b - a >= least:
            out.append((a, b))
    return out


def spans(text: bytes, model: SecretModel | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) in bytes. A Markov span is a whole token, or a whole rest of one that base spans leave."""
    base = base_spans(text)
    if model is None:
        return base, base
    runs, more = token_runs(text, TOKEN_LEAST), []
    whole = set(runs)
    for a, b in uncovered(runs, base, TOKEN_LEAST):
        # what joins a rest to a base span is no part of the secret
        bare = text[a:b] if (a, b) in whole else text[a:b].strip(JOINTS)
        if model.is_secret(text[a:b]) or (TOKEN_LEAST <= len(bare) < b - a and model.is_secret(bare)):
            more.append((a, 3, b))
    return base, sorted(base + more)


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found:
        return found
    if len(text) == len(text.decode("utf-8", "replace")):
        return found
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda k: int(starts[k - 1]) if k else 0
    return [(at(a), kind, at(b)) for a, kind, b in found]


def seeded_secrets(n: int = 3000, seed: int = 11) -> list[bytes]:
    """Labelled random strings: base64, hex, letters with digits, capitals with digits."""
    rng = np.random.default_rng(seed)
    sets = (TOKEN_BYTES[:64], b"0123456789abcdef", TOKEN_BYTES[:62], TOKEN_BYTES[:26] + TOKEN_BYTES[52:62])
    return [rng.choice(list(sets[k % 4]), int(rng.integers(20, 64))).astype(np.uint8).tobytes() for k in range(n)]


def ordinary_names(words: list[bytes], n: int = 6000, seed: int = 12) -> list[bytes]:
    """Labelled identifiers: words of the sample, alone and joined in the ways of code, with and without a number."""
    rng, out = np.random.default_rng(seed), list(words)
    for k in range(n if words else 0):
        parts = [words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 5)))]
        number = str(int(rng.integers(0, 3000))).encode() if k % 3 == 0 else b""
        form = k % 5
        out.append((b"_".join(parts), b"-".join(parts), parts[0].lower() + b"".join(x.title() for x in parts[1:]), b"/".join(parts), b"_".join(parts).upper())[form] + number)
    return out


def labelled(text: bytes) -> list[tuple[bytes, bool]]:
    """(token, random?) of a text: values that the fixed patterns find are random, words that they leave are ordinary."""
    found, cut = base_spans(text), text
    out = {(x, True) for a, kind, b in found if kind for x in re.findall(rb"[A-Za-z0-9+/_=-]{16,}", text[a:b])}
    for a, _, b in reversed(found):
        cut = cut[:a] + b" " + cut[b:]
    out |= {(x, False) for x in re.findall(rb"[A-Za-z0-9+/_=-]{3,}", cut) if len(x) < 40 and not re.search(rb"[0-9]", x)}
    return sorted(out)


def fit(docs: DataFrame, most: int = 600, most_words: int = 60_000, threshold: float = 0.7) -> SecretModel:
    """Fit on labelled tokens of at most ``most`` documents (see ``labelled``), at most ``most_words`` distinct ones of
    each label, those with the smallest hash. Seeded strings of both kinds join them, so an empty sample still gives a
    model. Texts stay with the executors; only tokens reach the driver. Repeated doc_ids: see ``sample_rows``."""
    rows = sample_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null"), "doc_id", ["text"], most)
    tokens = checkpointed(in_workers(rows, lambda _, text: labelled(text), "token binary, random boolean").distinct())
    random, ordinary = ([bytes(r[0]) for r in tokens.where(F.col("random") == kind).orderBy(F.xxhash64("token"), "token").limit(most_words).select("token").collect()] for kind in (True, False))
    return SecretModel(seeded_secrets() + random, ordinary_names(sorted({*ordinary, *PLAIN})), threshold)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def scan(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for each row of ``docs``: ``base`` and ``spans`` list
    kind:start:end by start, then kind; code points, end exclusive.

    Null text counts as empty. Repeated rows are repeated. Texts are scanned whole; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py() or b""
                base, every = spans(text, sent.value)
                kinds = [kind for _, kind, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), listed(in_code_points(text, base)), listed(in_code_points(text, every))))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return rows.mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(text: bytes, model: SecretModel | None) -> bytes:
    out, at = [], 0
    for a, _, b in spans(text, model)[1]:
        if a >= at:
            out += [text[at:a], REDACTED.encode()]
        at = max(at, b)
    return b"".join((*out, text[at:]))


def redact(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mark; ``n_chars``, if there, follows. Null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        return pd.Series([None if x is None else redacted(bytes(x), sent.value).decode("utf-8", "replace") for x in texts], dtype=object)

    columns = [c for c in docs.columns]
    cleaned = lean(docs).withColumn("text", clean(F.col("text").cast("binary")))
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cleaned.select(*columns)
