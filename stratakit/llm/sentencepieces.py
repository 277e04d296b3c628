"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.llm.common import lean

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_SETTING = "spark.stratakit.pieces"  # a session may name another vocabulary file
UNKNOWN_PENALTY = 10.0
CACHED = 150_000  # chunks of text that a worker remembers
CACHED_LENGTH = 48
LOT = 1 << 19


class DoubleArray:
    """A trie over bytes in two arrays: the child of s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        self.base, self.check, self.value = [0], [0], [-1]
        keys = sorted(keys)
        low, branching = 258, 258  # where the search for room starts, for one child and for several
        todo = [(0, 0, len(keys), 0)]  # state, its keys, depth
        while todo:
            state, a, b, depth = todo.pop()
            if a < b and len(keys[a][0]) == depth:
                self.value[state] = keys[a][1]
                a += 1
            if a == b:
                continue
            cuts, codes = [a], [keys[a][0][depth]]
            for k in range(a + 1, b):
                c = keys[k][0][depth]
                if c != codes[-1]:
                    cuts.append(k)
                    codes.append(c)
            cuts.append(b)
            while low < len(self.check) and self.check[low] >= 0:
                low += 1
            at = max(1, (low if len(codes) == 1 else branching) - codes[0] - 1)
            while True:
                self._reach(at + codes[-1] + 2)
                if all(self.check[at + c + 1] < 0 for c in codes):
                    break
                at += 1
            if len(codes) > 1:
                branching = at + codes[0] + 1
            self.base[state] = at
            for c in codes:
                self.check[at + c + 1] = state
            todo += [(at + c + 1, cuts[k], cuts[k + 1], depth + 1) for k, c in enumerate(codes)]
        self._reach(max(self.base) + 258)

    def _reach(self, n: int) -> None:
        more = n - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Pieces:
    """A vocabulary: (piece, log score, kind) by id; kind is "normal", "byte" or another that is never matched."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        normal = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == "normal"]
        self.trie = DoubleArray([(p.encode(), i) for p, _, i in normal])
        self.scores = [s for _, s, _ in pieces]
        self.unknown = min((s for _, s, _ in normal), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        self.bytes = []
        for i, (p, _, k) in enumerate(pieces):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes.append(p.replace(MARK, " ").encode() if k == "normal" else b"")
        self.is_byte = np.array([k == "byte" for _, _, k in pieces])
        held = {c for p, _, _ in normal for c in p}
        # no piece goes on past a word's end, so words can be cut apart before the search; nor does one hold these
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            self.cut = re.compile(r"(?s).+")
        else:
            alone = "".join(c for c in "\n\t\r" if c not in held)
            self.cut = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")
        self.longest = max((len(p.encode()) for p, _, _ in normal), default=1)
        self.known: dict[str, bytes] = {}
        self._arrays = None

    def best(self, text: bytes) -> list[int]:
        """The ids of the segmentation with the largest sum of log scores (Viterbi); ties: the first found."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(text)
        worst = -math.inf
        best, frm, ids = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == worst:
                continue
            first = text[i]
            one = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            single, s = False, 0
            for j in range(i, n):
                t = base[s] + text[j] + 1
                if check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0:
                    end = j + 1
                    single |= end == one
                    score = here + scores[v]
                    if score > best[end]:
                        best[end], frm[end], ids[end] = score, i, v
            if not single:
                score = here + self.unknown
                if score > best[one]:
                    best[one], frm[one], ids[one] = score, i, -1
        out, at = [], n
        while at:
            back = frm[at]
            if ids[at] >= 0:
                out.append(ids[at])
            else:  # byte fallback
                out += [self.byte_ids[c] for c in reversed(text[back:at])]
            at = back
        return out[::-1]

    def best_of_many(self, texts: list[bytes]) -> list[bytes]:
        """``best`` for many short texts at once, as little-endian int32: the same search, one position at a time for all."""
        base, check, value, scores = self.arrays()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(length)
        starts = ends - length
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        n = len(flat)
        end_of = np.repeat(ends, length)
        lead = (flat & 0xC0) != 0x80
        one = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        # every piece that starts at every character
        at = np.flatnonzero(lead)
        state = np.zeros(len(at), np.int64)
        spelled = np.zeros(n, bool)  # a piece of one character starts here
        found_at, found_len, found_id = [], [], []
        for k in range(self.longest):
            t = base[state] + flat[at + k] + 1
            ok = check[t] == state
            at, state = at[ok], t[ok]
            v = value[state]
            hit = v >= 0
            found_at.append(at[hit])
            found_len.append(np.full(int(hit.sum()), k + 1))
            found_id.append(v[hit])
            single = at[hit]
            spelled[single[one[single] == k + 1]] = True
            more = at + k + 1 < end_of[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        bare = np.flatnonzero(lead & ~spelled)
        m_at = np.concatenate((*found_at, bare))
        m_len = np.concatenate((*found_len, one[bare]))
        m_id = np.concatenate((*found_id, np.full(len(bare), -1)))
        m_score = np.append(scores, self.unknown)[m_id]
        within = m_at - np.repeat(starts, length)[m_at]
        order = np.argsort(within, kind="stable")
        m_at, m_len, m_id, m_score = m_at[order], m_len[order], m_id[order], m_score[order]
        bounds = np.searchsorted(within[order], np.arange(int(length.max(initial=0)) + 1))
        # node p + (number of the text) is the place before byte p; each text has one more node than bytes
        shift = np.repeat(np.arange(len(texts)), length)
        best = np.full(n + len(texts), -np.inf)
        best[starts + np.arange(len(texts))] = 0.0
        frm, ids = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            here = m_at[a:b] + shift[m_at[a:b]]
            score, to = best[here] + m_score[a:b], here + m_len[a:b]
            better = score > best[to]
            to = to[better]
            best[to], frm[to], ids[to] = score[better], here[better], m_id[a:b][better]
        node, first = ends + np.arange(len(texts)), starts + np.arange(len(texts))
        steps, who = [], np.arange(len(texts))
        while len(who):
            live = node > first[who]
            node, who = node[live], who[live]
            steps.append((who, ids[node]))
            node = frm[node]
        text_of = np.concatenate([x[0] for x in steps])
        out = np.concatenate([x[1] for x in steps])
        rank = np.concatenate([np.full(len(x[0]), -k) for k, x in enumerate(steps)])
        order = np.lexsort((rank, text_of))
        out, cuts = out[order].astype("<i4"), np.searchsorted(text_of[order], np.arange(len(texts) + 1)) * 4
        raw = out.tobytes()
        got = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for k in np.unique(text_of[order][out < 0]).tolist():  # byte fallback: spelled out one by one
            got[k] = np.array(self.best(texts[k]), "<i4").tobytes()
        return got

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self._arrays is None:
            self._arrays = (*(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores))
        return self._arrays

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "_arrays": None}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text. A mark in a text itself is spelled in bytes, so that decoding is exact.

        Chunks seen before are remembered, up to a fixed number; the others are searched together.
        """
        literal = np.array([self.byte_ids[c] for c in MARK.encode()], "<i4").tobytes()
        parts = [[self.cut.findall(p) for p in (" " + t).split(MARK)] if t else [] for t in texts]
        known = self.known
        if len(known) > CACHED:
            known.clear()
        new = {c for text in parts for chunks in text for c in chunks if c not in known}
        short = [c for c in new if len(c) <= CACHED_LENGTH]
        long = {c: np.array(self.best(c.replace(" ", MARK).encode()), "<i4").tobytes() for c in new if len(c) > CACHED_LENGTH}
        if short:
            known.update(zip(short, self.best_of_many([c.replace(" ", MARK).encode() for c in short]), strict=True))
        known.update(long)
        out = [literal.join(b"".join(map(known.__getitem__, chunks)) for chunks in text) for text in parts]
        for c in long:
            del known[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return text[1:] if text[:1] == b" " else text


def zipf_scores(n: int, shift: float = 2.7) -> list[float]:
    """Log probabilities by rank: a vocabulary that knows only the order of its merges is scored by Zipf's law."""
    total = sum(1 / (k + shift) for k in range(n))
    return [-math.log((k + shift) * total) for k in range(n)]


def read_pieces(path: str = DEFAULT_MODEL) -> list[tuple[str, float, str]]:
    """The pieces of a SentencePiece model file, with its log scores if it is a Unigram model, else by rank."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["byte" if own.is_byte(i) else "other" if own.is_control(i) or own.is_unknown(i) or own.is_unused(i) else "normal" for i in range(own.vocab_size())]
    if model.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM:
        scores = [own.get_score(i) for i in range(own.vocab_size())]
    else:
        ranked = iter(zipf_scores(kinds.count("normal")))
        scores = [next(ranked) if k == "normal" else 0.0 for k in kinds]
    return [(own.id_to_piece(i), scores[i], kinds[i]) for i in range(own.vocab_size())]


def model_of(spark: SparkSession) -> str:
    """The vocabulary file that the session names, a path that the driver can read."""
    return spark.conf.get(MODEL_SETTING, DEFAULT_MODEL)


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Read on the driver alone; executors get the built trie by broadcast (its size is the vocabulary's)."""
    return Pieces(read_pieces(path))


def _lots(values: pa.Array, pieces: Pieces) -> Iterator[tuple[int, list[bytes | None]]]:
    """(number of the first, encoded texts), in lots of half a megabyte: what is held at once is bounded by a lot."""
    lot: list[str | None] = []
    held = 0
    for k, x in enumerate(values):
        lot.append(x.as_py())
        held += len(lot[-1] or "")
        if held >= LOT or k == len(values) - 1:
            got = iter(pieces.encode_many([t for t in lot if t is not None]))
            yield k + 1 - len(lot), [None if t is None else next(got) for t in lot]
            lot, held = [], 0
    pa.default_memory_pool().release_unused()


def _by_size(values: pa.Array, pieces: Pieces) -> Iterator[bytes | None]:
    for _, lot in _lots(values, pieces):
        yield from lot


def encode(docs: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ids (array of int). Null text gives null ids, empty text none."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = lean(docs).select(*keep, F.col("text").alias("ids"))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, packed in _lots(batch.column(len(keep)), sent.value):
                ends = np.cumsum([0] + [len(x) // 4 if x else 0 for x in packed])
                flat = pa.array(np.frombuffer(b"".join(x or b"" for x in packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([x is None for x in packed]))
                own = [c.slice(first, len(packed)) for c in batch.columns[:len(keep)]]
                yield pa.RecordBatch.from_arrays([*own, ids], [*batch.schema.names[:len(keep)], "ids"])

    return rows.mapInArrow(coded, schema)


def decode(tokens: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and text, from ids. Null ids give null; bytes that are no UTF-8 become replacement marks."""
    sent = tokens.sparkSession.sparkContext.broadcast(pieces)
    schema = tokens.select(*keep).schema.add("text", "string")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else sent.value.decode(np.array(x.as_py(), "<i4").tobytes()).decode("utf-8", "replace") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())], [*batch.schema.names[:len(keep)], "text"])

    return lean(tokens).select(*keep, "ids").mapInArrow(spelled, schema)


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_sha256, decoded_sha256) for each row: encoded and decoded in one pass.

    ids_sha256 is over the ids as little-endian int32, decoded_sha256 over the decoded bytes. Null text: no
    pieces, and null digests. Texts are coded whole; repeated rows are repeated.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for ids in _by_size(batch.column(1), sent.value):
                if ids is None:
                    got.append((0, 0, None, None))
                    continue
                n = np.frombuffer(ids, "<i4")
                got.append((len(n), int(sent.value.is_byte[n].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(sent.value.decode(ids)).hexdigest()))
            cols = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.string()) for c in cols[2:])], ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(coded, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string")
