"""Substring dedup: repeated word windows are found by super-k-mer partitioning."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import buckets_for, checkpointed, in_workers, lean, sample_rows

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
CHUNK = 16 << 20  # bytes of text whose super-k-mers are packed together
WORDS_KEPT = 300_000  # word hashes remembered by a worker


class WordHashes(dict):
    """Word -> XXH64, remembered for frequent words; forgotten as a whole beyond a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive entries, order included."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(MIX[0])
        out += h[k:len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(MIX[1])
    return out ^ (out >> np.uint64(32))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x


TOP = np.uint64(1 << 63)
TABLE = 1 << 20  # places of the table of frequent minimisers


def runs(words: list[bytes], window: int, m: int, known: WordHashes, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: (key, first window, end of windows) of maximal runs of windows with one key.

    The key is the window's minimiser: the least hash of its ``m``-word sequences that are not ``frequent``. A window
    of frequent ones alone has the least hash of its sequences of two thirds of a window instead. So the key depends
    on the window's words alone, equal windows meet, and a sequence that is everywhere draws no windows to itself.
    """
    h = hashed(words, known)
    parts = rolled(h, m)
    if frequent is not None:
        common = frequent[(parts & np.uint64(TABLE - 1)).astype(np.int64)]
        parts = np.where(common, parts | TOP, parts & ~TOP)
    least = sliding_min(parts, window - m + 1)
    if frequent is not None:
        heavy = least >= TOP
        if heavy.any():
            long = max(m, 2 * window // 3)
            least = np.where(heavy, sliding_min(rolled(h, long), window - long + 1) | TOP, least)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first], first, np.append(first[1:], len(least))


def frequent_sequences(rows: DataFrame, m: int, buckets: int, most: int = 4096, most_kept: int = TABLE // 16) -> np.ndarray | None:
    """A table, by the low bits of the hash, of ``m``-word sequences that would draw more than a bucket's share.

    Taken from at most ``most`` documents; counted by the executors, and at most ``most_kept`` sequences reach the
    driver, the most frequent. Only the evenness of buckets depends on it, never a result.
    """

    def counted(_, text):
        words = text.split()
        if len(words) >= m:
            yield from zip(*(x.tolist() for x in np.unique(rolled(hashed(words, WordHashes()), m).view(np.int64), return_counts=True)), strict=True)

    counts = checkpointed(in_workers(sample_rows(rows, "doc_id", ["text"], most), counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("n") > 3) & (F.col("n") * 2 * buckets > total)).orderBy(F.desc("n"), "h").limit(most_kept).select("h").collect()
    if not found:
        return None
    table = np.zeros(TABLE, bool)
    table[np.array([r[0] for r in found], np.int64) & (TABLE - 1)] = True
    return table


class _Bucket:
    """What one chunk sends to one bucket: packed strings with their places, and verdicts reached already."""

    __slots__ = ("doc", "tag", "at", "text", "settled")

    def __init__(self):
        self.doc, self.tag, self.at, self.text = [], [], [], []
        self.settled = []

    def pack(self) -> bytes:
        body = b"\n".join(self.text)
        head = struct.pack("<III", len(self.doc), len(self.settled), len(body))
        doc = np.array(self.doc, "<i8")
        # neighbours have near doc_ids: differences, byte by byte, leave planes of zeros
        raw = b"".join((head, planes(np.diff(doc, prepend=np.int64(0))), planes(np.array(self.tag, "<i4")), planes(np.array(self.at, "<i4")), planes(np.array(self.settled, "<i8").reshape(-1)), body))
        return zstandard.ZstdCompressor(level=3).compress(raw)


def planes(x: np.ndarray) -> bytes:
    """First all lowest bytes, then all second ones, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplaned(raw: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(flat.T).view(kind).reshape(n), at + n * size


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, settled, size = struct.unpack_from("<III", raw)
    doc, at = unplaned(raw, "<i8", n, 12)
    tag, at = unplaned(raw, "<i4", n, at)
    place, at = unplaned(raw, "<i4", n, at)
    done, at = unplaned(raw, "<i8", 4 * settled, at)
    body = np.frombuffer(raw, np.uint8, size, len(raw) - size)
    return np.cumsum(doc), tag.astype(np.int64), place, done.reshape(-1, 4), body


def _scatter(batches: Iterator[pa.RecordBatch], window: int, m: int, buckets: int, frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    out: dict[int, _Bucket] = defaultdict(_Bucket)
    seen: dict[bytes, tuple[int, int, int, int]] = {}
    held = 0

    def flush():
        keys = sorted(out)
        blobs = [out[k].pack() for k in keys]
        out.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for batch in batches:
        for doc, tag, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            doc, tag, text = doc.as_py(), tag.as_py(), text.as_py()
            words = text.split()
            if len(words) < window:
                continue
            joined = b" ".join(words)
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
            least, first, end = runs(words, window, m, known, frequent)
            where = (least % np.uint64(buckets)).tolist()
            ends = (starts[end + window - 1] - 1).tolist()
            for bucket, i, j, a, b in zip(where, first.tolist(), end.tolist(), starts[first].tolist(), ends, strict=True):
                packed, to = joined[a:b], out[bucket]
                old = seen.get(packed)
                # a copy of a super-k-mer in this chunk is settled here: only the smallest document's travels
                if old is not None and old[0] != doc:
                    if old[0] < doc:
                        to.settled.append((doc, tag, i, j))
                        continue
                    k = old[3]
                    to.settled.append((old[0], old[1], old[2], old[2] + j - i))
                    to.doc[k], to.tag[k], to.at[k] = doc, tag, i
                    seen[packed] = (doc, tag, i, k)
                    continue
                if old is None:
                    seen[packed] = (doc, tag, i, len(to.doc))
                to.doc.append(doc)
                to.tag.append(tag)
                to.at.append(i)
                to.text.append(packed)
            held += len(text)
            if held >= CHUNK:
                yield flush()
                held = 0
    if out:
        yield flush()


SLICE = 1 << 19  # bytes whose words are hashed at once
LONG = 4096  # bytes beyond which two windows are compared as strings


@cache
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, the powers of an odd number up to SLICE, and those of its inverse, all modulo 2^64."""
    base = MIX[1]
    up = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(SLICE, x, np.uint64))))
    return np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64), up(base), up(pow(base, -1, 1 << 64))


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, the same wherever the word lies: differences of running sums, no word by word."""
    each, power, inverse = powers()
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + SLICE, "right"))
        if j <= i:  # one word longer than a slice
            out[i] = xxhash.xxh64_intdigest(body[base:end[i]].tobytes())
            i += 1
            continue
        sums = np.zeros(int(end[j - 1]) - base + 1, np.uint64)
        np.cumsum(each[body[base:end[j - 1]]] * power[:len(sums) - 1], out=sums[1:])
        at = start[i:j] - base
        out[i:j] = (sums[end[i:j] - base] - sums[at]) * inverse[at]
        i = j
    return out


def same_bytes(body: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at left and right are equal; ``body`` has 8 bytes to spare at its end."""
    eight = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))
    same, live, k = np.ones(len(left), bool), np.flatnonzero(size <= LONG), 0
    for i in np.flatnonzero(size > LONG).tolist():
        a, b, n = int(left[i]), int(right[i]), int(size[i])
        same[i] = np.array_equal(body[a:a + n], body[b:b + n])
    while len(live):
        over = np.maximum(8 - (size[live] - k), 0).astype(np.uint64) * np.uint64(8)  # bits beyond the end
        same[live] = ((eight[left[live] + k] ^ eight[right[live] + k]) << over) == 0
        k += 8
        live = live[same[live] & (size[live] > k)]
    return same


def _later_windows(blobs: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc, tag, from, to) of windows whose words also start in a smaller document.

    Windows are sorted by a hash of their words, and equal neighbours are compared byte by byte (words are joined by
    one space), so that each set of equal windows is exact.
    """
    bodies, docs, tags, ats, offset, done, rows = [], [], [], [], [], [], 0
    for blob in blobs:
        doc, tag, at, settled, body = unpack(blob)
        done.append(settled)
        if not len(doc):
            continue
        gaps = np.flatnonzero((body == 32) | (body == 10))
        last = np.append(np.flatnonzero(body[gaps] == 10), len(gaps))  # of each string's words
        length = np.diff(last, prepend=-1)
        begin = last - length + 1
        many = length - window + 1
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        bodies.append((body, gaps))
        offset.append(np.repeat(begin, many) + within + rows)
        rows += len(gaps) + 1
        docs.append(np.repeat(doc, many))
        tags.append(np.repeat(tag, many))
        ats.append((np.repeat(at, many) + within).astype(np.int32))
    done = np.concatenate(done) if done else np.zeros((0, 4), np.int64)
    if not bodies:
        return done[:, 0], done[:, 1], done[:, 2], done[:, 3]
    shift = np.cumsum([0] + [len(x) + 1 for x, _ in bodies])
    end = np.concatenate([np.append(gaps, len(x)) + k for (x, gaps), k in zip(bodies, shift, strict=False)])
    body = np.frombuffer(b"\n".join([*(x for x, _ in bodies), bytes(8)]), np.uint8)
    start = np.concatenate(([0], end[:-1] + 1))
    at_word, doc, tag, at = (np.concatenate(x) for x in (offset, docs, tags, ats))
    del bodies, offset, docs, tags, ats
    first, size = start[at_word], end[at_word + window - 1] - start[at_word]
    h = rolled(word_hashes(body, start, end) * np.uint64(MIX[2]), window)[at_word]
    order = np.lexsort((doc, h))
    hs = h[order]
    alike = hs[1:] == hs[:-1]
    left, right = order[:-1][alike], order[1:][alike]
    same = size[left] == size[right]
    same[same] = same_bytes(body, first[left][same], first[right][same], size[left][same])
    if not same.all():  # two different windows with one hash: sort by the words themselves
        ids: dict[bytes, int] = {}
        exact = np.array([ids.setdefault(body[a:a + n].tobytes(), len(ids)) for a, n in zip(first.tolist(), size.tolist(), strict=True)])
        order = np.lexsort((doc, exact))
        alike = exact[order[1:]] == exact[order[:-1]]
    group = np.concatenate(([0], np.cumsum(~alike)))
    head = np.flatnonzero(np.concatenate(([True], ~alike)))
    later = doc[order] > doc[order][head][group]  # sorted by document inside a group
    hit = order[later]
    return np.concatenate((doc[hit], done[:, 0])), np.concatenate((tag[hit], done[:, 1])), np.concatenate((at[hit].astype(np.int64), done[:, 2])), np.concatenate((at[hit].astype(np.int64) + 1, done[:, 3]))


def _gather(bucket: pa.Table, window: int) -> pa.Table:
    doc, tag, a, b = _later_windows(bucket.column("blob").to_pylist(), window)
    order = np.lexsort((b, a, tag, doc))
    doc, tag, a, b = doc[order], tag[order], a[order], b[order] + window - 1
    # spans of covered words; those of one document that overlap or touch become one
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        lot = np.cumsum(new)
        reach = np.maximum.accumulate(b + lot * (1 << 40)) - lot * (1 << 40)
        new[1:] |= a[1:] > reach[:-1]
        at = np.flatnonzero(new)
        doc, tag, a, b = doc[at], tag[at], a[at], np.maximum.reduceat(b, at)
    lot = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) if len(doc) else np.zeros(0, np.int64)
    spans = [np.stack((a[i:j], b[i:j]), 1).astype("<i4").tobytes() for i, j in zip(lot, np.append(lot[1:], len(doc)), strict=True)] if len(doc) else []
    return pa.table({"doc_id": pa.array(doc[lot], pa.int64()), "tag": pa.array(tag[lot], pa.int64()), "spans": pa.array(spans, pa.binary())})


def tag_of_text():
    """32 bits of the text's hash, which tell apart rows that share a doc_id but not a text."""
    return F.hash("text").cast("long").alias("tag")


def repeated_spans(docs: DataFrame, window: int = 13, m: int = 3) -> DataFrame:
    """(doc_id, tag, spans): word spans to remove, as little-endian int32 pairs; ``tag`` is a hash of the text.

    The number of buckets grows with the input, so that a bucket's size does not. Sequences that a sample finds too
    often to be a bucket are no minimisers (``runs``), so one of them in most documents makes no hot bucket.
    """
    rows = lean(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tag_of_text(), F.col("text").cast("binary").alias("text"))
    buckets = buckets_for(rows, 2 << 20, 64)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_sequences(rows.select("doc_id", "text"), m, buckets))  # TABLE bytes
    sent = rows.mapInArrow(lambda it: _scatter(it, window, m, buckets, frequent.value), "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(lambda t: _gather(t, window), "doc_id long, tag long, spans binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from itertools import compress

    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or b"").split()
            n = len(words)
            if spans.is_valid:
                keep = np.ones(n, bool)
                for s in spans.as_py():
                    for a, b in np.frombuffer(s, "<i4").reshape(-1, 2).tolist():
                        keep[a:b] = False
                words = list(compress(words, keep.tolist()))
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = 13, m: int = 3) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without words that a window of ``window`` words covers
    whose words also start in a document with a smaller doc_id. Windows are judged on the input.

    One row per row of ``docs``. Null text: no words. Fewer words than a window, or a null doc_id: nothing is
    removed, and a row without doc_id is no earlier document. Repeated rows share a doc_id, so neither is
    earlier; both lose what an earlier document holds. Other columns are not read.
    """
    spans = repeated_spans(docs, window, m).groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("tag").alias("__t"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag_of_text())
    joined = rows.join(spans, (F.col("doc_id") == F.col("__d")) & (F.col("tag") == F.col("__t")), "left")
    cut = joined.select("doc_id", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM texts, unnest(range(1, len(ws) - 11)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS d FROM windows GROUP BY k
), covered AS (
  SELECT DISTINCT w.doc_id, i + j AS p FROM windows w JOIN firsts USING (k), unnest(range(0, 13)) AS u(j) WHERE d < w.doc_id
), words AS (
  SELECT doc_id, p, ws[p] AS w FROM texts, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS kept FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
