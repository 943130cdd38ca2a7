"""Document fingerprints: a quartile bucket digest (operator 9).

Triplets of bytes within a window of five are hashed into 256 buckets. The digest keeps, for
each bucket, the quartile of its count among the text's bucket counts (two bits), and the
length on a logarithmic scale. Two digests differ by the sum of their quartile steps and a
length term; the likeness is one minus that difference over a bound, and not below zero.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airside.llm.common import materialise

BUCKETS = 256
#: Places of the second and third byte of a triplet, within five bytes.
WINDOW = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
#: Steps by the difference of two quartile codes, and the difference that counts as none alike.
STEPS = np.array([0, 1, 2, 6])
BOUND = 400
_BLOCK_BYTES = 2_000_000


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts by text and bucket; a triplet never spans two texts."""
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # bytes up to the text's end
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    for k, (i, j) in enumerate(WINDOW):
        if len(raw) <= j:
            continue
        mixed = raw[: len(raw) - j] * np.uint32(0x9E3779B1) + raw[i : len(raw) - j + i] * np.uint32(0x85EBCA6B) + raw[j:] * np.uint32(0xC2B2AE35) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(24)
        whole = left[: len(raw) - j] > j
        total += np.bincount((owner[: len(raw) - j] + bucket)[whole], minlength=len(total))
    return total.reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """Quartile codes (BUCKETS columns) and a length code (last column) of every text."""
    out = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < _BLOCK_BYTES or end == at):
            size += len(texts[end])
            end += 1
        counts = _counts(texts[at:end])
        cut = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1), axis=1)
        for q in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
            out[at:end, :BUCKETS] += counts > cut[:, q : q + 1]
        out[at:end, BUCKETS] = [min(255, round(np.log1p(len(t)) / np.log(1.1))) for t in texts[at:end]]
        at = end
    return out


def as_text(digest: np.ndarray) -> str:
    """Length code and quartile codes as hexadecimal digits."""
    four = digest[:BUCKETS].reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{digest[BUCKETS]:02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of digests row by row, from 0 to 1; 1 for equal digests."""
    a, b = a.astype(np.int16), b.astype(np.int16)
    steps = STEPS[np.abs(a[:, :BUCKETS] - b[:, :BUCKETS])].sum(axis=1)
    length = np.abs(a[:, BUCKETS] - b[:, BUCKETS])
    return np.maximum(0.0, 1 - (steps + np.minimum(4 * length, 100)) / BOUND)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(ids: list, texts: list[str], nexts: list[str]) -> list[list]:
    """Output columns for documents and the documents after them."""
    edited = [(t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode("utf-8", "replace") for t, n in zip(texts, nexts, strict=True)]
    own = digests([t.encode("utf-8", "replace") for t in [*texts, nexts[-1]]])
    follows = own[1:] if all(a is b for a, b in zip(nexts[:-1], texts[1:], strict=True)) else digests([n.encode("utf-8", "replace") for n in nexts])
    own, changed = own[:-1], digests(edited)
    return [ids, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], [*map(as_text, own)], [*map(as_text, changed)], likeness(own, changed).tolist(), likeness(own, follows).tolist()]


def _within(batches):
    """Compare the rows of a sorted range with their successors.

    The last row's successor is in another range, so the first and the last row are handed
    on with their texts (kind 1 and 2).
    """
    part, held, first = TaskContext.get().partitionId(), None, True
    spare = [None] * 6

    def rows(kind: int, cols: list[list], texts: list) -> pa.RecordBatch:
        n = len(texts)
        arrays = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string()), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "part", "text", *_NAMES])

    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        if not ids:
            continue
        if first:
            yield rows(1, [[ids[0]], *([x] for x in spare)], texts[:1])
            first = False
        if held:
            ids, texts = [held[0], *ids], [held[1], *texts]
        at, block = 0, 512
        while at < len(ids) - 1:
            end = min(at + block, len(ids) - 1)
            yield rows(0, _compared(ids[at:end], texts[at:end], texts[at + 1 : end + 1]), [None] * (end - at))
            at = end
        held = (ids[-1], texts[-1])
    if held:
        yield rows(2, [[held[0]], *([x] for x in spare)], [held[1]])


def _across(batches):
    for b in batches:
        for i, t, n in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("next_text").to_pylist(), strict=True):
            cols = _compared([i], [t], [n])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and its edited text (the last quarter of its code points
    replaced by the start of the next document's, in ascending doc_id; after the last, the
    first): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One range shuffle sorts the texts. Successors across ranges are joined afterwards, from
    one first and one last row a range. Null text is the empty text. Null ids come first; rows
    of one id stand in the order of a hash of their text. A single row follows itself.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialise(ranged.mapInArrow(_within, f"kind int, part int, text string, {_OUT}"), "digests")
    edges = done.where("kind > 0")
    parts = edges.where("kind = 1").select("part")
    w = Window.orderBy("part")  # a row for each range
    after = parts.select("part", F.coalesce(F.lead("part").over(w), F.min("part").over(w)).alias("next_part"))
    firsts = edges.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = edges.where("kind = 2").select("part", "doc_id", "text")
    crossing = lasts.join(after, "part").join(firsts, "next_part").select("doc_id", "text", "next_text").mapInArrow(_across, _OUT)
    return done.where("kind = 0").select(*_NAMES).unionByName(crossing)
