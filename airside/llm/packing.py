"""Best-fit packing by exact-complement hashing (operator 5).

Texts become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths
(``capacity`` numbers, whatever the corpus) reaches the driver. There it is turned into
patterns: combinations of lengths with a multiplicity. An index of single, pair and triple
sums finds combinations that exactly fill the gap a long piece leaves; what remains is
packed best fit. Each pattern uses up at least one length, so there are at most
``2 * capacity`` of them. Pieces then find their place by their rank among the pieces of
their length, which needs counts by task and no global sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airside.llm.common import materialise
from airside.llm.tokens import as_lists, batches_of_text, encoder, id_bytes

#: Parts kept by one Python worker; the workers' memory may hold what other operators left.
CACHE_PARTS = 300_000


def cut_pieces(docs: DataFrame, tokenizer: str, end_ids: list[int], capacity: int, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, ids, part, local_rank.

    Texts of more than ``capacity`` ids are cut from the end, so that only the first piece is
    shorter. ``part`` is the task that made the piece and ``local_rank`` its number among
    that task's pieces of the same length. Null text is the empty text (only the end ids).
    Without ``keep_ids`` the ids themselves are left out. Other columns are ignored.
    """
    end = id_bytes(end_ids)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", ids array<int>" * keep_ids

    def cut(batches):
        enc, part, seen = encoder(tokenizer, CACHE_PARTS), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in batches_of_text(batches, ("doc_id", "text")):
            out, chunks = [], []
            for doc, text in rows:
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                at, size = 0, n % capacity or capacity
                piece = 0
                while at < n:
                    chunk = ids[4 * at : 4 * (at + size)]
                    out.append((doc, piece, at, size, zlib.crc32(chunk), part, int(seen[size])))
                    seen[size] += 1
                    if keep_ids:
                        chunks.append(chunk)
                    at, size, piece = at + size, capacity, piece + 1
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            yield pa.RecordBatch.from_arrays([*arrays, as_lists(chunks)] if keep_ids else arrays, names=[*names, "ids"] if keep_ids else names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class SumIndex:
    """Pairs of present lengths by their sum; triples are a length and a pair of the rest."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.present = np.flatnonzero(counts)
        a, b = np.meshgrid(self.present, self.present, indexing="ij")
        a, b = a[a <= b], b[a <= b]
        keep = a + b < len(counts)
        a, b = a[keep], b[keep]
        order = np.lexsort((a, a + b))  # within a sum, the pair with the longest member first
        self.a, self.b = a[order], b[order]
        self.at = np.searchsorted(self.a + self.b, np.arange(len(counts) + 1))

    def pair(self, total: int, longest: int | None = None) -> tuple[int, int] | None:
        if total < 2 or total >= len(self.counts):
            return None
        a, b, c = self.a[self.at[total] : self.at[total + 1]], self.b[self.at[total] : self.at[total + 1]], self.counts
        ok = (c[a] > 0) & (c[b] > (a == b))
        if longest is not None:
            ok &= b <= longest
        hit = int(ok.argmax()) if ok.any() else -1
        return None if hit < 0 else (int(b[hit]), int(a[hit]))

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Up to three available lengths that add up to ``gap`` exactly, else None."""
        c = self.counts
        if gap == 0:
            return ()
        if c[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        for x in self.present[np.searchsorted(self.present, gap) - 1 :: -1] if gap > 2 and len(self.present) and self.present[0] < gap else ():
            if 3 * x < gap:
                break
            if c[x] > 0:
                c[x] -= 1
                rest = self.pair(gap - int(x), int(x))
                c[x] += 1
                if rest:
                    return (int(x), *rest)
        return None


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, multiplicity) of the sequences to make; every piece is in exactly one."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        kinds, uses = np.unique(lengths, return_counts=True)
        times = int((counts[kinds] // uses).min())
        counts[kinds] -= times * uses
        plan.append((tuple(sorted(lengths, reverse=True)), times))

    index = SumIndex(counts)
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1
            rest = index.fill(capacity - length)
            counts[length] += 1
            if rest is None:
                break
            use((length, *rest))
    index = SumIndex(counts)
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            taken, gap = [length], capacity - length
            counts[length] -= 1
            while gap > 0:
                more = index.fill(gap)
                if more is None:
                    fits = np.flatnonzero(counts[: gap + 1])
                    more = (int(fits[-1]),) if len(fits) else ()
                if not more:
                    break
                for x in more:
                    counts[x] -= 1
                    gap -= x
                taken += more
            for x in taken:
                counts[x] += 1
            use(tuple(taken))
    return plan


def plan_places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: arrays sorted by (length, first rank).

    ``uses`` pieces in a row share a sequence, from ``sequence`` on, the first at ``offset``.
    """
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            uses = lengths.count(length)
            rows.append((length, taken[length], sequence, uses, offset))
            taken[length] += uses * times
            offset += uses * length
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "uses", "offset"), cols, strict=True))


def pack(docs: DataFrame, tokenizer: str, end_ids: list[int], capacity: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids with ``keep_ids``). Offsets of a sequence are gapless from 0.

    Null text: only the end ids. Equal rows are packed separately. A null doc_id is kept.
    Extra columns are ignored. No rows: no rows. Very long texts: as many pieces as needed.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_ids, capacity, keep_ids), "pieces")
    by_task = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(by_task.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), "count"), "ranks")
    histogram = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    places = docs.sparkSession.sparkContext.broadcast(plan_places(plan_patterns(histogram, capacity), capacity))

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = pieces.join(base.select("length", "part", "base"), ["length", "part"]).select(*keep, (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batches):
        p = places.value
        key = p["length"] << 44 | p["rank"]  # ranks stay below 2**44
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64), b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - p["rank"][at]
            sequence, offset = p["sequence"][at] + nth // p["uses"][at], p["offset"][at] + nth % p["uses"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
