"""Language-model scores of texts from an Elias-Fano n-gram trie (operator 12).

The model gives each word, and the end of the text, a probability after the word before:
absolute discounting, interpolated with the words' own smoothed frequencies. With c(v, w) how
often w follows v, k(v) how often v is followed by anything, t(v) by how many different words,

    p(w | v) = max(c(v, w) - D, 0) / k(v) + D t(v) / k(v) p(w),   p(w) = (c(w) + a) / (N + a (V + 1)),

and p(w) alone after a word never seen. The probabilities of all words, one unknown word among
them, sum to 1. D comes from the numbers of pairs seen once and twice.

Pairs are dealt to shards by a hash of both words, so that neither a frequent word nor a frequent
pair (equal ones are one row in each batch of texts) loads one shard; their number follows the
characters of the corpus. Blocks of packed arrays travel, not a row for each word: for counting
a batch's distinct pairs and their counts, for scoring its distinct pairs and the documents
they stand in. A shard merges its counts, asks the vocabulary for its words' totals (each part of it merges what all shards say of its words), builds
its trie (see ``elias_fano``) with quantised probabilities, and scores the pairs it has. Words
of unseen pairs that it doesn't know are looked up by a join. Sums by document follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.llm.common import materialise
from airside.llm.elias_fano import STEP, Trie, quantised
from airside.llm.tokens import batches_of_text

#: Characters of the corpus that one shard stands for.
SHARD_CHARS = 48_000_000
#: Added to every word's count in its own probability.
ADDED = 0.1
#: Texts of a batch are joined to up to so many tokens and texts; a longer text is a batch of its own.
BATCH_TOKENS, BATCH_TEXTS = 1_500_000, 60_000
#: Pairs of a shard that wait before they are merged.
WAITING = 2_000_000

_U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased: bytes know but ASCII letters, and only blank and tab to carriage return part them."""
    return text.encode().lower().split() if text else []


def word_hash(word: bytes | str) -> int:
    """63 bits, so that signed and unsigned order agree."""
    return xxhash.xxh64_intdigest(word) >> 1


#: No word has a space: these are hashes of none.
START, END = word_hash("start "), word_hash("end ")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _tokenised(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, hashes (ascending), and for each token the numbers of the word before it, of itself and of its text."""

    def packed(ids, numbers, found, lengths):
        table = np.array([word_hash(w) for w in numbers] + [START, END], np.int64)
        hashes, at = np.unique(table, return_inverse=True)
        at = at.astype(np.int32)
        each = np.array(lengths) + 1
        ends = np.cumsum(each) - 1
        words = np.full(int(each.sum()), at[-1], np.int32)
        inner = np.ones(len(words), bool)
        inner[ends] = False
        words[inner] = at[np.concatenate(found)] if found else []
        before = np.roll(words, 1)
        before[np.concatenate([[0], ends[:-1] + 1])] = at[-2]
        return ids, hashes, before, words, np.repeat(np.arange(len(lengths), dtype=np.int32), each)

    numbers, found, ids, lengths, many = _Numbers(), [], [], [], 0
    for rows in batches_of_text(batches, ("doc_id", "text")):
        for doc, text in rows:
            words = tokens(text)
            if words:
                found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            ids.append(doc)
            lengths.append(len(words))
            many += len(words)
            if many >= BATCH_TOKENS or len(ids) >= BATCH_TEXTS:
                yield packed(ids, numbers, found, lengths)
                numbers, found, ids, lengths, many = _Numbers(), [], [], [], 0
    if ids:
        yield packed(ids, numbers, found, lengths)


def _shard_of(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    x = (v.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (w.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return ((x >> _U(33)) % _U(shards)).astype(np.int64)


def _by_shard(hashes: np.ndarray, v: np.ndarray, w: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard its pairs' indices, the hashes of the words they use, and the pairs in the numbers of these."""
    shard = _shard_of(hashes[v], hashes[w], shards)
    order = np.argsort(shard.astype(np.int16) if shards < 1 << 15 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    number = np.empty(len(hashes), np.int64)
    for s in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[s] : cuts[s + 1]]
        there = np.zeros(len(hashes), bool)
        there[v[at]] = there[w[at]] = True
        used = np.flatnonzero(there)
        number[used] = np.arange(len(used))
        yield int(s), at, hashes[used], number[v[at]], number[w[at]]


_BLOCK = "shard int, kind int, part int, once long, twice long, batch long, words binary, v binary, w binary, n binary, c binary, k binary, t binary, docs binary, doc_no binary, doc_ids array<long>"
_BLOCK_ARROW = pa.schema([*[(c, pa.int32()) for c in ("shard", "kind", "part")], *[(c, pa.int64()) for c in ("once", "twice", "batch")], *[(c, pa.binary()) for c in ("words", "v", "w", "n", "c", "k", "t", "docs", "doc_no")], ("doc_ids", pa.list_(pa.int64()))])
_ARRAYS = {"words": "<i8", "v": "<u4", "w": "<u4", "n": "<u4", "c": "<i8", "k": "<i8", "t": "<i8", "docs": "<u2", "doc_no": "<u2"}
#: Ascending arrays are kept as differences.
_ASCENDING = ("words", "v", "doc_no")
#: Kinds of rows in the order in which a shard needs them: totals of its words, its counts, what is to be scored. Then the vocabulary's own.
_TOTALS, _COUNTS, _TEXTS, _WORDS = 0, 1, 2, 3


def _pack(name: str, a: np.ndarray) -> bytes:
    """An array's bytes, first of all its numbers, then second of all and so on, compressed: high bytes are mostly alike."""
    a = np.diff(a, prepend=0) if name in _ASCENDING else a
    octets = np.ascontiguousarray(a.astype(_ARRAYS[name])).view(np.uint8).reshape(len(a), -1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets.T).tobytes())


def _unpack(name: str, packed: bytes) -> np.ndarray:
    kind = np.dtype(_ARRAYS[name])
    octets = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(kind.itemsize, -1)
    a = np.ascontiguousarray(octets.T).view(kind).ravel()
    if name in _ASCENDING:
        return np.cumsum(a, dtype=np.int64).astype(np.int64 if name == "words" else np.int32)
    return a.astype(np.int32 if name in ("v", "w", "docs") else np.int64)


def _block(shard: int, kind: int, plain: dict, **arrays: np.ndarray) -> pa.RecordBatch:
    row = {"shard": shard, "kind": kind} | plain | {k: _pack(k, a) for k, a in arrays.items()}
    return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)


def _arrays(row: dict, *names: str) -> list[np.ndarray]:
    return [_unpack(n, row[n]) for n in names]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: their arrays are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _counted(shards: int):
    """Blocks of the distinct pairs of each batch, with their counts."""

    def run(batches):
        for _, hashes, before, words, _ in _tokenised(batches):
            pair, n = np.unique(before.astype(np.int64) * len(hashes) + words, return_counts=True)
            for s, at, own, sv, sw in _by_shard(hashes, pair // len(hashes), pair % len(hashes), shards):
                yield _block(s, _COUNTS, {}, words=own, v=sv, w=sw, n=n[at])

    return run


def _merged(blocks: list[tuple]) -> tuple:
    """One block of several: words, v, w, n."""
    words = np.unique(np.concatenate([b[0] for b in blocks]))
    places = [np.searchsorted(words, b[0]) for b in blocks]
    pairs = np.concatenate([p[b[1]].astype(np.int64) * len(words) + p[b[2]] for p, b in zip(places, blocks, strict=True)])
    n = np.concatenate([b[3] for b in blocks])
    if len(words) ** 2 < 1 << 42 and n.max() < 1 << 21:  # both go into one number, which is sorted where it stands
        pairs <<= 21
        pairs |= n
        pairs.sort()
        n = pairs & ((1 << 21) - 1)
        pairs >>= 21
    else:
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    n = np.add.reduceat(n, first)
    pair = pairs[first]
    del pairs
    return words, (pair // len(words)).astype(np.int32), (pair % len(words)).astype(np.int32), n


def _merge(batches):
    """The counts of each shard, with its numbers of pairs seen once and twice: rows come by shard."""
    shard, waiting, many = None, [], 0

    def out():
        words, v, w, n = _merged(waiting)
        return _block(shard, _COUNTS, {"once": int((n == 1).sum()), "twice": int((n == 2).sum())}, words=words, v=v, w=w, n=n)

    for b in batches:
        for row in _rows(b):
            if row["shard"] != shard and waiting:
                yield out()
                waiting, many = [], 0
            shard = row["shard"]
            waiting.append(_arrays(row, "words", "v", "w", "n"))
            many += len(waiting[-1][1])
            if many > WAITING and len(waiting) > 1:
                waiting = [_merged(waiting)]
                many = len(waiting[0][1]) // 2
    if waiting:
        yield out()


def _parts(words: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending hashes are cut into ``parts`` of the whole range of hashes."""
    return np.searchsorted(words, np.array([(1 << 63) * p // parts for p in range(1, parts)], np.int64), "left")


def _vocabulary(parts: int):
    """A shard's words, with how often each occurs in it (c), is followed (k), and by how many words (t), cut by the vocabulary's parts."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                words, v, w, n = _arrays(row, "words", "v", "w", "n")
                sums = [x.astype(np.int64) for x in (np.bincount(w, n, len(words)), np.bincount(v, n, len(words)), np.bincount(v, minlength=len(words)))]
                edges = [0, *_parts(words, parts), len(words)]
                for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    if lo < hi:
                        yield _block(row["shard"], _TOTALS, {"part": p}, words=words[lo:hi], **{x: a[lo:hi] for x, a in zip("ckt", sums, strict=True)})

    return run


def _totals(batches):
    """For each shard the totals of its words, in their order, and the vocabulary's own words with theirs: rows come by part."""
    part, waiting = None, []

    def out():
        held = [_arrays(row, "words", "c", "k", "t") for row in waiting]
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = {x: np.bincount(at, np.concatenate([h[i] for h in held]), len(words)).astype(np.int64) for i, x in enumerate("ckt", 1)}
        yield _block(-1, _WORDS, {"part": part}, words=words, **sums)
        lo = 0
        for row, h in zip(waiting, held, strict=True):
            own = at[lo : lo + len(h[0])]
            lo += len(h[0])
            yield _block(row["shard"], _TOTALS, {"part": part}, **{x: a[own] for x, a in sums.items()})

    for b in batches:
        for row in _rows(b):
            if row["part"] != part and waiting:
                yield from out()
                waiting = []
            part = row["part"]
            waiting.append(row)
    if waiting:
        yield from out()


def _words(batches):
    for b in batches:
        for row in _rows(b):
            columns = _arrays(row, "words", "c", "k", "t")
            for lo in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in columns], names=["word", "c", "k", "t"])


def _sorted_with(pair: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (below ``top``) in order, each with its document; both go into one number where it holds them."""
    if top < 1 << 47:
        both = np.sort(pair << 16 | doc)
        return both >> 16, both & 0xFFFF
    order = np.argsort(pair, kind="stable")
    return pair[order], doc[order]


def _asked(shards: int):
    """Blocks of the distinct pairs of each batch, with the documents of each occurrence."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for ids, hashes, before, words, doc in _tokenised(batches):
            pair, doc = _sorted_with(before.astype(np.int64) * len(hashes) + words, doc, len(hashes) ** 2)
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            n, pair = np.diff(np.concatenate([starts, [len(pair)]])), pair[starts]
            for s, at, own, sv, sw in _by_shard(hashes, pair // len(hashes), pair % len(hashes), shards):
                many = n[at]
                place = np.arange(many.sum()) + np.repeat(starts[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                there = np.zeros(len(ids), bool)
                there[doc[place]] = True
                docs = np.flatnonzero(there)
                local = np.cumsum(there)[doc[place]] - 1
                yield _block(s, _TEXTS, {"batch": part << 32 | seq, "doc_ids": [ids[i] for i in docs]}, words=own, v=sv, w=sw, n=many, docs=local, doc_no=docs)
            seq += 1

    return run


#: Sums of a block's documents are one row of arrays; a word that a document asks the vocabulary for is a row (with ``word``).
_SCORED = "batch long, doc_no long, word long, as_word long, as_context long, no binary, ids array<long>, tokens binary, known binary, base binary, lp binary"
_SCORED_ARROW = pa.schema([*[(c, pa.int64()) for c in ("batch", "doc_no", "word", "as_word", "as_context")], ("no", pa.binary()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("tokens", "known", "base", "lp")]])


def _trie(totals: list[list[np.ndarray]], counts: list[np.ndarray], n: int, vocabulary: int, discount: float) -> Trie:
    words, v, w, pairs = counts
    c, k, t = (np.concatenate([x[i] for x in totals]) for i in range(3))
    own = np.log10((c + ADDED) / (n + ADDED * (vocabulary + 1)))
    share = discount * t / np.maximum(k, 1)
    with np.errstate(divide="ignore"):
        left = np.where(k > 0, quantised(np.log10(share)), Trie.NO_CONTEXT).astype(np.uint16)
    chance, follow = 10.0**own, np.empty(len(v), np.uint16)
    for lo in range(0, len(v), 1 << 18):
        at = slice(lo, lo + (1 << 18))
        follow[at] = quantised(np.log10((pairs[at] - discount) / k[v[at]] + share[v[at]] * chance[w[at]]))
    return Trie(words, c, quantised(own), left, v, w, follow)


def _scored(n: int, vocabulary: int, discount: float):
    """Sums of each document over the pairs of each shard, and the words that the shard doesn't know."""

    def judge(trie: Trie | None, row: dict):
        words, v, w, many, docs, no = _arrays(row, "words", "v", "w", "n", "docs", "doc_no")
        size = len(no)
        known = trie.words.find(words) if trie else np.full(len(words), -1, np.int64)
        cv, cw = known[v], known[w]
        follow = trie.look_up(cv, cw) if trie else np.full(len(v), -1, np.int64)
        lp, base, counts = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        if trie:
            inside = cw >= 0
            counts[inside] = trie.count[cw[inside]] > 0
            base[inside] = np.log10(trie.count[cw[inside]] + ADDED)
            seen = follow >= 0
            lp[seen] = trie.follow[follow[seen]]
            lp[inside & ~seen] += trie.own[cw[inside & ~seen]]
            context = np.flatnonzero((cv >= 0) & ~seen)
            left = trie.left[cv[context]].astype(np.int64)
            lp[context] += np.where(left == Trie.NO_CONTEXT, 0, left)
        each = lambda x: np.bincount(docs, np.repeat(x, many), size).astype("<f8").tobytes()
        sums = {"tokens": each(np.ones(len(v))), "known": each(counts), "base": each(base), "lp": each(lp)}
        yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "no": no.astype("<i8").tobytes(), "ids": row["doc_ids"]} | sums], schema=_SCORED_ARROW)
        # Words that this shard doesn't know, by document.
        place = np.repeat(np.arange(len(v)), many)
        asked = []
        for local, at in ((cw, w), (cv, v)):
            unknown = np.flatnonzero(local[place] < 0)
            asked.append(docs[unknown].astype(np.int64) * len(words) + at[place[unknown]])
        pair, at = np.unique(np.concatenate(asked), return_inverse=True)
        if len(pair):
            as_word = np.bincount(at[: len(asked[0])], minlength=len(pair))
            as_context = np.bincount(at[len(asked[0]) :], minlength=len(pair))
            doc, word = pair // len(words), pair % len(words)
            columns = [np.full(len(pair), row["batch"]), no[doc].astype(np.int64), words[word], as_word, as_context]
            nulls = [pa.nulls(len(pair), f.type) for f in list(_SCORED_ARROW)[5:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *nulls], schema=_SCORED_ARROW)

    def run(batches):
        shard, trie, totals = None, None, []
        for b in batches:
            for row in _rows(b):
                if row["shard"] != shard:
                    shard, trie, totals = row["shard"], None, []
                if row["kind"] == _TOTALS:
                    totals.append(_arrays(row, "c", "k", "t"))
                elif row["kind"] == _COUNTS:
                    trie = _trie(totals, _arrays(row, "words", "v", "w", "n"), n, vocabulary, discount)
                    totals = []
                else:
                    yield from judge(trie, row)

    return run


def _summed(batches):
    """The sums of each document over the shards: rows come by batch. Sums of codes are whole numbers of STEP."""
    batch, ids, sums = None, None, None
    names = ("tokens", "known", "base", "lp")

    def out():
        there = np.flatnonzero(sums["tokens"] > 0)
        columns = [np.full(len(there), batch), there, [ids[i] for i in there], sums["tokens"][there].astype(np.int64), sums["known"][there].astype(np.int64), sums["base"][there], sums["lp"][there] * -STEP]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch", "doc_no", "doc_id", *names])

    for b in batches:
        for row in _rows(b):
            if row["batch"] != batch:
                if ids:
                    yield out()
                batch, ids, sums = row["batch"], {}, {c: np.zeros(BATCH_TEXTS) for c in names}
            no = np.frombuffer(row["no"], "<i8")
            ids.update(zip(no.tolist(), row["ids"], strict=True))
            for c in names:
                sums[c][no] += np.frombuffer(row[c], "<f8")
    if ids:
        yield out()


def held_out() -> Column:
    """Whether the crc32 of doc_id as text is divisible by 10; a null id counts as empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Model:
    """Counts by shard, totals of words by shard and by themselves, and the numbers that all share."""

    def __init__(self, counts: DataFrame, totals: DataFrame, shards: int):
        self.counts, self.totals, self.shards = counts, totals, shards
        self.vocabulary = totals.where(F.col("kind") == _WORDS).select("words", "c", "k", "t").mapInArrow(_words, "word long, c long, k long, t long")
        self.tokens, self.words = self.vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        once, twice = counts.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
        self.discount = once / (once + 2 * twice) if once and twice else 0.5


def train(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> Model:
    """Count the pairs of all texts of ``docs`` (doc_id, text); null texts are empty and have but their end."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    blocks = docs.select("doc_id", "text").mapInArrow(_counted(shards), _BLOCK)
    counts = materialise(blocks.repartitionById(shards, F.col("shard")).mapInArrow(_merge, _BLOCK), "pair-counts")
    asked = counts.select("shard", "words", "v", "w", "n").mapInArrow(_vocabulary(shards), _BLOCK)
    totals = materialise(asked.repartitionById(shards, F.col("part")).mapInArrow(_totals, _BLOCK), "totals")
    return Model(counts, totals, shards)


def _code(log10: Column) -> Column:
    return F.rint(log10 / STEP) * STEP


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Scores are log10 probabilities: ``base_score`` by the words' own probabilities, exactly, ``score``
    by the model, each factor rounded to STEP. Null texts are empty; a text's end is a token, so
    every row has one. Rows that share an id, or have none, are rows of their own. Without training
    texts every word is the unknown one, of probability 1. Other columns are ignored.
    """
    m = model
    asked = docs.select("doc_id", "text").mapInArrow(_asked(m.shards), _BLOCK)
    rows = asked.unionByName(m.counts).unionByName(m.totals.where(F.col("kind") == _TOTALS))
    by_shard = rows.repartitionById(m.shards, F.col("shard")).sortWithinPartitions("shard", "kind", "part")
    sums = materialise(by_shard.mapInArrow(_scored(m.tokens, m.words, m.discount), _SCORED), "scored")
    share = F.when(F.col("k") > 0, _code(F.log10(F.lit(m.discount) * F.col("t") / F.col("k")))).otherwise(0.0)
    c = F.coalesce("c", F.lit(0))
    own = _code(F.log10((c + ADDED) / (m.tokens + ADDED * (m.words + 1))))
    word, context = F.col("as_word"), F.col("as_context")
    rest = sums.where("word IS NOT NULL").join(m.vocabulary, "word", "left").select(
        "batch", "doc_no", F.when(c > 0, word).otherwise(0).alias("known"), (word * F.log10(c + ADDED)).alias("base"), (word * own + context * F.coalesce(share, F.lit(0.0))).alias("lp")
    )
    rest = rest.groupBy("batch", "doc_no").agg(*[F.sum(x).alias(f"more_{x}") for x in ("known", "base", "lp")])
    blocks = sums.where("word IS NULL").select("batch", "no", "ids", "tokens", "known", "base", "lp").repartition("batch").sortWithinPartitions("batch")
    total = blocks.mapInArrow(_summed, "batch long, doc_no long, doc_id long, tokens long, known long, base double, lp double").join(rest, ["batch", "doc_no"], "left")
    total = total.select("doc_id", "tokens", *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in ("known", "base", "lp")])
    norm = F.log10(F.lit(m.tokens + ADDED * (m.words + 1)))
    return total.select("doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("tokens") * norm).alias("base_score"), F.col("lp").alias("score"))
