"""Near-duplicate documents by Order MinHash (operator 1).

Text is the sequence of its lower-cased words; a k-mer is five of them in a row, labelled
with its occurrence number. For each of SKETCH hash functions the MINIMA k-mers with the
smallest values are taken and kept in text order; that ordered tuple is one element of the
sketch, so texts agree on it only if they share the k-mers and their order. Texts that agree
on any element are candidates, and a banded alignment of their words decides: they are near
copies if the edit similarity, 1 - edits / words of the longer one, is 0.8 or more.

A pair whose shingle similarity is s agrees on an element with probability about s**2. Of pairs
with s = 0.8 or more none is missed (one in 10**14), with s = 0.5 one in 10,000, with s = 0.33
(every tenth word changed, at even distances) one in 40, with s = 0.25 (every eighth) one in 8.
Edits that lie together break fewer shingles; of edits at even distances and near the limit of
every fifth word, five-word shingles can't tell.

Exact copies are merged first. A bucket then compares its members with its most central one.
Members of small buckets that stay in different components then all meet each other. Larger
buckets are split by a second element to link most of their near copies; whatever stays apart in them meets by its rare word pairs.

What is large even then is texts with a long passage in common, most of them otherwise unlike.
Each edit takes two word pairs at most from what two texts have in common, so texts of edit
similarity 0.8 or more share a pair among the rarest two fifths of each one's word pairs. These
alone name the texts to compare, and none that is near is left out: a passage that many texts
have is not rare.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.llm.common import join_hot, materialise
from airside.llm.components import components
from airside.llm.tokens import batches_of_text

WORDS = 5
LEAST = 0.8
SKETCH = 32
MINIMA = 2
#: Buckets of at most this many members compare all members of differing components.
SMALL_BUCKET = 24
#: Further elements by which larger buckets are split, and how often.
SPLITS, DEPTH = 3, 1
#: Texts of a block, on average, in which members of larger buckets of rare grams meet.
BLOCK_TEXTS = 64
#: Words of the grams whose rarest name the texts to compare in large buckets.
RARE_WORDS = 2
#: Slots in which these grams are counted, up to MOST: 16 MB of counts are broadcast, whatever the input.
SLOTS, MOST = 1 << 24, 255
#: Slots of a block, whose counts are one row.
BLOCK = 1 << 14
#: Stands for more than one component; no doc_id that a text of a component has in practice, and if one has it, nothing is lost.
SEVERAL = -(1 << 63)

_WORD = re.compile(r"\w+")
_U = np.uint64
_rng = np.random.default_rng(20240101)
_XOR = _rng.integers(0, 2**63, SKETCH, dtype=np.int64).astype(_U)[:, None]
_MUL = (_rng.integers(0, 2**63, SKETCH, dtype=np.int64).astype(_U) * _U(2) + _U(1))[:, None]
_KMER = _rng.integers(0, 2**63, WORDS, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_known: dict[str, int] = {}  # of one task


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return v ^ (v >> _U(29))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_codes(words: list[str]) -> np.ndarray:
    """A 32-bit code for each word."""
    if len(_known) > 400_000:
        _known.clear()
    out = []
    for w in words:
        c = _known.get(w)
        if c is None:
            c = _known[w] = xxhash.xxh32_intdigest(w)
        out.append(c)
    return np.array(out, np.uint32)


def labelled_kmers(codes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers in text order; repeats of one differ by their occurrence number."""
    n = max(1, len(codes) - width + 1)
    kmer = np.zeros(n, _U)
    for j in range(min(width, len(codes))):
        kmer += codes[j : j + n].astype(_U) * _KMER[j]
    kmer = _mix(kmer)
    order = np.argsort(kmer, kind="stable")
    same = np.concatenate([[False], kmer[order][1:] == kmer[order][:-1]])
    if same.any():  # number the occurrences of equal k-mers
        run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        label = np.empty(n, np.int64)
        label[order] = run
        kmer = np.where(label > 0, _mix(kmer + label.astype(_U) * _U(0x9E3779B97F4A7C15)), kmer)
    return kmer


def order_minhash(codes: np.ndarray) -> np.ndarray:
    """The sketch: SKETCH elements, each from MINIMA labelled k-mers in text order."""
    kmer = labelled_kmers(codes)
    n = len(kmer)
    take = min(MINIMA, n)
    out = np.zeros(SKETCH, _U)
    step = SKETCH if n < 50_000 else 1  # long texts: one function at a time
    for lo in range(0, SKETCH, step):
        rows = slice(lo, lo + step)
        value = (kmer[None, :] ^ _XOR[rows]) * _MUL[rows]  # k-mers are mixed already
        every = np.arange(len(value))
        least = np.empty((len(value), take), np.int64)
        for j in range(take):
            least[:, j] = value.argmin(axis=1)
            value[every, least[:, j]] = np.iinfo(np.uint64).max
        least.sort(axis=1)
        for j in range(take):
            out[rows] = _mix(out[rows] * _U(0x9E3779B97F4A7C15) + kmer[least[:, j]])
    return out.view(np.int64)


def banded_distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is larger.

    Bit-parallel alignment of a diagonal band 2 * limit + 1 wide: bit k of a vector stands for
    row j - limit + k of column j (Hyyrö 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if not n or m - n > limit:
        return m if m <= limit else limit + 1
    band = min(limit, m)
    if not band:
        return limit + 1  # both differ and no edit is allowed
    block = max(1024, band)
    rows: dict[tuple[int, object], int] = {}
    for i, x in enumerate(a):
        key = (i // block, x)
        rows[key] = rows.get(key, 0) | 1 << i % block
    width = 2 * band + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = mask & ~((1 << band) - 1), 0
    dist, edge = band, top >> 1
    get = rows.get
    for j, x in enumerate(b):
        low = j - band  # row (from 0) of bit 0
        eq = 0
        for k in range(max(0, low) // block, (low + width) // block + 1):
            found = get((k, x))
            if found:
                shift = k * block - low
                eq |= found << shift if shift >= 0 else found >> -shift
        eq &= mask
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
        hp = (minus | ~(d0 | plus)) & mask
        hn = d0 & plus
        if j < m - band:
            dist += not d0 & top
        else:
            dist += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        if dist - max(0, n - 1 - j) * (j >= m - band) > limit + band * (j < m - band):
            return limit + 1
        down = d0 >> 1
        plus = (hn | ~(down | hp)) & mask
        minus = down & hp
    return dist if dist <= limit else limit + 1


def near(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the edit similarity of two word sequences is ``least`` or more."""
    longer = max(len(a), len(b))
    limit = int(longer * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    # As many words must be common to both, in any order.
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(na[ia], nb[ib]).sum() < longer - limit:
        return False
    return banded_distance(a.tolist(), b.tolist(), limit) <= limit


def _sketches(batches):
    for rows in batches_of_text(batches, ("doc_id", "text")):
        content, sketch, length = [], [], []
        for doc, text in rows:
            words = words_of(text) if text else []
            if doc is None or not text:
                content.append(None)
            else:
                content.append(xxhash.xxh3_128_hexdigest(" ".join(words)) if words else "=" + xxhash.xxh3_128_hexdigest(text))
            length.append(len(words))
            sketch.append(order_minhash(word_codes(words)) if words and doc is not None else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32()), pa.array(np.concatenate(sketch) if sketch else []))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(content, pa.string()), pa.array(length, pa.int32()), lists], names=["doc_id", "content", "length", "sketch"])
    _known.clear()


def _codes(batches):
    for rows in batches_of_text(batches, ("doc_id", "text")):
        codes = [word_codes(words_of(t or "")).view(np.int32) for _, t in rows]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(np.concatenate(codes)))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), lists], names=["doc_id", "words"])
    _known.clear()


def _slot_counts(batches):
    """block, slots, n, component: how many grams fall into a block's slots, summed over about a million at a time.

    ``component`` is that of all texts with a gram in the slot, or SEVERAL.
    """
    grams, owners, many = [], [], 0

    def summed():
        slot = np.concatenate(grams)
        owner = np.repeat(np.array([c for c, _ in owners], np.int64), [k for _, k in owners])
        order = np.argsort(slot, kind="stable")
        slot, owner = slot[order], owner[order]
        first = np.flatnonzero(np.diff(slot, prepend=SLOTS) != 0)
        lo, hi = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        n, slot = np.diff(first, append=len(slot)), slot[first]
        block = (slot // BLOCK).astype(np.int32)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        values = ((slot % BLOCK).astype(np.uint16), np.minimum(n, MOST).astype(np.uint8), np.where(lo == hi, lo, SEVERAL))
        columns = [pa.array([part.tobytes() for part in np.split(v, starts[1:])], pa.binary()) for v in values]
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), *columns], names=["block", "slots", "n", "component"])

    for b in batches:
        for component, words in zip(b.column("component").to_pylist(), b.column("words"), strict=True):
            found = labelled_kmers(words.values.to_numpy().view(np.uint32), RARE_WORDS) & _U(SLOTS - 1)
            grams.append(found.astype(np.int64))
            owners.append((component, len(found)))
            many += len(found)
            if many >= 1 << 20:
                yield summed()
                grams, owners, many = [], [], 0
    if grams:
        yield summed()


def _block_counts(batches):
    """block, counts: the sums of all rows of ``_slot_counts`` of a block, one byte a slot; 1 if one component alone has it."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for block, slots, n, component in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums, owner = held.setdefault(block, (np.zeros(BLOCK, np.uint16), np.zeros(BLOCK, np.int64)))
            at, of = np.frombuffer(slots, np.uint16), np.frombuffer(component, np.int64)
            owner[at] = np.where((sums[at] == 0) | (owner[at] == of), of, SEVERAL)
            sums[at] = np.minimum(sums[at] + np.frombuffer(n, np.uint8), MOST)
    if held:
        counts = pa.array([np.where(owner == SEVERAL, sums, np.minimum(sums, 1)).astype(np.uint8).tobytes() for sums, owner in held.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), counts], names=["block", "counts"])


def _rarest(held):
    """Makes the rarest grams of each text out of ``held``, a broadcast count for each slot.

    Grams of at most SMALL_BUCKET texts are a row each, with key; all others of a text are one
    row, with keys, and home, the first of the commonest of them.
    """

    def pick(batches):
        for b in batches:
            key, keys, home, owner = [], [], [], []
            docs, components = b.column("doc").to_pylist(), b.column("component").to_pylist()
            for i, words in enumerate(b.column("words")):
                found = labelled_kmers(words.values.to_numpy().view(np.uint32), RARE_WORDS)
                n = held.value[(found & _U(SLOTS - 1)).astype(np.int64)]
                rare = np.lexsort((found, n))[: int(RARE_WORDS * len(words) * (1 - LEAST) + 1e-9) + 1]
                n, found = n[rare], found[rare].view(np.int64)
                own, common = found[(n > 1) & (n <= SMALL_BUCKET)].tolist(), found[n > SMALL_BUCKET].tolist()
                most = int((n[n > SMALL_BUCKET] < n[-1]).sum())  # the first of the commonest, which texts of another length name too
                key += own + [None] * bool(common)
                keys += [None] * len(own) + [common] * bool(common)
                home += [None] * len(own) + common[most : most + 1]
                owner += [i] * (len(own) + bool(common))
            columns = [pa.array(key, pa.int64()), pa.array([docs[i] for i in owner], pa.int64()), pa.array([components[i] for i in owner], pa.int64())]
            columns += [pa.array([len(b.column("words")[i]) for i in owner], pa.int64()), pa.array(home, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "component", "length", "home", "keys"])

    return pick


def _verified(batches):
    for b in batches:
        left, right = b.column("a_words"), b.column("b_words")
        keep = [near(left[i].values.to_numpy(), right[i].values.to_numpy()) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Buckets:
    """Members (key, doc) of the buckets still to compare, and the texts' words."""

    def __init__(self, words: DataFrame):
        self.words = words
        self.fresh: list[DataFrame] = []  # edges that the labels don't know yet
        self.labels: DataFrame | None = None  # doc, component: the smallest doc it hangs together with

    def verify(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) that are near copies to the edges; repeated pairs count once."""
        narrow = pairs = materialise(pairs.distinct(), "pairs")
        total = narrow.count()
        if not total and (self.fresh or self.labels is not None):
            return
        for end, other in (("a", "b"), ("b", "a")):  # the centre of a large group is in very many pairs
            words = self.words.select(F.col("doc_id").alias(end), F.col("words").alias(f"{end}_words"), F.size(F.array_distinct("words")).alias(f"{end}_kinds"))
            pairs = join_hot(pairs, words, narrow.groupBy(end).agg(F.count("*").alias("n")), end, other, total)
        # A word that the other text lacks costs an edit, whatever its place: this rules out most pairs.
        edits = F.floor(F.greatest(F.size("a_words"), F.size("b_words")) * (1 - LEAST) + 1e-9)
        lacking = F.greatest("a_kinds", "b_kinds") - F.size(F.array_intersect("a_words", "b_words"))
        met = pairs.where(lacking <= edits).select("a", "b", "a_words", "b_words")
        self.fresh.append(materialise(met.mapInArrow(_verified, "a long, b long"), "near"))

    def relabel(self) -> None:
        """Let the labels know the fresh edges: components of the components that these connect."""
        if not self.fresh:
            return
        graph = self.fresh[0]
        for e in self.fresh[1:]:
            graph = graph.unionByName(e)
        self.fresh = []
        if self.labels is None:
            self.labels = materialise(components(graph).select(F.col("node").alias("doc"), "component"), "labels")
            return
        for end in ("a", "b"):
            known = self.labels.select(F.col("doc").alias(end), "component")
            graph = graph.join(known, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        graph = materialise(graph.where("a <> b").distinct(), "between")
        if graph.isEmpty():
            return
        merged = materialise(components(graph), "merged")
        moved = self.labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("doc", F.coalesce("now", "component").alias("component"))
        added = merged.join(self.labels.select(F.col("doc").alias("node")), "node", "left_anti").select(F.col("node").alias("doc"), "component")
        self.labels = materialise(moved.unionByName(added), "labels")

    def labelled(self, members: DataFrame) -> DataFrame:
        self.relabel()
        return members.join(self.labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _mixed(members: DataFrame) -> DataFrame:
    """key, n of the buckets whose members are of several components."""
    return members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "n")


def _in_mixed(members: DataFrame) -> DataFrame:
    """Members of the mixed buckets, with n, their bucket's number of members."""
    mixed = materialise(_mixed(members), "mixed")
    return join_hot(members, mixed, mixed, "key", "doc")


def _alike(a: str, b: str) -> Column:
    """Whether texts of so many words can be near copies."""
    return F.least(a, b) >= F.greatest(a, b) * LEAST - 1e-6


def _cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs of differing components in a bucket whose lengths allow that they are near."""
    x, y = members.alias("x"), members.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))).where(_alike("x.length", "y.length"))
    return met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, group_size: the group of (near) copies of every document.

    ``group_id`` is the smallest doc_id of the group, which is a component of the near-copy
    links; a document without copies is its own group. Texts with equal words in equal order
    are exact copies; texts without any word are copies if they are equal. Null and empty texts
    are never copies. Rows without a doc_id have no group (null, size 1). Rows that share a
    doc_id count as one document of several texts. Very long texts are compared whole. Other
    columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    sketched = materialise(rows.mapInArrow(_sketches, "doc_id long, content string, length int, sketch array<long>"), "sketches")
    # Copies have one sketch, so any of them will do; they are put together before the shuffle.
    classes = materialise(sketched.where("content IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("length").alias("length"), F.first("sketch").alias("sketch")), "classes")
    elements = classes.where("size(sketch) > 0").select(F.col("rep").alias("doc"), "length", F.posexplode("sketch").alias("pos", "element"))
    keys = materialise(elements.select("doc", "length", "pos", F.xxhash64("pos", "element").alias("key")).distinct(), "keys")

    # A bucket's first pivot is its most central member, the one whose buckets are largest: the
    # original of a group of copies is it in most buckets, so that its links are few and found.
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    held = materialise(join_hot(keys, shared, shared, "key", "doc"), "shared")
    central = held.groupBy("doc").agg(F.sum("n").alias("centre"))
    scored = held.join(central, "doc")
    pivots = scored.groupBy("key").agg(F.max_by(F.struct("doc", "length"), F.struct("centre", -F.col("doc"))).alias("p")).select("key", F.col("p.doc").alias("rep"), F.col("p.length").alias("rep_length"))
    members = materialise(join_hot(held.select("doc", "length", "pos", "key"), pivots, shared, "key", "doc"), "members")
    involved = members.select(F.col("doc").alias("doc_id")).distinct()
    words = materialise(rows.join(involved, "doc_id", "left_semi").mapInArrow(_codes, "doc_id long, words array<int>"), "words")
    buckets = Buckets(words)
    buckets.verify(members.where("doc <> rep").where(_alike("length", "rep_length")).select(F.least("rep", "doc").alias("a"), F.greatest("rep", "doc").alias("b")))

    left = materialise(buckets.labelled(members.select("key", "pos", "doc", "length")), "labelled")
    # One common element is enough for members of small buckets.
    apart = materialise(_in_mixed(left), "apart")
    pairs = _cross_pairs(apart.where(F.col("n") <= SMALL_BUCKET))
    large = apart.where(F.col("n") > SMALL_BUCKET).drop("n")
    left, any_large = large, not large.isEmpty()
    # Of near copies nearly all pairs agree on many elements: this links most, and saves work below.
    for _ in range(DEPTH if any_large else 0):
        step = F.pmod(F.col("o.pos") - F.col("l.pos"), F.lit(SKETCH))
        split = left.alias("l").join(keys.alias("o"), F.col("l.doc") == F.col("o.doc")).where(step.between(1, SPLITS))
        split = split.select(F.xxhash64("l.key", "o.key").alias("key"), F.col("o.pos").alias("pos"), F.col("l.doc").alias("doc"), F.col("l.length").alias("length"), F.col("l.component").alias("component")).distinct()
        open_ = materialise(_in_mixed(materialise(split, "split")), "open")
        pairs = pairs.unionByName(_cross_pairs(open_.where(F.col("n") <= SMALL_BUCKET)))
        left = open_.where(F.col("n") > SMALL_BUCKET).drop("n")
    buckets.verify(pairs)
    if any_large:
        rest = materialise(_in_mixed(buckets.labelled(large.select("key", "doc"))).select("doc", "component").distinct(), "rest")
        if not rest.isEmpty():
            _by_blocks(buckets, _rare_grams(buckets, rest))

    # Groups and sizes by class of copies; only then the documents, of which most are alone.
    buckets.relabel()
    labels = buckets.labels.select(F.col("doc").alias("rep"), "component")
    named = materialise(classes.select("content", "rep", "n").join(labels, "rep", "left").select("content", "n", F.coalesce("component", "rep").alias("group_id")), "named")
    sizes = named.groupBy("group_id").agg(F.sum("n").alias("group_size"), F.count("*").alias("classes"))
    several = materialise(join_hot(named, sizes.where("group_size > 1"), sizes.select("group_id", F.col("classes").alias("n")), "group_id", "content").select("content", "n", "group_id", "group_size"), "several")
    grouped = join_hot(sketched.select("doc_id", "content"), several.drop("n"), several, "content", "doc_id").select("doc_id", "group_id", "group_size")
    # A class of one that is linked to none is its only document.
    alone = named.where("n = 1").join(several.select("content"), "content", "left_anti").select(F.col("group_id").alias("doc_id"))
    alone = alone.unionByName(sketched.where("content IS NULL").select("doc_id"))
    return grouped.unionByName(alone.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size")))


def _rare_grams(buckets: Buckets, docs: DataFrame) -> DataFrame:
    """key, doc, component, length, home, keys: texts by the rarest RARE_WORDS-grams of each, see ``_rarest``.

    An edit changes RARE_WORDS grams at most. So texts of edit similarity LEAST or more, of which
    the longer one has L words, have at least L - RARE_WORDS + 1 - RARE_WORDS * (1 - LEAST) * L
    grams in common (repeats counted), and the rarest gram they share is among the
    RARE_WORDS * (1 - LEAST) * words + 1 rarest of each (the prefix filter). Any one order of all
    grams will do: theirs is by the count of their slot (up to MOST; of SLOTS whatever the input),
    then by value. Slots of one component alone count 1 and come first: their grams name no pair
    of two components, but take their place. So a large group of copies, whose texts share what
    nobody else has, names hardly any gram.
    """
    words = materialise(buckets.words.join(docs, F.col("doc_id") == F.col("doc")).select("doc", "component", "words"), "large-words")
    sums = words.select("component", "words").mapInArrow(_slot_counts, "block int, slots binary, n binary, component binary").repartition("block")
    blocks = sums.mapInArrow(_block_counts, "block int, counts binary").toArrow()  # SLOTS bytes at most
    counts = np.zeros((SLOTS // BLOCK, BLOCK), np.uint8)
    for block, n in zip(*(c.to_pylist() for c in blocks.columns), strict=True):
        counts[block] = np.frombuffer(n, np.uint8)
    held = words.sparkSession.sparkContext.broadcast(counts.ravel())
    named = materialise(words.mapInArrow(_rarest(held), "key long, doc long, component long, length long, home long, keys array<long>"), "rare")
    held.destroy()
    return named


def _by_blocks(buckets: Buckets, named: DataFrame) -> None:
    """Texts that share a gram of few texts all meet each other. Texts with common grams are
    gathered in blocks, and blocks that share such a gram meet as a whole: a pair of texts that
    shares many grams meets once, and no pair is a row."""
    buckets.verify(_cross_pairs(_in_mixed(named.where("key IS NOT NULL").drop("home", "keys")).drop("n")))
    common = named.where("key IS NULL")
    # A text is at home in its commonest gram, so that texts around one passage come to few blocks.
    homes = materialise(common.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("chunks")), "homes")
    if homes.isEmpty():
        return
    placed = materialise(common.join(homes, "home").select("doc", "component", "keys", F.xxhash64("home", F.pmod(F.xxhash64("doc"), "chunks")).alias("block")), "placed")
    texts = placed.drop("keys").join(buckets.words, F.col("doc_id") == F.col("doc")).groupBy("block")
    texts = materialise(texts.agg(F.collect_list(F.struct("doc", "component", "words")).alias("texts"), F.min("component").alias("lo"), F.max("component").alias("hi")), "blocks")
    held = placed.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")).select("block", F.explode("keys").alias("key"))
    sets = held.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    first = materialise(sets, "block-sets").select("blocks", F.posexplode("blocks").alias("at", "x"))
    pairs = materialise(first.select("x", F.explode(F.expr("slice(blocks, at + 1, size(blocks) - at)")).alias("y")).distinct(), "block-pairs")
    for end in ("x", "y"):
        pairs = pairs.join(texts.select(F.col("block").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("texts", "lo", "hi"))), end)
    pairs = pairs.where("least(x_lo, y_lo) < greatest(x_hi, y_hi)").select("x", "y", "x_texts", "y_texts").repartition("x", "y")
    buckets.fresh.append(materialise(pairs.mapInArrow(_met_blocks, "a long, b long"), "near"))


def _bags(texts) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Documents, components and words of a block."""
    words = texts.field("words")
    return texts.field("doc").to_pylist(), texts.field("component").to_pylist(), [words[i].values.to_numpy() for i in range(len(words))]


def _met_blocks(batches):
    """Links of near texts of two blocks; of texts that hang together by others in the blocks, no more are sought."""
    for b in batches:
        for i in range(b.num_rows):
            docs, components, words = _bags(b.column("x_texts")[i].values)
            split = len(docs)
            if b.column("x")[i] != b.column("y")[i]:
                docs, components, words = (p + q for p, q in zip((docs, components, words), _bags(b.column("y_texts")[i].values), strict=True))
            else:
                split = 0
            root = {c: c for c in components}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            left, right = [], []
            for n, m in _possible(words, split):
                p, q = top(components[n]), top(components[m])
                if p != q and near(words[n], words[m]):
                    root[p] = q
                    left.append(min(docs[n], docs[m]))
                    right.append(max(docs[n], docs[m]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _possible(words: list[np.ndarray], split: int) -> list[list[int]]:
    """Pairs of which neither text lacks more word pairs of the other than its edits can take, the likest first.

    With ``split``, only pairs of a text before it and one from it on.
    """
    length = np.array([len(w) for w in words])
    grams = [np.unique(labelled_kmers(w.view(np.uint32), RARE_WORDS)) for w in words]
    _, at, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # only what several have counts
    has = np.zeros((len(words), place[-1] + 1), np.float32)
    has[np.repeat(np.arange(len(words)), [len(g) for g in grams])[times[at] > 1], place[at[times[at] > 1]]] = 1
    lo, hi = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    common = has[lo] @ has[hi].T
    longer = np.maximum(length[lo, None], length[None, hi])
    edits = np.floor(longer * (1 - LEAST) + 1e-9)
    enough = common >= longer - RARE_WORDS + 1 - RARE_WORDS * edits
    enough &= longer - np.minimum(length[lo, None], length[None, hi]) <= edits
    n, m = np.nonzero(enough if split else np.triu(enough, 1))
    order = np.argsort(-common[n, m] / longer[n, m], kind="stable")
    return np.stack([n[order], m[order] + split], axis=1).tolist()
