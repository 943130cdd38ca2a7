"""Spelling variants by an index of variable-length grams (operator 13).

Words stand between ``^`` and ``$``. Grams of QMIN characters that are frequent are made longer,
up to QMAX: the dictionary has all grams whose every proper prefix occurs more than LIST times,
so that common beginnings get longer grams and shorter lists. A word is decomposed into the gram
of each position: the shortest one that isn't frequent. Which it is depends on the gram's own
characters alone, so an edit affects only grams that cover the edited place; the largest number of
grams that one place is covered by bounds, for each word, how many an edit can take away.

Of two words one edit apart each therefore keeps all but so many of its grams (repeats counted by
occurrence number) in common with the other. Under one order of all grams, they share one among
the first bound + 1 of each: only these lists are merged. QMAX places cover a character at most
and a word of LEAST_CHARS characters has at least one gram more, so no pair is without a list.
Words that meet in a list are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.llm.common import join_hot, materialise
from airside.llm.tokens import batches_of_text

QMIN, QMAX = 2, 6
#: Grams with more occurrences in words than this are made longer.
LIST = 32
LEAST_CHARS, LEAST_COUNT = 6, 5
#: Lists with more words are split by what is left of a word without one of its characters.
LONG_LIST = 1000
#: A form is at least so many times as frequent.
TIMES = 5
#: One in so many (document, run) pairs loses a character (the query's planted misspellings).
LOSSES = 199

#: Shorter runs make no word, whatever they lose.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower(run: str) -> str:
    """A-Z alone are lower-cased."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def misspelt(doc: int | None, run: str) -> str:
    """The run, without one character if the crc32 of ``<doc>:<run>`` is a multiple of LOSSES (a null id is empty)."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % LOSSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(spoil: bool):
    def run(batches):
        for rows in batches_of_text(batches, ("doc_id", "text")):
            total: Counter[str] = Counter()
            for doc, text in rows:
                if text:
                    found: Counter[str] = Counter()
                    for raw, n in Counter(RUN.findall(text)).items():
                        found[lower(raw)] += n
                    for word, n in found.items():
                        word = misspelt(doc, word) if spoil else word
                        if len(word) >= LEAST_CHARS:
                            total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, spoil: bool = False, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of at least LEAST_CHARS characters and ``least`` occurrences.

    ``spoil`` first takes a character from some (see ``misspelt``). Null texts have no words;
    whole texts are read. Counts are combined in each task before the shuffle.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_count(spoil), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def affected(sizes: list[int]) -> int:
    """The largest number of grams that cover one of the word's own characters; sizes[p] is the length of the gram at p."""
    cover = [0] * (len(sizes) + QMAX + 2)
    for p, q in enumerate(sizes):
        cover[p] += 1
        cover[p + q] -= 1
    most = here = 0
    for i in range(len(sizes) + 1):  # places 1 to len(sizes) - 1 are the word's; the ends are never edited
        here += cover[i]
        if 0 < i < len(sizes):
            most = max(most, here)
    return most


def _lists(batches):
    """key (of a list), word, n, chars: the lists in which a word has to be looked for."""
    for b in batches:
        key, word, count, chars = [], [], [], []
        for w, n, known in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), b.column("frequent").to_pylist(), strict=True):
            padded = f"^{w}$"
            longer = Counter(known or ())
            # Prefixes of a frequent gram are frequent: their number at a place tells the length.
            sizes = [min(QMIN + longer[p], QMAX, len(padded) - p) for p in range(len(padded) - QMIN + 1)]
            seen: Counter[str] = Counter()
            grams = []
            for p, q in enumerate(sizes):
                g = padded[p : p + q]
                seen[g] += 1
                common = q == QMAX or longer[p] > q - QMIN  # the last is frequent, too: it could not be made longer
                grams.append((common, xxhash.xxh64_intdigest(f"{g}{seen[g]}") - (1 << 63)))
            grams.sort()
            for _, h in grams[: affected(sizes) + 1]:
                key.append(h)
                word.append(w)
                count.append(n)
                chars.append(len(w))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(chars, pa.int32())], names=["gram", "word", "n", "chars"])


def gram_lists(words: DataFrame) -> DataFrame:
    """gram, word, n, chars: each word (word, n) in the lists that its bound asks for."""
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    size = F.length("word") + 2
    # All grams that may have to be made longer; a word has at most QMAX - QMIN of them at each place.
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(QMIN), F.lit(QMAX - 1)), lambda q: F.transform(F.sequence(F.lit(0), size - q), lambda p: F.struct(p.alias("p"), F.substring(padded, p + 1, q).alias("gram"))))))
    occurring = materialise(words.select("word", places.alias("o")).select("word", "o.p", F.xxhash64("o.gram").alias("gram")), "grams")
    counts = materialise(occurring.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > LIST), "frequent")
    longer = join_hot(occurring, counts.select("gram"), counts, "gram", "word").groupBy("word").agg(F.collect_list("p").alias("frequent"))
    return words.join(longer, "word", "left").select("word", "n", "frequent").mapInArrow(_lists, "gram long, word string, n long, chars int")


def _without_one(word: Column) -> Column:
    """The word without each of its characters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: words one edit apart, each pair in both directions.

    A list is kept by length, so that a word meets those of its own length and of one more. Lists of
    more than LONG_LIST words are split by what is left of the words without one character, which
    words one edit apart have in common: no list makes all pairs of its words.
    """
    lists = materialise(gram_lists(words), "lists")
    narrow = lists.select("word", "n", F.xxhash64("gram", "chars").alias("key"), F.xxhash64("gram", F.col("chars") - 1).alias("shorter"))
    sizes = narrow.groupBy("key").agg(F.count("*").alias("many"))
    long = materialise(sizes.where(F.col("many") > LONG_LIST).select("key"), "long-lists")
    alike = narrow.select("key", "word", "n")
    more = narrow.select(F.col("shorter").alias("key"), "word", "n")
    if long.isEmpty():
        pairs = [(alike, alike), (alike, more)]
    else:
        # What only other lists hold is not split: the lists of both sides carry the shorter word's length.
        flagged = long.withColumn("long", F.lit(True))
        split = lambda side, parts: side.join(flagged, "key", "left").withColumn("part", F.explode(F.when(F.col("long"), parts).otherwise(F.array(F.lit(""))))).select(F.xxhash64("key", "part").alias("key"), "word", "n")
        cut = _without_one(F.col("word"))
        pairs = [(split(alike, cut), split(alike, cut)), (split(alike, F.array("word")), split(more, cut))]
    found = None
    for same, (left, right) in zip((True, False), pairs, strict=True):
        l, r = left.alias("l"), right.alias("r")
        met = l.join(r, (F.col("l.key") == F.col("r.key")) & ((F.col("l.word") < F.col("r.word")) if same else F.lit(True)))
        size = F.length("l.word") - F.length("r.word")
        met = met.where((size == (0 if same else -1)) & (F.levenshtein("l.word", "r.word", 1) == 1))
        met = met.select(F.col("l.word").alias("word"), F.col("l.n").alias("n"), F.col("r.word").alias("other"), F.col("r.n").alias("other_n"))
        found = met if found is None else found.unionByName(met)
    one = materialise(found.distinct(), "near-words")
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Every word (word, n; see ``word_counts``) with its form and root.

    n_near counts the words one inserted, deleted or replaced character apart; ``form`` is the most
    frequent of them (ties: the first in code-point order) if it is ``times`` as frequent, with its
    count ``form_n``, else null; ``root`` is the end of the chain of forms, the word itself without
    one. Counts grow along a chain, so it ends. No words give no rows.
    """
    words = materialise(words, "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other"))).alias("b"))
    chosen = F.when(F.col("b.other_n") >= times * F.col("n"), F.col("b"))
    named = materialise(words.join(best, "word", "left").withColumn("f", chosen).select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("f.other").alias("form"), F.col("f.other_n").alias("form_n")), "forms")
    ways = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round follows twice as many forms
        ways = materialise(ways, "ways")
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        counts = ways.groupBy("root").agg(F.count("*").alias("n"))
        moved = join_hot(ways, ahead, counts, "root", "word").select("word", F.col("next").alias("root"))
        moved = materialise(moved, "moved")
        if moved.isEmpty():
            break
        ways = ways.join(moved.select("word"), "word", "left_anti").unionByName(moved)
    return named.join(ways, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
