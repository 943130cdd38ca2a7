"""Conversation trie, n-gram trie and spelling variants against brute force; their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airside.llm import lm, prefix_trie, queries, variants
from airside.llm.common import table
from airside.llm.elias_fano import STEP, EliasFano

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn int, role string, text string, name string, seq string"


def plain_trie(rows):
    """The trie by dictionaries: (depth, path) -> members."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    told = {c: [x[3:] for x in sorted(t)] for c, t in told.items()}
    rebuilt = {}
    for c, t in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = told.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    nodes = defaultdict(list)
    for c, t in sorted(rebuilt.items()):
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words
    ends = lambda p: ",".join(str(c) for c in nodes[p] if len(rebuilt[c]) == len(p))
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in nodes.items())


def trie_of(spark, rows):
    turns = prefix_trie.share_openings(prefix_trie.turns_of(spark.createDataFrame([(*r, "x", "y") for r in rows], TALK)))
    got = prefix_trie.prefix_trie(turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in got.collect())


def test_trie_is_the_plain_one(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a b", "a  b", "", None, "c\td e", "é"])) for c in range(400) for t in range(r.choice([0, 1, 2, 3, 5, 9, 13]))]
    r.shuffle(rows)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated rows, negative ids, a long conversation, many equal ones."""
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "user", "hi"), (7, 1, "user", "hi"), (-5, 0, "a", "b c"), (0, 0, "a", "b c"), (0, 1, "", "long " * 3000)]
    rows += [(9, t, "user", f"turn {t % 7}") for t in range(70)] + [(c, 0, "user", "the same opening") for c in range(100, 900)]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, []) == [] == trie_of(spark, [(None, 1, "user", "x")])


def test_long_lists_are_hashed_as_streams(spark):
    ids = [*range(-10, 3 * prefix_trie.SPAN, 2), 10**12]
    rows = spark.createDataFrame([(bytearray(b"a"), i) for i in ids] + [(bytearray(b"b"), 1)], "name binary, conv_id long")
    got = {bytes(r["name"]): r["ends_sha256"] for r in prefix_trie.list_hashes(rows.repartition(7)).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"1").hexdigest()}


# --- spelling ------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {w: min(near[w], key=lambda o: (-counts[o], o)) if near[w] else None for w in counts}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w in counts)


def some_words(seed, many):
    """Random words of few letters and words one edit from others, with very differing counts."""
    r = random.Random(seed)
    counts = {}
    while len(counts) < many:
        w = "".join(r.choice("abné") for _ in range(r.randint(6, 11))) if r.random() < 0.4 or not counts else r.choice([*counts])
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abné") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abné") + w[i + 1 :]])
        if len(w) >= 6:
            counts[w] = 5 ** r.randint(1, 5) + r.randint(0, 3)
    return counts


@pytest.mark.parametrize("long_list", [1000, 5])
def test_spelling_groups_are_the_plain_ones(spark, monkeypatch, long_list):
    """Crowded words, so that common grams grow and lists are long; with long lists split, too."""
    monkeypatch.setattr(variants, "LONG_LIST", long_list)
    counts = some_words(3, 700)
    got = variants.spelling_groups(spark.createDataFrame([*counts.items()], "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_groups(counts)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=6, max_size=9), st.sets(st.text("^abé$", min_size=2, max_size=5), max_size=40), st.integers(0, 20), st.integers(0, 2), st.sampled_from("abé"))
def test_words_one_edit_apart_share_a_list(word, frequent, at, kind, c):
    """Whatever grams are frequent, the lists of two words one edit apart meet."""
    import pyarrow as pa

    frequent = {g for g in frequent if all(g[:q] in frequent for q in range(variants.QMIN, len(g)))}  # prefixes of frequent grams are frequent
    i = at % len(word)
    other = [word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]][kind]
    if other == word or len(other) < 6:
        return

    def lists(w):
        p = f"^{w}$"
        places = [k for k in range(len(p)) for q in range(variants.QMIN, variants.QMAX) if k + q <= len(p) and p[k : k + q] in frequent]
        rows = pa.RecordBatch.from_pylist([{"word": w, "n": 5, "frequent": places}], schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("frequent", pa.list_(pa.int32()))]))
        return set(next(variants._lists([rows])).column("gram").to_pylist())

    assert lists(word) & lists(other)


def test_word_counts(spark):
    docs = [(1, "Naïve naïve NAÏVE-Bayes BAYESIAN", "x"), (1, "bayesian", "x"), (None, "bayesian Übermut", "y"), (2, None, None), (3, "", None), (4, "b" * 30_000, "z"), (5, "short", "z")]
    got = {r["word"]: r["n"] for r in variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string, word string"), least=1).collect()}
    assert got == {"bayesian": 3, "Übermut": 1, "b" * 30_000: 1}
    spoilt = next(d for d in range(1000) if zlib.crc32(f"{d}:bayesian".encode()) % 199 == 0)
    h = zlib.crc32(f"{spoilt}:bayesian".encode()) % 8
    assert variants.misspelt(spoilt, "bayesian") == "bayesian"[:h] + "bayesian"[h + 1 :]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_groups(variants.word_counts(empty)).count() == 0


def test_a_very_long_word_has_variants(spark):
    words = spark.createDataFrame([("a" * 400, 500), ("a" * 401, 7), ("a" * 399 + "b", 8)], "word string, n long")
    got = {len(r["word"]) + (r["word"][-1] == "b"): (r["n_near"], r["form"] and len(r["form"])) for r in variants.spelling_groups(words).collect()}
    assert got == {400: (2, None), 401: (1, 400)} or got == {400: (2, None), 401: (2, 400)}


# --- language model ------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 300), max_size=200), st.lists(st.integers(0, 400), max_size=20))
def test_elias_fano(numbers, others):
    x = np.array(sorted(numbers), np.uint64)
    e = EliasFano.of(x)
    assert np.array_equal(e[np.arange(len(x))], x) or not len(x)
    asked = np.array(numbers + others, np.uint64)
    found = e.find(asked)
    first = np.searchsorted(x, asked)
    inside = first < len(x)
    want = np.full(len(asked), -1)
    want[inside] = np.where(x[first[inside]] == asked[inside], first[inside], -1)
    assert np.array_equal(found, want)
    if len(x) > 2:  # within a range
        lo, hi = len(x) // 3, len(x) - 1
        among = e.find(asked, np.full(len(asked), lo), np.full(len(asked), hi))
        assert all((a >= 0) == (v in x[lo:hi]) and (a < 0 or lo <= a < hi and x[a] == v) for a, v in zip(among, asked, strict=True))


def plain_scores(docs, trained):
    upper = {c: c + 32 for c in range(65, 91)}
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
    c, k, t, pair = Counter(), Counter(), Counter(), Counter()
    for text in trained:
        words = [*tokens(text), "</s> "]
        c.update(words)
        pair.update(zip(["<s> ", *words], words, strict=False))
    for (v, _), n in pair.items():
        k[v] += n
        t[v] += 1
    n, size = sum(c.values()), len(c)
    once, twice = (sum(x == m for x in pair.values()) for m in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    own = lambda w: (c[w] + 0.1) / (n + 0.1 * (size + 1))

    def after(v, w):
        return max(pair[v, w] - d, 0) / k[v] + d * t[v] / k[v] * own(w) if k[v] else own(w)

    out = []
    for doc, text in docs:
        words = [*tokens(text), "</s> "]
        out.append((doc, len(words), sum(c[w] > 0 for w in words), n, sum(math.log10(own(w)) for w in words), sum(math.log10(after(v, w)) for v, w in zip(["<s> ", *words], words, strict=False))))
    return out, after, [*c, "unseen"], [*k, "unseen"]


def assert_scores(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    want = sorted(want, key=repr)
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-6) and abs(g[5] - w[5]) <= g[1] * 1.01 * STEP


ODD = [(1, "A b a b a c"), (1, "A b a b a c"), (2, None), (3, ""), (None, "b a x y É é"), (4, "new words only"), (5, "a " * 4000), (None, "a b"), (6, "\x00 \x0b\x0c z\x1c\x85\xa0\u2003y İÀ")]


@pytest.mark.parametrize("shard_chars", [10**9, 3000])
def test_scores_are_the_plain_ones(spark, shard_chars):
    """Null, empty and long texts, repeated and missing ids, unknown words; one shard and several."""
    trained = [(i, t) for i, t in ODD if i != 4] + [(9, "the cat sat on the mat"), (10, "the cat ran")]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in [*ODD, *trained[-2:]]], "doc_id long, text string, word string, n int").repartition(3)
    model = lm.train(spark.createDataFrame(trained, "doc_id long, text string"), shard_chars)
    want, after, words, contexts = plain_scores([*ODD, *trained[-2:]], [t for _, t in trained])
    assert all(sum(after(v, w) for w in words) == pytest.approx(1) for v in contexts)
    assert_scores(lm.score(docs, model).collect(), want)


def test_scores_on_documents(spark):
    """The whole query on the given table, held-out texts included; the model beats the words' own frequencies there."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    got = queries.QUERIES["op12_lm"](spark, SF).collect()
    assert all(r["held_out"] == out(r["doc_id"]) for r in got)
    want, *_ = plain_scores(docs, [t for d, t in docs if not out(d)])
    assert_scores([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], want)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_without_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(docs)
    assert lm.score(docs, model).count() == 0
    alone = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert [tuple(r) for r in alone] == [(1, 3, 0, 0, 0.0, 0.0)]
