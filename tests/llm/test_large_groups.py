"""Near duplicates in large groups."""

from __future__ import annotations

import random

from airside.llm import neardup


def family(rng: random.Random) -> list[str]:
    """Near copies of one text, one of them copied on its own, texts around it with too many edits, other texts."""
    base = [f"b{i}" for i in range(150)]

    def edited(words, share, tag):
        return [f"{tag}{i}" if rng.random() < share else w for i, w in enumerate(words)]

    texts = [edited(base, 0.02, f"n{n}x") for n in range(90)]
    far = [base[:90] + [f"f{n}x{i}" for i in range(60)] for n in range(40)]
    texts += far + [edited(t, 0.02, f"g{n}x") for n, t in enumerate(far[:10])]
    texts += [[f"o{n}x{i}" for i in range(100)] for n in range(20)]
    return [" ".join(t) for t in texts]


def test_large_group_makes_few_rows(spark, monkeypatch):
    """The groups of brute force, without a row for every gram of each text or every pair."""
    made = {}
    write = neardup.materialise

    def counted(df, tag):
        out = write(df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    texts = family(random.Random(4))
    found = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    codes = [neardup.word_codes(neardup.words_of(t)) for t in texts]
    want = list(range(len(texts)))

    def top(n):
        while want[n] != n:
            n = want[n]
        return n

    for n in range(len(texts)):
        for m in range(n):
            a, b = top(n), top(m)
            if a != b and neardup.near(codes[n], codes[m]):
                want[max(a, b)] = min(a, b)
    assert found == {n: top(n) for n in range(len(texts))}
    assert "rare" in made and made["rare"][0] <= 10 * len(texts)


def test_pairs_of_blocks_lose_none():
    rng = random.Random(5)
    words = [neardup.word_codes(t.split()).view("int32") for t in family(rng)]
    near = {(n, m) for m in range(len(words)) for n in range(m) if neardup.near(words[n], words[m])}
    assert near and near <= {tuple(p) for p in neardup._possible(words, 0)}
    assert {p for p in near if p[0] < 100 <= p[1]} <= {tuple(p) for p in neardup._possible(words, 100)}
