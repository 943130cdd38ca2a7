"""Corpus operators against brute force, round trips and held-out accuracy; edge cases of all."""

import hashlib
import random
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airside.llm import ann, common, fingerprint, langid, licences, mixing, neardup, packing, queries, tokens, url_filter, warc
from airside.llm.common import fresh_path, table

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 0, "x", "y") for i, t, la, so in rows], DOCS)


ODD = [(3, None, None, None), (1, "", "en", ""), (2, "été  naïve\n\tfoo", "fr", "a"), (2, "été  naïve\n\tfoo", "fr", "a"), (7, "!!! 42", "en", "b"), (None, "no id here", "en", "b"), (9, "word " * 5000, "en", "c")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sTé .,\n\t12ß漢 ́-_|<>")), max_size=40))
def test_encoder_is_the_library(text):
    for path in (WORD, BYTE):
        e = tokens.encoder(path)
        assert e.encode(text) == e._library(text)


def test_token_files(spark):
    df = docs(spark, ODD)
    path = fresh_path(spark, "t")
    tokens.write_token_files(df, path, WORD, [1])
    got = tokens.token_digests(tokens.read_token_files(spark, path)).orderBy("start").collect()
    assert len(got) == len(ODD)
    at = 0
    by_id = {}
    for i, t, *_ in ODD:
        by_id[i] = array("I", [*tokens.encoder(WORD).tokenizer.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(by_id[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(by_id[r["doc_id"]])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 7, 9]
    assert tokens.read_token_files(spark, path, [7]).count() == 1


def test_token_file_footers(spark):
    """Run-length integers, row indexes and a Bloom filter on doc_id stand in every stripe; ids are pruned by it."""
    many = docs(spark, [(i, f"text number {i} of a few words", "en", "s") for i in range(6000)])
    path = fresh_path(spark, "t")
    tokens.write_token_files(many, path, WORD, [1], stride=1000)
    jvm, seen = spark._jvm, 0
    conf = spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    for f in folder.getFileSystem(conf).listStatus(folder):
        if not f.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(f.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        if not reader.getNumberOfRows():
            continue
        assert reader.getRowIndexStride() == 1000
        names = list(reader.getSchema().getFieldNames())
        doc = names.index("doc_id") + 1
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert (doc, "BLOOM_FILTER_UTF8") in kinds and (doc, "ROW_INDEX") in kinds
            assert footer.getColumns(doc).getKind().toString() == "DIRECT_V2"
            seen += 1
        rows.close()
    assert seen > 0
    got = tokens.read_token_files(spark, path, [17, 5999, 123456])
    assert sorted(r["doc_id"] for r in got.collect()) == [17, 5999]
    assert "PushedFilters: [In(doc_id, [17,5999,123456])]" in got._jdf.queryExecution().toString() or "In(doc_id" in got._jdf.queryExecution().toString()
    empty = fresh_path(spark, "t")
    tokens.write_token_files(docs(spark, []), empty, WORD, [1])
    assert tokens.token_digests(tokens.read_token_files(spark, empty)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x?q", "https://sub.com/fr/#a", "ftp://com/de/", "no scheme", None, "http://example.org/en/12", "http://notorg/", "http://x.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("sub.com", "/fr/", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notorg", "/", None, "allow"), ("x.org", "", None, "allow")]
    for limit in (1 << 20, 0):
        got = url_filter.filter_urls(pages, rules, max_local_bytes=limit).orderBy("page_id").collect()
        assert [tuple(r)[1:] for r in got] == want


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(30):
        cap = rng.choice([7, 50, 300])
        hist = {}
        for _ in range(rng.randrange(1, 400)):
            n = rng.randrange(1, cap + 1)
            hist[n] = hist.get(n, 0) + 1
        plan = packing.plan_patterns(hist, cap)
        used = {}
        for lengths, times in plan:
            assert sum(lengths) <= cap
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == hist
        bins, least = sum(t for _, t in plan), -(-sum(k * v for k, v in hist.items()) // cap)
        assert bins <= 1.25 * least + 2


def _fewest(lengths, cap, bins=()):
    """The fewest bins, by trying every place of each piece, the longest first."""
    if not lengths:
        return len(bins)
    first, rest = lengths[0], lengths[1:]
    tries = [_fewest(rest, cap, (*bins, first))]
    tries += [_fewest(rest, cap, bins[:i] + (b + first,) + bins[i + 1 :]) for i, b in enumerate(bins) if b + first <= cap and b not in bins[:i]]
    return min(tries)


def test_packing_plan_against_the_optimum():
    rng, over = random.Random(4), 0
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 13) for _ in range(rng.randrange(1, 8))), reverse=True)
        best = _fewest(tuple(lengths), 12)
        bins = sum(t for _, t in packing.plan_patterns({x: lengths.count(x) for x in lengths}, 12))
        assert best <= bins <= best + 1
        over += bins - best
    assert over <= 3


def test_packing_plan_on_given_lengths(spark):
    got = packing.cut_pieces(table(spark, "/root/testdata/sf0.01", "documents"), BYTE, [0], 2048, keep_ids=False).groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in got}
    bins, least = sum(t for _, t in packing.plan_patterns(histogram, 2048)), -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert bins <= 1.01 * least + 1


def test_pack(spark):
    types = dict(packing.pack(docs(spark, ODD), BYTE, [0], 64, keep_ids=False).dtypes)
    assert types == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got = packing.pack(docs(spark, ODD), BYTE, [0], 64).collect()
    seqs = {}
    for r in got:
        assert zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    total = sum(len(tokens.encoder(BYTE).encode(t or "")) // 4 + 1 for _, t, *_ in ODD)
    assert sum(r["length"] for r in got) == total
    assert packing.pack(docs(spark, []), BYTE, [0], 64).count() == 0


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(3000):
        k = rng.choice([2, 5])
        a = [rng.randrange(k) for _ in range(rng.randrange(14))]
        b = [rng.randrange(k) for _ in range(rng.randrange(14))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        limit = rng.randrange(9)
        assert neardup.banded_distance(a, b, limit) == min(row[-1], limit + 1)


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    base = [rng.choices(vocab, k=200) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((i * 10, " ".join(b)))
        for j in range(1, 4):
            c = list(b)
            c[rng.randrange(200)] = "changed"
            del c[rng.randrange(199)]
            rows.append((i * 10 + j, " ".join(c)))
        rows.append((i * 10 + 5, " ".join(b).upper() + "!"))
    rows += [(1000, None), (1001, None), (1002, ""), (None, "w1 w2"), (1003, "?!"), (1004, "?!")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, group_id int")
    got = {r["doc_id"]: r for r in neardup.groups(df).collect()}
    for i, _ in rows:
        want = None if i is None else i // 10 * 10 if i < 1000 else 1003 if i == 1004 else i
        assert got[i]["group_id"] == want
    assert neardup.groups(df.limit(0)).count() == 0


def test_licences(spark):
    text = "Some words of prose here.\nLicensed under the Apache License, Version 2.0.\nmore prose about nothing"
    rows = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, text), (-2, None), (-3, "")], "doc_id long, text string"))
    got = licences.scan(rows).collect()
    assert [(r["paragraph"], r["family"]) for r in got if r["doc_id"] == -1] == [(1, "apache-2.0")]
    notices = dict.fromkeys(r["doc_id"] for r in rows.where("text RLIKE 'MIT License|GNU General|CC BY-NC|Apache License'").collect())
    assert {r["doc_id"] for r in got if r["confirmed"]} == set(notices)


WRAPPED = """Prose comes first.

# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# any later version

 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met

// Permission is hereby granted, free of charge, to any person obtaining a
// copy of this software and associated documentation files

Licensed under the Apache License,\r\nVersion 2.0 (the License); you may not use this file
except in compliance with the License.
The end."""


def test_licences_in_wrapped_lines_and_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(1, WRAPPED), (2, line), (2, line), (None, line), (3, "The river runs to the sea and back again."), (3, line), (4, "x. " * 200_000 + "\n" + line), (5, None), (6, "")]
    rows += [(100 + i, f"Talk number {i} of the weather and the sea.") for i in range(300)] + [(1000, "The same words each day.")] * 400
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, family string")
    got = licences.scan(df).collect()
    assert [r["family"] for r in sorted((r for r in got if r["doc_id"] == 1 and r["confirmed"]), key=lambda r: r["paragraph"])] == ["gpl-3.0", "bsd", "mit", "apache-2.0"]
    alike = [r for r in got if r["doc_id"] != 1]
    assert sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in alike), key=repr) == sorted([(2, 0, "mit"), (2, 0, "mit"), (None, 0, "mit"), (3, 0, "mit"), (4, 1, "mit")], key=repr)
    assert len({r["probability"] for r in alike}) == 1 and alike[0]["probability"] > 0.5
    assert licences.scan(df.limit(0)).count() == 0
    drawn = licences.training_rows(spark, licences.paragraphs(df), 100).where("family = 'none'").count()
    assert 50 < drawn <= 101


def test_licence_scores_against_brute_force(spark):
    """Each paragraph's probability, worked out in numpy from the fitted coefficients."""
    rows = table(spark, SF, "documents").select("doc_id", "text")
    lines = licences.paragraphs(rows)
    model = licences.train(spark, lines)
    weights, bias, number = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray(), {t: i for i, t in enumerate(model.vectors.vocabulary)}
    none, want = model.families.index("none"), {}
    for r in lines.select("doc_id", "paragraph", licences.all_terms(licences.words(F.col("text"))).alias("t")).collect():
        known = sorted({number[t] for t in r["t"] if t in number})
        z = (weights[:, known].sum(1) + bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if known and p[none] < 0.5:
            want[(r["doc_id"], r["paragraph"])] = round(float(np.delete(p, none).max()), 4)
        assert known or p[none] > 0.5
    ready = licences.once(lines, "w", licences.words(F.col("text"))).drop("text")
    got = {(r["doc_id"], r["paragraph"]): r["p"] for r in model.probabilities(ready).where("none < 0.5").select("doc_id", "paragraph", F.round("probability", 4).alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in got)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[100:200] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, shard_rows=1000).collect()
    scores = x[::20] @ x.T
    hits = 0
    found = {}
    for r in got:
        assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for n, q in enumerate(range(0, 3000, 20)):
        s = scores[n].copy()
        s[q] = -np.inf
        s[100:200] = np.where(np.isinf(s[100:200]), s[100:200], x[q] @ x[100])
        want = sorted(range(3000), key=lambda i: (-s[i], i))[:20]
        assert len(found[q]) == 20
        hits += len(set(want) & {v for _, v in found[q]})
    assert hits / (150 * 20) >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_warc_round_trip(spark):
    tricky = "before " + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + warc.MAGIC + " end" + "x" * 200
    html = ["a" * 200, "a" * 200, "short", "short", None, "", "é" * 99 + "\r\n\r\n", tricky, tricky, warc.MAGIC, "z" * 100]
    pages = spark.createDataFrame([(i, f"http://h/{i} \r\n", h) for i, h in enumerate(html)], "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = html.index(h)
        twin = len(raw) >= 100 and first < i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest()), i
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if twin else ("response", None))


@pytest.mark.parametrize("parts", [1, 7])
def test_warc_over_blocks(spark, parts):
    """Records over several blocks, and another cut of the files between planning and reading."""
    inner = warc.MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [f"{i} " + inner * 40 + "x" * 3000 + str(i) for i in range(8)] + ["y" * 5000, None, ""] + [warc.MAGIC * i for i in range(1, 9)]
    url = ["http://h/a b\r\n", None, "", "http://h/%20é", *[f"http://h/{i}" for i in range(4, len(html))]]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(url, html, strict=True))] + [(None, "u", "no id"), (4, "again", "z" * 200)], "page_id long, url string, html string").repartition(2)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        for n, v in zip(names, ("2000", "1", "3"), strict=True):
            spark.conf.set(n, v)
        path = fresh_path(spark, "warc")
        warc.write_archives(pages, path)
        found = warc.read_records(spark, path)
        spark.conf.set(names[0], "700")
        spark.conf.set(names[2], str(parts))
        got = found.collect()
    finally:
        for n in names:
            spark.conf.unset(n)
    want = sorted(((i, u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in pages.collect()), key=repr)
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in got), key=repr) == want


def test_warc_headers_and_many_groups(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same " * 40 if i % 3 else f"page {i // 6} " * 20) for i in range(30)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path, "2024-05-06T07:08:09Z")
    assert "\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in spark.read.text(path, wholetext=True).first()[0]
    few = {(r["page_id"], r["refers_to"]) for r in warc.revisits(pages).collect()}
    monkeypatch.setattr(warc, "GROUPS_TO_ALL", 0)
    monkeypatch.setattr(warc, "HOT_GROUPS", 2)
    assert {(r["page_id"], r["refers_to"]) for r in warc.revisits(pages).collect()} == few and len(few) == 30
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_language(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op8_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in got) / len(got) > 0.97
    model = langid.train(d)
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, ODD), model).collect()}
    assert [odd[i]["lang_pred"] for i in (3, 1, 7)] == ["und"] * 3 and odd[3]["score"] == 0
    assert langid.identify(docs(spark, ODD), langid.train(docs(spark, []))).where("lang_pred = 'und'").count() == len(ODD)


def _plain_code_length(texts, text, order):
    """Prediction by partial matching as the definition goes: dictionaries, byte by byte."""
    counts = {}
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                c = counts.setdefault(t[i - k : i], {})
                c[t[i]] = c.get(t[i], 0) + 1

    def p(context, symbol):
        shorter = (lambda s: p(context[1:], s)) if context else (lambda s: 1 / 256)
        seen = counts.get(context)
        if not seen:
            return shorter(symbol)
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return seen[symbol] / total
        return len(seen) / total * shorter(symbol) / (1 - sum(shorter(s) for s in seen))

    t = b"\n" * order + text
    return sum(-np.log2(p(t[i - order : i], t[i])) for i in range(order, len(t))), p


def test_code_lengths_are_exact():
    learned = [b"the cat sat on the mat", "größe über".encode(), b"the the theory", bytes(range(250, 256)) * 2]
    gram, n = np.unique(np.concatenate([langid._grams(langid._START + t) for t in learned]), return_counts=True)
    model = langid.Model(["x"], [langid.Tree.grow(gram.astype(np.int64), n)])
    texts = [b"the mat", b"", "übermäßig".encode(), b"zzz", b"the cat " * 40, bytes([255, 0, 250, 251, 252])]
    got = model.code_lengths(texts)[:, 0]
    for bits, t in zip(got, texts, strict=True):
        want, p = _plain_code_length(learned, t, langid.ORDER)
        assert abs(bits - want) < 1e-6
    for context in (b"the", b"\n\n\n", b"qqq", b"at "):
        assert abs(sum(p(context, s) for s in range(256)) - 1) < 1e-9


def test_code_lengths_of_long_texts(monkeypatch):
    t = b"some words in a row, and again some words. " * 50
    gram, n = np.unique(langid._grams(langid._START + t[:400]), return_counts=True)
    model = langid.Model(["x"], [langid.Tree.grow(gram.astype(np.int64), n)])
    whole = model.code_lengths([t, b"ab", t[:777]])
    monkeypatch.setattr(langid, "_BLOCK_BYTES", 100)
    assert np.allclose(model.code_lengths([t, b"ab", t[:777]]), whole)


def test_language_samples(spark):
    """Copies of one text don't swell the sample; each language has one."""
    rows = [(i, "the same line over and over", "en", "s") for i in range(3000)] + [(10000 + i, f"un texte {i} de plus", "fr", "s") for i in range(300)]
    drawn = common.sample_texts(docs(spark, rows), 50, spark.createDataFrame([("en",), ("fr",)], "lang string"))
    assert {(r["lang"], r["count"]) for r in drawn.groupBy("lang").count().collect()} == {("en", 1), ("fr", 50)}
    assert common.sample_texts(docs(spark, rows), 50).count() == 50
    assert common.sample_texts(docs(spark, []), 50).count() == 0


def test_fingerprints(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(100000, None), (100001, "é"), (100002, "")], "doc_id long, text string"))
    data = sorted((r["doc_id"], r["text"] or "") for r in rows.collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows.repartition(3)).collect()}
    assert len(got) == len(data)
    edited_high, next_low = [], []
    for n, (i, t) in enumerate(data):
        nxt = data[(n + 1) % len(data)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[i]
        own, ed, nx = (fingerprint.digests([x.encode()]) for x in (t, edited, nxt))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.as_text(own[0]))
        assert r["near_edited"] == fingerprint.likeness(own, ed)[0] and r["near_next"] == fingerprint.likeness(own, nx)[0]
        if len(t) > 400 and t != nxt:
            edited_high.append(r["near_edited"])
            next_low.append(r["near_next"])
    assert np.median(edited_high) > np.median(next_low) + 0.2


def test_fingerprint_counts():
    text = b"abcdefgabcx"
    want = np.zeros(fingerprint.BUCKETS, int)
    alone = fingerprint._counts([b"zz", text, b""])
    for size in range(3, len(text) + 1):
        want = fingerprint._counts([text[:size]])[0]
    assert (alone[1] == want).all() and alone[0].sum() == 0 and alone[2].sum() == 0


def test_mixing(spark):
    rows = [(i, "one two three", "en" if i % 3 else "fr", f"s{i % 4}") for i in range(4000)] + [(9000, None, None, None), (9001, "", "en", "s1")]
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}), "lang": share({"en": 0.5, "fr": 0.5})}
    got = mixing.mix(docs(spark, rows), F.lit("t"), targets)
    p = got.where("mix_tokens > 0").groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("w")).collect()
    total = sum(r["w"] for r in p)
    assert abs(next(r["w"] for r in p if r["source"] == "s0") / total - 0.4) < 1e-3
    kept = got.where("mix_kept").count()
    assert abs(kept * 3 - total) < 0.1 * total
    assert got.where("doc_id >= 9000 AND mix_kept").count() == 0 and got.count() == len(rows)


def test_mixing_meets_its_targets(spark):
    """After the rounds of raking every marginal is met; nothing is rounded away."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    cells = d.groupBy("source", "lang", mixing.form_topic(F.col("text")).alias("topic")).agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    fitted = mixing.rake(cells, mixing.form_targets(cells))
    assert all(r["deviation"] < 1e-6 for r in mixing.deviation(fitted, list(mixing.DIMENSIONS)).collect())
    mixed = mixing.mix(d, mixing.form_topic(F.col("text")), mixing.form_targets)
    assert mixing.kept_share(mixed).first()["tokens"] > 0.2
    share = mixed.groupBy("mix_topic").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("w")).collect()
    total = sum(r["w"] for r in share)
    assert all(abs(r["w"] / total - mixing.FORM_SHARES[r["mix_topic"]]) < 1e-6 for r in share)
    rare = docs(spark, [(i, "a b", "en", "big") for i in range(2000)] + [(9999, "a b", "en", "rare")])
    few = {"source": mixing.fixed_targets(spark, {"big": 1e-9, "rare": 1 - 1e-9, "absent": 0.5})}
    got = {r["source"]: r["mix_probability"] for r in mixing.mix(rare, F.lit("t"), few).select("source", "mix_probability").distinct().collect()}
    assert got["rare"] == 1 and 0 < got["big"] < 1e-11
    odd = rare.withColumn("mix_kept", F.lit("clash")).unionByName(docs(spark, [(None, "no id", None, None)]).withColumn("mix_kept", F.lit("x")))
    assert mixing.mix(odd, F.lit("t")).where("mix_probability > 0").count() == 2002
    assert mixing.mix(docs(spark, []), F.lit("t")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted((tuple(v[want.columns.index(c)] for c in cols) for v in want.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_pipeline_stages(spark):
    """Each stage on odd rows: what goes, what stays, and the columns of documents."""
    import corpus_pipeline as cp

    real = table(spark, "/root/testdata/sf0.01", "documents").where("text <> ''")
    columns = real.columns
    odd = [(-1, None, None), (-2, "", "en"), (-3, "12 34 !!", "en"), (-4, "漢字仮名交じり文の例文" * 20, None), (None, "the and that with this from", "en"), (None, "the and that with this from", "en"), (-5, "the and that with this from they", None), (-5, "quite other words of the same row id", "en"), (-5, "quite other words of the same row id", "en")]
    rows = spark.createDataFrame([(i, t, la, "s", 0) for i, t, la in odd], "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    both = real.select(*[F.col(c).cast(rows.schema[c].dataType) for c in columns]).unionByName(rows)

    kept = cp.language(spark, both, SF)
    assert kept.columns == columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {-1, -2, -3, -4} & set(ids) and ids.count(-5) == 3 and ids.count(None) == 2
    assert kept.where("lang IS NULL").isEmpty() and len(ids) >= 0.995 * real.count() + 5

    alone = cp.near_duplicates(spark, kept, SF)
    assert alone.columns == columns
    group = {r["doc_id"]: r["group_id"] for r in neardup.groups(kept).collect()}
    left = [r["doc_id"] for r in alone.collect()]
    assert sorted((i for i in left if i is not None and i != -5), reverse=True) == sorted((i for i, g in group.items() if i is not None and i == g and i != -5), reverse=True)
    assert left.count(None) == 1 and left.count(-5) in (0, 2)

    mixed = cp.mixture(spark, alone, SF)
    assert mixed.columns == columns and 0 < mixed.count() <= alone.count()
    for _, stage in cp.STAGES:
        assert stage(spark, both.limit(0), SF).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Texts around one long passage: the last two ways of splitting find what brute force does."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [f"{passage} " + " ".join(f"x{n // 2}y{i}" for i in range(40 + n % 2)) for n in range(24)]
    found = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    codes = [neardup.word_codes(neardup.words_of(t)) for t in texts]
    brute = {n: min(m for m in range(len(texts)) if neardup.near(codes[n], codes[m])) for n in range(len(texts))}
    assert found == brute == {n: n - n % 2 for n in range(24)}


def test_near_duplicates_that_agree_once(spark):
    """Two members of a small bucket that share one element only, and aren't near its pivot."""
    rng = random.Random(8)
    sketch = lambda w: neardup.order_minhash(neardup.word_codes(w)).tolist()
    while True:
        b = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        c = [f"c{i}" if i % 10 == 5 else w for i, w in enumerate(b)]
        same = [i for i, (x, y) in enumerate(zip(sketch(b), sketch(c), strict=True)) if x == y]
        if len(same) != 1:
            continue
        value = (neardup.labelled_kmers(neardup.word_codes(b)) ^ neardup._XOR[same[0]]) * neardup._MUL[same[0]]
        at = sorted(np.argsort(value)[: neardup.MINIMA].tolist())
        a = [w for i in at for w in b[i : i + 5]]
        if min(np.diff(at)) >= 5 and sum(x == y for x, y in zip(sketch(a), sketch(b), strict=True)) == 1 and sketch(a)[same[0]] == sketch(b)[same[0]]:
            break
    texts = [" ".join(t) for t in (a, b, c)]
    found = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == {0: 0, 1: 1, 2: 1}


def test_groups_of_hot_copies_and_odd_ids(spark, monkeypatch):
    """Hot keys are dealt to several tasks; texts of one id, null ids, long texts."""
    from airside.llm import common as c

    monkeypatch.setattr(c, "SPREAD_FROM", 10)
    monkeypatch.setattr(c, "HOT_ROWS", 3)
    monkeypatch.setattr(c, "HOT_SHARE", 10)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**5)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(60)]
    near = []
    for i in range(40):
        c2 = list(base)
        c2[rng.randrange(150)] = f"x{i}"
        near.append(" ".join(c2))
    rows += [(100 + i, t) for i, t in enumerate(near)] + [(None, " ".join(base)), (None, None), (500, None), (501, "")]
    rows += [(700, "one text of an id " * 3), (700, "quite another text with the same id " * 2), (701, "one text of an id " * 3)]
    long = [f"l{rng.randrange(10**6)}" for _ in range(60_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:30_000] + ["cut"] + long[30_040:]))]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = sorted(((r["doc_id"], r["group_id"], r["group_size"]) for r in got), key=repr)
    want = [(i, 0, 100) for i in [*range(60), *range(100, 140)]] + [(None, None, 1)] * 2 + [(500, 500, 1), (501, 501, 1), (700, 700, 3), (700, 700, 3), (701, 700, 3), (900, 900, 2), (901, 900, 2)]
    assert by == sorted(want, key=repr)


def test_recall_on_given_documents(spark):
    """Every link that brute force finds among the given texts, by the operator's own rule."""
    rows = [(r["doc_id"], neardup.word_codes(neardup.words_of(r["text"]))) for r in table(spark, "/root/testdata/sf0.01", "documents").where("text <> ''").collect()]
    rows = [(i, c) for i, c in rows if len(c)]
    group = {r["doc_id"]: r["group_id"] for r in neardup.groups(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    sets = [set(c.tolist()) for _, c in rows]
    pairs = lost = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(rows[i][1]), len(rows[j][1])
            if min(a, b) >= 0.8 * max(a, b) and len(sets[i] & sets[j]) >= 0.6 * max(len(sets[i]), len(sets[j])) and neardup.near(rows[i][1], rows[j][1]):
                pairs += 1
                lost += group[rows[i][0]] != group[rows[j][0]]
    assert pairs > 100 and lost == 0


@pytest.mark.parametrize(("share", "even", "least"), [(0.05, True, 0.99), (0.1, True, 0.93), (0.12, True, 0.8), (0.05, False, 0.99), (0.1, False, 0.97), (0.15, False, 0.85)])
def test_recall_of_spread_edits(share, even, least):
    """How often two texts agree on an element if words differ at even distances (the worst case) or at random."""
    rng, met = random.Random(5), 0
    for _ in range(200):
        a = [rng.randrange(10**6) for _ in range(300)]
        n = int(300 * share)
        at = {int(x) for x in np.linspace(0, 299, n)} if even else set(rng.sample(range(300), n))
        b = [rng.randrange(10**6, 2 * 10**6) if i in at else w for i, w in enumerate(a)]
        x, y = (neardup.order_minhash(np.array(v, np.uint32)) for v in (a, b))
        met += bool((x == y).any())
    assert met / 200 >= least


def test_near_duplicates_with_scattered_edits_around_a_passage(spark):
    """All near pairs that agree on an element are linked, also if hundreds of texts share it."""
    rng = random.Random(11)
    passage, texts = [f"p{i}" for i in range(100)], []
    for n in range(130):
        own = [f"o{n}w{i}" for i in range(100)]
        texts.append(passage + own)
        edits = 8 + n % 5 * 8  # edit similarity 0.96 to 0.8
        at = {int(i) for i in np.linspace(0, 99, edits)} if n % 2 else set(rng.sample(range(100), edits))
        texts.append(passage + [f"e{n}w{i}" if i in at else w for i, w in enumerate(own)])
    codes = [neardup.word_codes(t) for t in texts]
    sketches = [set(enumerate(neardup.order_minhash(c).tolist())) for c in codes]
    want = list(range(len(texts)))
    for n in range(0, len(texts), 2):
        if sketches[n] & sketches[n + 1] and neardup.near(codes[n], codes[n + 1]):
            want[n + 1] = n
    found = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert sum(w != n for n, w in enumerate(want)) > 90
    # Near pairs that agree on no element may be found besides.
    assert all(found[n] == w for n, w in enumerate(want) if w != n or n % 2 == 0)
    assert all(found[n] in (n, n - 1) and neardup.near(codes[n], codes[found[n]]) for n in range(1, len(texts), 2))
