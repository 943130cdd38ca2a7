"""URL filters on a sorted digest array (operator 4).

The list of rules becomes a sorted array of 64-bit xxhash keys beside the full rule strings.
Each executor gets one local copy of the file and memory-maps it. A URL's candidates are its
host and the hosts above it, each with the path prefixes whose lengths occur in the list; all
candidates of a batch are probed by one vectorised binary search, and a hit counts only if
the stored string is the candidate, so that equal digests can't mislead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists up to this size are shipped to every executor; longer ones are joined by digest.
MAX_LOCAL_BYTES = 256 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """(host, path) columns: host between the first ``://`` and ``/?#``, A-Z lower-cased; path up to ``?#``.

    Null, or no ``://``: both empty.
    """
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def write_digest_array(rules: list[tuple[str, str, str]], path: str) -> None:
    """One npz-free file: count, digests (ascending), string ends, verdict flags, strings."""
    keyed = sorted((xxhash.xxh64_intdigest(h + p), h + p, v) for h, p, v in rules)
    blobs = [k.encode() for _, k, _ in keyed]
    with open(path, "wb") as f:
        f.write(np.array([len(keyed)], "<u8").tobytes())
        f.write(np.array([d for d, _, _ in keyed], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, blobs)]).astype("<u8").tobytes())
        f.write(np.array([v == "allow" for _, _, v in keyed], "u1").tobytes())
        f.write(b"".join(blobs))


class DigestArray:
    """A memory-mapped digest array."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.allow = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    def probe(self, keys: list[str]) -> np.ndarray:
        """Index of each key's entry, -1 where the list has no such string."""
        want = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, want)
        found = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == want)) if len(self.digests) else []
        for i in open_:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i]:  # entries with equal digests stand together
                if self.text(j) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def text(self, j: int) -> str:
        return self.strings[int(self.ends[j]) : int(self.ends[j + 1])].tobytes().decode()


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rule strings that would fit, the longest first (of equal ones, the longer host)."""
    hosts, rest = [], host
    while rest:
        hosts.append(rest)
        rest = rest.partition(".")[2]
    keys = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(keys, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))]


def _by_array(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    spark = urls.sparkSession
    name = f"digests-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="airside-"), name)
    write_digest_array(rules, local)
    spark.sparkContext.addFile(local)
    lengths = sorted({len(p) for _, p, _ in rules})

    def judge(batches):
        array = _mapped(name)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            lists = [candidates(h, p, lengths) for h, p in zip(hosts, paths, strict=True)]
            hit = array.probe([k for ks in lists for k in ks])
            at, rule, verdict = 0, [], []
            for ks in lists:
                first = next((j for j in hit[at : at + len(ks)] if j >= 0), -1)
                at += len(ks)
                rule.append(array.text(first) if first >= 0 else None)
                verdict.append(("allow" if array.allow[first] else "block") if first >= 0 else default)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for lists of any length: distinct (host, path), their candidates, an equi-join."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda n: F.struct(h.alias("h"), F.substring(F.col("path"), F.lit(1), n).alias("p")))))
    distinct = urls.select("host", "path").distinct()
    tried = distinct.select("host", "path", F.explode(pairs).alias("c")).withColumn("key", F.concat("c.h", "c.p"))
    keyed = rules.select(F.concat("host", "path").alias("key"), F.col("verdict").alias("said"))
    best = tried.join(keyed, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "said"), F.struct(F.length("key"), F.length("c.h"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_local_bytes: int = MAX_LOCAL_BYTES) -> DataFrame:
    """Judge every URL by the longest rule that fits: page_id, host, path, rule, verdict.

    ``rules`` has host, path, verdict (allow or block). A rule fits its host and all
    subdomains if the URL's path starts with the rule's. Without a rule, ``default``.

    Null URLs and ones without ``://`` have empty host and path, so no rule fits. Repeated
    rows are judged alike and all kept. Of rules given twice, block wins. No rows: no rows.
    """
    host, path = url_parts(F.col(url_col))
    rows = urls.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat("host", "path"))), F.lit(0))).first()
    if 17 * n + size > max_local_bytes:
        return _by_join(rows, rules, default)
    return _by_array(rows, [tuple(r) for r in rules.collect()], default)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
