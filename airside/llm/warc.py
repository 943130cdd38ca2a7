"""WARC archives: writing, and reading by boundary-chain verification (operator 7).

A record is text whose closing blank lines are the line separator of Spark's text writer, so
archives are written by the JVM to any file system. Reading cuts the files at every record
magic, wherever it stands. Each cut is a candidate record, which names its successor: its
offset plus header, Content-Length and the closing blank lines. Only candidates on the chain
that starts at offset 0 of a file are records; a magic inside a payload is jumped over.
Chains are followed by pointer jumping, first inside each block of a file and then from
block to block, so that a large file needs no single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airside.llm.common import fresh_path, materialise

MAGIC = "WARC/1.1\r\n"
#: Our own header: base64 of a URL that has blanks or breaks.
EXACT_URI = "X-Exact-Target-URI"
CLOSE = "\r\n\r\n"
#: Payloads of fewer bytes are always stored, never revisited.
LEAST_REVISIT = 100
#: Up to this many groups of equal payloads (72 bytes each) are sent to all executors.
GROUPS_TO_ALL = 200_000
#: Of more groups, the largest that are sent to all executors, so that none of them is one task's.
HOT_GROUPS = 20_000


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, refers_to.

    Among equal payloads of at least LEAST_REVISIT bytes the smallest page_id is the response
    (all rows that have it, if it repeats); ``refers_to`` is that id for the others. Null html
    is the empty payload. Rows without a page_id refer to the smallest id, if there is one.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups, "groups")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    if groups.count() <= GROUPS_TO_ALL:
        return rows.join(F.broadcast(groups.drop("n")), "digest", "left").withColumn("refers_to", first).drop("first")
    # Digests that many pages have, at most HOT_GROUPS, go to all; by the others payloads are shuffled.
    hot = F.broadcast(groups.orderBy(F.col("n").desc(), "digest").limit(HOT_GROUPS).select("digest", "first"))
    met = rows.join(hot, "digest").withColumn("refers_to", first).drop("first")
    cold = rows.join(hot, "digest", "left_anti").join(groups.drop("n"), "digest", "left").withColumn("refers_to", first).drop("first")
    return met.unionByName(cold)


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write a response or revisit record for each page (page_id, url, html) as plain WARC files.

    ``date`` is the time of capture (ISO 8601, UTC), by default the time of writing. A URL with
    blanks or breaks, which no header line can hold, stands escaped in WARC-Target-URI and
    exactly in a further header; a null URL has no header.
    """
    rows = revisits(pages)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    odd = F.col("url").rlike(r"[\x00-\x20\x7f]")
    plain = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    uri = F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), plain, F.when(odd, F.concat(F.lit(f"\r\n{EXACT_URI}: "), _one_line(F.col("url")))).otherwise("")), F.lit(""))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    is_revisit = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:page:"), number, F.lit(">\r\nWARC-Date: "), when, uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(CLOSE),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", CLOSE).text(path)


def _one_line(text):
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: file, block, seq (order of reading within a block), value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _header(name: str):
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: ?([^\r\n]*)", 1)


def _jump(offsets: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For each candidate of a block, the first place off the block's candidates that its chain
    reaches; by doubling the length of all jumps at once."""
    n = len(offsets)
    at = np.searchsorted(offsets, successor)
    inside = (at < n) & (offsets[np.minimum(at, n - 1)] == successor)
    last = np.arange(n)  # of the chain's candidates, the furthest known
    step = np.where(inside, at, last)
    while not np.array_equal(step[step], step):
        step = step[step]
    return successor[step]


def _exits(key, pdf):
    pdf = pdf.sort_values("offset")
    return pd.DataFrame({"file": key[0], "offset": pdf["offset"], "leaves": _jump(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())})


def _marked(key, pdf):
    """Candidates of a block on the chain of one of its entries."""
    pdf = pdf.sort_values("offset")
    offsets, successor = pdf["offset"].to_numpy(), pdf["successor"].to_numpy()
    n = len(offsets)
    at = np.searchsorted(offsets, successor)
    inside = (at < n) & (offsets[np.minimum(at, n - 1)] == successor)
    step = np.where(inside, at, np.arange(n))
    on = pdf["entry"].to_numpy(bool).copy()
    while True:
        before = on.sum()
        on[step[on]] = True
        if on.sum() == before:
            break
        step = step[step]
        on[step[on]] = True
    return pdf.loc[on, ["offset"]].assign(file=key[0])[["file", "offset"]]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records: file, block, seq, offset, size (up to the next magic), successor, header fields.

    A candidate that ends exactly at the next magic also carries its payload's digest.
    """
    cut = _segments(spark, path)
    narrow = cut.withColumn("head", F.substring_index("value", CLOSE, 1)).withColumn("size", F.octet_length("value").cast("long")).withColumn("head_bytes", F.octet_length("head").cast("long"))
    length = F.expr("try_cast(regexp_extract(head, '(?:^|\\\\r\\\\n)Content-Length: ?([0-9]+)(?:\\\\r\\\\n|$)', 1) AS bigint)")
    narrow = narrow.withColumn("content", F.when(F.col("head_bytes") < F.col("size"), length))
    body = F.expr("substring(cast(value AS binary), int(head_bytes) + 5, int(content))")
    whole = F.col("size") == F.col("head_bytes") + 4 + F.col("content") + 4
    exact = _header(EXACT_URI)
    url = F.when(exact != "", F.decode(F.unbase64(exact), "UTF-8")).when(F.instr("head", "WARC-Target-URI:") > 0, _header("WARC-Target-URI"))
    fields = [_header("WARC-Type").alias("record_type"), F.expr("try_cast(regexp_extract(head, 'WARC-Record-ID: <urn:page:(-?[0-9]+)>', 1) AS bigint)").alias("page_id"), F.expr("try_cast(regexp_extract(head, 'WARC-Refers-To: <urn:page:(-?[0-9]+)>', 1) AS bigint)").alias("refers_to"),
              url.alias("url"), F.regexp_replace(_header("WARC-Payload-Digest"), "^sha256:", "").alias("told_digest"), F.expr("try_cast(regexp_extract(head, 'WARC-Payload-Length: ?([0-9]+)', 1) AS bigint)").alias("told_bytes")]
    narrow = narrow.select("file", "block", "seq", "size", "head_bytes", "content", F.when(whole, F.sha2(body, 256)).alias("digest"), F.sha2(F.col("value").cast("binary"), 256).alias("piece"), *fields)
    # Offsets: sizes before within the block, and the sizes of the file's blocks before.
    marks = len(MAGIC)
    within = Window.partitionBy("file", "block").orderBy("seq")
    placed = materialise(narrow.withColumn("before", F.sum(F.col("size") + marks).over(within.rowsBetween(Window.unboundedPreceding, -1))), "cuts")
    blocks = placed.groupBy("file", "block").agg(F.sum(F.col("size") + marks).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(blocks, ["file", "block"]).withColumn("offset", F.col("base") + F.coalesce("before", F.lit(0)) - marks)
    return placed.withColumn("successor", F.coalesce(F.col("offset") + marks + F.col("head_bytes") + 4 + F.col("content") + 4, F.lit(-1))).drop("base", "before")


def reachable(found: DataFrame) -> DataFrame:
    """file, offset of the candidates that the chain from offset 0 of their file reaches."""
    nodes = materialise(found.where("offset >= 0").select("file", "block", "offset", "successor"), "chain")
    exits = materialise(nodes.groupBy("file", "block").applyInPandas(_exits, "file string, offset long, leaves long"), "exits")
    # Entries of blocks: offset 0, and wherever the chain of another block's entry leads.
    targets = exits.select("file", F.col("leaves").alias("offset")).distinct()
    hops = exits.join(targets, ["file", "offset"], "left_semi").select("file", F.col("offset").alias("a"), F.col("leaves").alias("b"))
    start = exits.where("offset = 0").select("file", "offset")
    hops = materialise(hops.unionByName(exits.where("offset = 0").select("file", F.col("offset").alias("a"), F.col("leaves").alias("b"))).distinct(), "hops")
    entries, known = materialise(start, "entries"), start.count()
    while True:  # entries and jumps double each round
        more = entries.join(hops.withColumnRenamed("a", "offset"), ["file", "offset"]).select("file", F.col("b").alias("offset")).join(exits.select("file", "offset"), ["file", "offset"], "left_semi")
        entries = materialise(entries.unionByName(more).distinct(), "entries")
        now = entries.count()
        if now == known:
            break
        known = now
        hops = materialise(hops.alias("x").join(hops.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.b") == F.col("y.a"))).select("x.file", "x.a", F.col("y.b").alias("b")).unionByName(hops).distinct(), "hops")
    flagged = nodes.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return flagged.groupBy("file", "block").applyInPandas(_marked, "file string, offset long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Digest and size of a response are those of the payload read; a revisit's are the ones its
    header tells. URLs are the ones written. Files whose first bytes are no record have none. Payloads cut by a magic
    inside them are put together again from their pieces.
    """
    found = candidates(spark, path)
    records = found.join(materialise(reachable(found), "reached"), ["file", "offset"])
    simple = F.col("digest").isNotNull() | (F.col("record_type") == "revisit")
    broken = records.where(~simple)
    if not broken.isEmpty():
        spans = broken.select("file", F.col("offset").alias("start"), "successor", "head_bytes", "content")
        # Pieces of a cut record: the candidates from its start up to its successor.
        inner = found.where("offset >= 0").select("file", "block", "piece", "offset")
        marked = inner.join(spans.select("file", F.col("start").alias("offset"), "start", "successor", "head_bytes", "content"), ["file", "offset"], "left")
        last = Window.partitionBy("file", "block").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
        held = marked.withColumn("open", F.last(F.when(F.col("start").isNotNull(), F.struct("start", "successor", "head_bytes", "content")), ignorenulls=True).over(last))
        # A record may go on over later blocks of its file: carry the open one from block to block.
        ends = held.groupBy("file", "block").agg(F.max_by("open", "offset").alias("carried"))
        prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("file", "block", F.last("carried", ignorenulls=True).over(prior).alias("carried"))
        held = held.join(ends, ["file", "block"], "left").withColumn("open", F.coalesce("open", "carried")).where("offset < open.successor")
        pieces = held.select("file", "piece", "offset", F.col("open.start").alias("start"), F.col("open.head_bytes").alias("head_bytes"), F.col("open.content").alias("content"))
        # Their text is read again, and found by its digest: rows of two scans have no common number.
        wanted = pieces.select("piece").distinct()
        text = _segments(spark, path).select(F.sha2(F.col("value").cast("binary"), 256).alias("piece"), "value").join(wanted, "piece", "left_semi").dropDuplicates(["piece"])
        joined = pieces.join(text, "piece").groupBy("file", "start", "head_bytes", "content").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
        mended = joined.select("file", F.col("start").alias("offset"), F.sha2(F.expr("substring(cast(value AS binary), int(head_bytes) + 5, int(content))"), 256).alias("mended"))
        records = records.join(mended, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "mended"))
    is_revisit = F.col("record_type") == "revisit"
    return records.select("page_id", "url", "record_type", F.when(is_revisit, F.col("refers_to")).alias("refers_to"), F.when(is_revisit, F.col("told_bytes")).otherwise(F.col("content")).alias("payload_bytes"), F.when(is_revisit, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_records(spark, path)
