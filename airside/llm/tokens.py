"""Token ids with a public tokenizer file, and token files in ORC (operator 3).

``WordEncoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
Both tokenizers used here split a text before any merge, and a single space between two
non-blank characters is always such a split. So a text is cut there, every part is looked
up in a bounded cache of parts already encoded, and only new parts go to the library.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts kept by one Python worker; later new parts are encoded again each time.
CACHE_PARTS = 800_000

# The pre-token patterns of the two tokenizer files.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

#: Texts in which a cut at spaces could differ from the library's: blank runs, control
#: separators (Python calls them blank, the tokenizers don't), markers of special tokens.
_ODD = re.compile(r" \s|[\x00\x1c-\x1f]|<\|")
#: Beyond Latin-1 a part goes to the library whole.
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]")
#: Byte-level files write each byte as a printable character: itself where it is printable
#: Latin-1, else the next free character from 256 on.
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_PRINTABLE = {b: 256 + n for n, b in enumerate(_UNPRINTABLE)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers, by way of a cache of parts."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = self.tokenizer.pre_tokenizer.__class__.__name__ == "ByteLevel"
        pattern = _BYTE_LEVEL if self.byte_level else _WORD_LEVEL
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(pattern.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")).findall
        self.cache: dict[str, bytes] = {}
        self.limit = cache_parts

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self.cache) < self.limit:
            self.cache[key] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """A part between two cuts: the library's own pre-tokens, each merged by its model."""
        if not part:
            return b""
        if not part.isascii() and _BEYOND_LATIN.search(part):
            return self._keep(part, self._library(part))
        text = part if self.byte_level else part.lower()
        pieces = (self.split_ascii if part.isascii() else self.split)(text)
        if pieces == [part]:
            return self._piece(part)
        got = b"".join([self.cache.get(p) or self._piece(p) for p in pieces])
        return self._keep(part, got)

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(_PRINTABLE)
        return self._keep(piece, array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes())

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text):
            return self._library(text)
        parts = text.replace(" ", "\0 ").split("\0") if self.byte_level else text.split(" ")
        get = self.cache.get
        found = [get(p) for p in parts]
        if None in found:
            found = [self._part(p) if f is None else f for p, f in zip(parts, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=4)
def encoder(path: str, cache_parts: int = CACHE_PARTS) -> WordEncoder:
    """One encoder for each tokenizer file in a Python worker."""
    return WordEncoder(path, cache_parts)


def id_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def as_lists(chunks: list[bytes]) -> pa.Array:
    """Id bytes as an Arrow list<int32> array, without a Python object for each id."""
    ends = [0]
    for c in chunks:
        ends.append(ends[-1] + len(c) // 4)
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(chunks))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


#: Characters of text that one output batch of an encoding task may stem from.
BATCH_CHARS = 4_000_000


def batches_of_text(batches, columns: tuple[str, ...]):
    """Lists of row tuples, each list of at most BATCH_CHARS characters (or one row)."""
    rows, chars = [], 0
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
            rows.append(row)
            chars += len(row[1] or "")
            if chars >= BATCH_CHARS:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_ids: list[int], id_col: str = "doc_id", text_col: str = "text", stride: int = 1000) -> None:
    """Encode every text and write ORC files in ascending ``id_col`` order.

    One range shuffle puts the documents in order; each task encodes its range and writes
    one file, whose integers ORC run-length encodes. Rows carry ``part`` (number of the
    range), ``local_start`` (ids of the range before this document) and ``tokens``. A row
    index every ``stride`` rows and Bloom filters on ``id_col`` let readers skip stripes.

    Null text is the empty text. Null ids come first. Rows that share an id stand in the
    order of a hash of their text. Other columns are ignored. No rows: files without rows.
    """
    end = id_bytes(end_ids)

    def encode(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for rows in batches_of_text(batches, ("doc_id", "text")):
            chunks = [enc.encode(t) + end if t else end for _, t in rows]
            sizes = [len(c) // 4 for c in chunks]
            starts = []
            for n in sizes:
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array([d for d, _ in rows], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), as_lists(chunks)],
                names=["part", "doc_id", "local_start", "n_tokens", "tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    encoded = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, "part int, doc_id long, local_start long, n_tokens long, tokens array<int>")
    (encoded.write.option("orc.compress", "ZSTD").option("orc.row.index.stride", stride).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_files(spark, path: str, ids: list[int] | None = None) -> DataFrame:
    """Rows of the token files: doc_id, part, local_start, n_tokens, tokens.

    ``ids`` keeps the documents with these ids; the predicate reaches the ORC reader, which
    skips stripes and row groups by their statistics and Bloom filters.
    """
    df = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, tokens array<int>").orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin([int(i) for i in ids]))


def part_starts(files: DataFrame) -> DataFrame:
    """part, base: ids in all ranges before this one. A row for each file, not each document."""
    from pyspark.sql import Window

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def _checksums(batches):
    for b in batches:
        tokens = b.column(b.schema.get_field_index("tokens"))
        raw, ends = memoryview(tokens.values.buffers()[1] or b""), tokens.offsets.to_pylist()
        shift = tokens.values.offset
        crc = [zlib.crc32(raw[4 * (a + shift) : 4 * (z + shift)]) for a, z in zip(ends, ends[1:], strict=False)]
        keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "part", "local_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the token files.

    Checksums are taken where the stripes are read, so that only narrow rows meet the
    table of range starts.
    """
    digests = files.mapInArrow(_checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    joined = digests.join(part_starts(files), "part")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
