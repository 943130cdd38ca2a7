"""Language ID by prediction by partial matching (operator 8).

Each language has a tree of byte contexts of up to ORDER bytes. A symbol that a context has
seen n times of N, among D distinct ones, costs -log2(n / (N + D)) bits; an unseen one costs
the escape, D / (N + D), and is then predicted by the next shorter context, whose
probabilities leave out what the longer one has seen; a context that was never seen costs
nothing. Statistics are frozen after training, so the cost of a byte is a function of it and
the bytes before, and a text's code length is exact. Trees are sparse: sorted keys of the
strings seen, each with its final cost, and of the contexts, each with its cost of an escape.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airside.llm.common import sample_texts

#: Labelled documents to train on, for each language: differing texts of least hash.
DOCS_PER_LANGUAGE = 3000
#: Languages to learn, the ones with most labelled documents first.
LANGUAGES = 1000
#: Bytes of the longest context; a string of a context and its symbol fits 32 bits.
ORDER = 3
_START = b"\n" * ORDER
_BLOCK_BYTES = 1_000_000


@dataclass
class Tree:
    """One language: by order, strings seen and their bits, contexts seen and their escapes' bits."""

    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def grow(cls, gram: np.ndarray, n: np.ndarray) -> Tree:
        """From the counts of all strings of ORDER + 1 bytes (big-endian numbers)."""
        tree = cls([], [], [], [])
        for order in range(ORDER + 1):
            key, times = _summed(gram & ((1 << 8 * (order + 1)) - 1), n)
            context, at = np.unique(key >> 8, return_inverse=True)
            total, distinct = np.bincount(at, times), np.bincount(at)
            if order:  # what the shorter context gives to the symbols seen here
                shorter = np.exp2(-tree.bits[-1].astype(np.float64))[np.searchsorted(tree.keys[-1], key & ((1 << 8 * order) - 1))]
            else:
                shorter = np.full(len(key), 1 / 256)
            left = np.maximum(1 - np.bincount(at, shorter), 1e-12)
            tree.keys.append(key.astype(np.uint32))
            tree.bits.append(-np.log2(times / (total + distinct)[at]))
            tree.contexts.append(context.astype(np.uint32))
            tree.escapes.append(-np.log2(distinct / (total + distinct) / left))
        return tree

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string after the bytes before it."""
        out = np.zeros(len(gram))
        rest = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[rest] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, hit = _found(self.keys[order], key)
            out[rest[hit]] += self.bits[order][at[hit]]
            rest, key = rest[~hit], key[~hit]
            at, hit = _found(self.contexts[order], key >> np.uint32(8))
            out[rest[hit]] += self.escapes[order][at[hit]]
        out[rest] += 8  # an equal share for each byte value
        return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def _found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    return at, keys[at] == key if len(keys) else np.zeros(len(key), bool)


@dataclass
class Model:
    """Languages and their trees. Its size is bounded by the training texts': no string seen
    costs more than 12 bytes an order."""

    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text (rows) in every language (columns); long texts go through in blocks."""
        out = np.zeros((len(texts), len(self.languages)))
        owner, parts, size = [], [], 0
        for i, t in enumerate(texts):
            t = _START + t
            for lo in range(0, len(t) - ORDER, _BLOCK_BYTES):
                part = t[lo : lo + _BLOCK_BYTES + ORDER]
                owner.append(i)
                parts.append(part)
                size += len(part)
                if size >= _BLOCK_BYTES:
                    self._add(out, owner, parts)
                    owner, parts, size = [], [], 0
        self._add(out, owner, parts)
        return out

    def _add(self, out: np.ndarray, owner: list[int], parts: list[bytes]) -> None:
        if not parts:
            return
        gram = _grams(b"".join(parts))
        starts = np.cumsum([0, *map(len, parts)])
        own = np.ones(len(gram), bool)
        for back in range(1, ORDER + 1):  # strings that reach over from one part into the next
            own[starts[1:-1] - back] = False
        distinct, at = np.unique(gram, return_inverse=True)
        for k, tree in enumerate(self.trees):
            bits = tree.cost(distinct)[at]
            bits[~own] = 0
            np.add.at(out[:, k], owner, np.add.reduceat(bits, starts[:-1]))


def _grams(raw: bytes) -> np.ndarray:
    """Strings of ORDER + 1 bytes that end at each byte after the first ORDER, as numbers."""
    r = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(r) - ORDER
    gram = np.zeros(n, np.uint32)
    for j in range(ORDER + 1):
        gram = gram << np.uint32(8) | r[j : j + n]
    return gram


def _gram_counts(batches):
    """lang, gram, n: counts of a task's texts, batch by batch."""
    for b in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(_START + text.encode("utf-8", "replace"))
        for lang, texts in by.items():
            gram, n = np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Grow the trees from at most ``docs_per_language`` differing texts of each language.

    ``labelled`` has text and lang; rows with either null or an empty text don't count, copies
    count once. Which texts are drawn doesn't depend on the order or the partitioning of the
    rows. What is collected is bounded by that sample.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    languages = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).select("lang")
    drawn = sample_texts(rows, docs_per_language, languages)
    counts = drawn.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n"))
    found, which = np.unique(lang.astype(str), return_inverse=True)
    return Model([str(x) for x in found], [Tree.grow(gram[which == k].astype(np.int64), n[which == k]) for k in range(len(found))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (which has text) with lang_pred, score, bits_per_byte of the whole text.

    ``score`` is the best language's posterior, all languages being equally likely before.
    Null texts and texts without a letter are ``und`` with score 0 and null bits_per_byte, as
    is every text if nothing could be learned. Ties go to the language first in the alphabet.
    Repeated rows and other columns are all kept, but for columns of the three names, which are
    replaced; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score", "bits_per_byte")

    def predict(batches):
        m: Model = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            at = 0
            while at < len(texts):
                block, size = [], 0
                start = at
                while at < len(texts) and (size < _BLOCK_BYTES or not block):
                    t = texts[at]
                    block.append(t.encode("utf-8", "replace") if t and m.languages and any(map(str.isalpha, t)) else None)
                    size += len(block[-1] or b"")
                    at += 1
                lengths = m.code_lengths([t or b"" for t in block])
                pred, score, per = [], [], []
                for t, bits in zip(block, lengths, strict=True):
                    if t is None:
                        pred.append("und"), score.append(0.0), per.append(None)
                    else:
                        best = int(bits.argmin())
                        pred.append(m.languages[best])
                        score.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
                        per.append(float(bits[best] / len(t)))
                new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(per, pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.slice(start, at - start).columns, *new], names=[*b.schema.names, "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return own.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
