"""Prefix trie of conversations by van Emde Boas recursion (operator 11).

A conversation is a sequence of turns, each known by a digest of its role and text. The trie of
all sequences, of height h, is cut at half its height: the sequences' first halves make the
upper trie, in which equal ones are one row with their number and smallest id; each distinct
full half is a *cut prefix* with a name, and the remainders behind it make the lower trie that
hangs on this name. All upper and lower tries are cut again at once, one step for each halving,
until every trie has height 1 and its rows are the nodes.

A name is the chain of digests along the path, so it is the same whichever cuts led to it. Every
cut prefix keeps the names of its ancestors down to the root of its upper trie. Totals are
grafted in the opposite order: what lies below a cut prefix within its lower trie is added to
each of these ancestors, which joins tries of height m into tries of height 2m. That takes as many
steps as there were cuts, and about half a row for each node in each of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.llm.common import join_hot, materialise

#: Words of a text: runs of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = "00"
#: Ids whose list is made into one text before it is hashed span at most so many numbers.
SPAN = 4096


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: a conversation's turns in order, each as struct<s: digest, w: words of the text>.

    Turns stand in the order of ``turn``, null first, then of their digests. Null role or text is
    empty. Rows without a conv_id belong to none. Texts stay behind: a turn is 24 bytes.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("s"), F.regexp_count(text, F.lit(WORD)).alias("w"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["s"].alias("s"), t["w"].alias("w"))).alias("turns"))


def share_openings(turns: DataFrame, family: int = 20, openings: int = 4) -> DataFrame:
    """Conversations rebuilt on the opening of their family's head.

    The first h turns of conversation c come from conversation c - c % ``family`` (as many as it
    has), h being the unsigned crc32 of c's decimal digits modulo ``openings``; c's own turns after
    its first h follow.
    """
    head = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, openings).alias("_opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int")
    sized = turns.withColumn("_head", F.col("conv_id") - F.col("conv_id") % family).withColumn("_h", h).join(head, "_head", "left")
    none = F.slice("turns", 1, 0)
    opening = F.coalesce(F.slice("_opening", F.lit(1), F.col("_h")), none)
    return sized.select("conv_id", F.concat(opening, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _named(start: Column, seq: Column) -> Column:
    """The name of the prefix that ``seq`` leads to from the one named ``start``."""
    return F.aggregate(seq, start, lambda name, t: _digest(F.concat(name, t["s"])))


def _path(start: Column, seq: Column) -> Column:
    """Names from ``start`` on, without the last: the ancestors of the prefix that ``seq`` leads to."""
    ends = F.transform(seq, lambda t, i: i)
    return F.transform(ends, lambda i: _named(start, F.slice(seq, F.lit(1), i)))


def nodes(turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All nodes below the root, and for each cut, the lowest first, its cut prefixes with their ancestors.

    Nodes: name, parent, depth, conv_id (smallest member), n_convs, words. Cuts: name, path.
    """
    root = F.unhex(F.lit(ROOT))
    rows = turns.where("size(turns) > 0").groupBy(F.col("turns").alias("seq")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    rows = materialise(rows.select(root.alias("grp"), F.lit(0).alias("base"), "seq", "n", "first"), "trie")
    deepest = rows.agg(F.max(F.size("seq"))).first()[0] or 1
    height = 1
    while height < deepest:
        height *= 2
    cuts = []
    while height > 1:
        height //= 2
        first = F.slice("seq", 1, height)
        upper = rows.select("grp", "base", first.alias("seq"), "n", "first").groupBy("grp", "base", "seq").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        # Sequences of a trie are distinct, so their remainders behind a named half are, too.
        rest = F.slice("seq", height + 1, F.greatest(F.size("seq"), F.lit(1)))
        lower = rows.where(F.size("seq") > height).select(_named(F.col("grp"), first).alias("grp"), (F.col("base") + height).alias("base"), rest.alias("seq"), "n", "first")
        upper = materialise(upper, "upper")
        full = upper.where(F.size("seq") == height)
        cuts.insert(0, full.select(_named(F.col("grp"), F.col("seq")).alias("name"), _path(F.col("grp"), F.col("seq")).alias("path")))
        rows = materialise(upper.unionByName(lower), "trie")
    found = rows.select(_named(F.col("grp"), F.col("seq")).alias("name"), F.col("grp").alias("parent"), (F.col("base") + 1).cast("long").alias("depth"), F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), F.element_at("seq", 1)["w"].cast("long").alias("words"))
    return found, cuts


def _hash_lists(batches):
    """SHA-256 of each name's chunks, which come in order, joined by commas; only the running hash is held."""
    name, running = None, None
    for b in batches:
        names, digests = [], []
        for k, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
            if k == name:
                running.update(b"," + text.encode())
                continue
            if running:
                names.append(name)
                digests.append(running.hexdigest())
            name, running = k, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["name", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([running.hexdigest()])], names=["name", "ends_sha256"])


def list_hashes(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of the ids (name, conv_id) of each name, ascending, joined by commas.

    Ids are first joined in spans of SPAN numbers, wherever they are; a long list is then a stream
    of such texts through one running hash, so no task holds all ids of a name.
    """
    span = F.floor(F.col("conv_id") / SPAN)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = materialise(ends.groupBy("name", span.alias("span")).agg(joined.alias("text")), "ends")
    many = chunks.groupBy("name").agg(F.count("*").alias("n"), F.max("text").alias("text"))
    short = many.where("n = 1").select("name", F.sha2("text", 256).alias("ends_sha256"))
    long = chunks.join(many.where("n > 1").select("name"), "name", "left_semi").repartition("name").sortWithinPartitions("name", "span")
    return short.unionByName(long.select("name", "text").mapInArrow(_hash_lists, "name binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, turns; see ``turns_of``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree, members but one times words of the last
    turn), ends_sha256 (of the ids of members that end here). The root has depth 0, no parent and
    all conversations; no conversations give no rows. Equal conversations are members of the same
    nodes. Hot nodes: members are counted before any shuffle, children meet their parent in
    several tasks, lists of ids are hashed as streams.
    """
    turns = materialise(turns, "turns")
    root = F.unhex(F.lit(ROOT))
    below, cuts = nodes(turns)
    top = turns.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    found = materialise(below.unionByName(top), "nodes")
    children = materialise(found.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    own = found.join(children.withColumnRenamed("parent", "name"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = materialise(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "own")

    def add(totals: DataFrame, more: DataFrame) -> DataFrame:
        joined = totals.join(more.withColumnsRenamed({"leaves": "_l", "below": "_b"}), "name", "left")
        return materialise(joined.select("name", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("below") + F.coalesce("_b", F.lit(0))).alias("below")), "totals")

    totals = own.select("name", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"))
    totals = add(totals, own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("below")))
    for cut in cuts:  # tries of height 1, 2, 4, ... become tries of twice the height
        hung = cut.join(totals, "name").select(F.explode("path").alias("name"), "leaves", "below")
        totals = add(totals, hung.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below")))

    ends = list_hashes(turns.select(_named(root, F.col("turns")).alias("name"), "conv_id"))
    parents = own.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_hot(own.where("parent IS NOT NULL"), parents, children.select("parent", F.col("n_children").alias("n")), "parent", "name")
    placed = placed.unionByName(own.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    full = placed.join(totals, "name").join(ends, "name", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
