"""Prefix trie of rebuilt conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its identity is the exclusive-or of 128-bit hashes of (turn, place), so it
grows along a conversation by a running sum, which is taken in blocks: a conversation may hold any share of all rows.

Subtree totals come from rounds over the tree that is left. A round rakes: leaves hand their totals to their parents and go.
And it compresses: where a node with one child left is marked by a coin and its child is not, the child moves up to the
node's parent and takes the node's own value along; the node goes, and is kept with its child and the difference of their
totals. The coin is a bit of the depth first, which halves untouched chains, then a bit of a hash. At the end the spliced
nodes are expanded: their links are doubled until each leads to a raked node. Every join of a round has one row per key on both
sides, and a round is written to the shared folder before the next one reads it.

Defined results: turns are ordered by turn, null first, ties by a hash of role and text, and repeated rows follow each other; a null role or
text is empty; rows without a conversation id belong to no conversation and are left out; an empty table has no nodes, not
even a root; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import hot_join, materialize
from .common import WORD, before, repeated

FAMILY = 20  # conversations c - c % FAMILY lend their first turns
MAX_LENT = 4
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
HOT = 4096  # children above which a parent is joined on a map side
CHUNK_BITS = 8  # numbers of a node's list with equal higher bits are joined to a string at once
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, d1, d2, words): every turn with its place in its conversation, its text as 128 bits and a word count."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit(7), text, role).alias("d2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    row = F.struct("d1", "d2", "words")
    cells = rows.groupBy("conv", "turn").agg(F.count("*").alias("n"), F.min(row).alias("one"), F.max(row).alias("other"))
    # No turn sorts first; its cell shares a group with the smallest turns.
    spot = F.coalesce("turn", F.lit(-(1 << 63)).cast("long"))
    cells = cells.withColumn("_group", F.shiftright(spot, BLOCK_BITS))
    cells = materialize(before(cells, ["conv"], "_group", [F.col("turn").asc_nulls_first()], {"start": "n"}), "turn-cells")
    alike = cells.where("one = other").select("conv", "start", "n", "one.*")
    # Different rows of one turn are ordered by hash, in groups of near hashes.
    mixed = cells.where("one != other").select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "start")
    tied = rows.join(mixed, (F.col("conv") == F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))).groupBy("conv", "start", "d1", "d2", "words").agg(F.count("*").alias("n"))
    tied = before(tied.withColumn("_group", F.shiftright("d1", 52)), ["conv", "start"], "_group", ["d1", "d2", "words"], {"ahead": "n"})
    runs = alike.unionByName(tied.withColumn("start", F.col("start") + F.col("ahead")).select(alike.columns))
    return repeated(runs, "n", "_k").select("conv", (F.col("start") + F.col("_k")).alias("pos"), "d1", "d2", "words")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of placed turns: the rebuilt turns (conv, at, d1, d2, words) and the conversations (conv, length)."""
    lent = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(MAX_LENT))
    infos = placed.groupBy("conv").agg((F.max("pos") + 1).alias("own")).withColumns({"lent": lent, "base": F.col("conv") - F.pmod("conv", F.lit(FAMILY))})
    infos = materialize(infos, "conversations")
    heads = placed.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("pos") < MAX_LENT - 1)).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pos", "d1", "d2", "words"))).alias("head")).withColumnRenamed("conv", "_base")
    borrowing = infos.where("conv != base").join(heads, F.col("base") == F.col("_base"), "left")
    borrowing = materialize(borrowing.select("conv", "own", "lent", F.expr("slice(coalesce(head, array()), 1, cast(lent as int))").alias("head")).withColumn("got", F.size("head").cast("long")), "borrowing")
    lengths = infos.where("conv = base").select("conv", F.col("own").alias("length")).unionByName(
        borrowing.select("conv", (F.col("got") + F.greatest(F.lit(0), F.col("own") - F.col("lent"))).alias("length")))
    # Where the lending conversation is too short, later turns move up. Blocks of places meet the shift, not whole conversations.
    gaps = borrowing.where("got < lent and own > lent").select(F.col("conv").alias("_conv"), (F.col("lent") - F.col("got")).alias("gap"),
                                                              F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("own") - 1, BLOCK_BITS))).alias("_block"))
    kept = placed.where((F.pmod("conv", F.lit(FAMILY)) == 0) | (F.col("pos") >= lent)).withColumn("block", F.shiftright("pos", BLOCK_BITS))
    kept = kept.join(gaps, (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")
    own = kept.select("conv", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("at"), "d1", "d2", "words")
    taken = borrowing.select("conv", F.inline("head")).withColumnRenamed("pos", "at").select(own.columns)
    return own.unionByName(taken), lengths


def prefixes(turns_: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words): the node each rebuilt turn leads to. The root's identity is (0, 0)."""
    hashed = turns_.withColumns({"f1": F.xxhash64("d1", "d2", "at"), "f2": F.xxhash64(F.lit(11), "at", "d2", "d1"), "_group": F.shiftright("at", BLOCK_BITS)})
    run = before(hashed, ["conv"], "_group", ["at"], {"p1": "f1", "p2": "f2"}, xor=True)
    node = F.struct(F.col("p1").bitwiseXOR(F.col("f1")).alias("a"), F.col("p2").bitwiseXOR(F.col("f2")).alias("b"))
    return run.select("conv", (F.col("at") + 1).alias("depth"), node.alias("node"), F.struct(F.col("p1").alias("a"), F.col("p2").alias("b")).alias("parent"), "words")


def subtree_sums(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """Of a forest (node, parent: null at a root, depth, n_children, values): node and the sums of `values` over its subtree.

    `node` and `parent` may be of any type that can be compared.
    """
    own, up = [f"own_{v}" for v in values], [f"up_{v}" for v in values]
    live = tree.select("node", "parent", "depth", F.col("n_children").alias("kids"), *(F.col(v).alias(o) for v, o in zip(values, own)), *(F.lit(0).cast("long").alias(u) for u in up))
    depth_bits = int(tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]).bit_length()
    raked, spliced, turn = [], [], 0
    while not live.isEmpty():
        raked.append(live.where("kids = 0").select("node", *own))
        staying = F.col("kids") > 0
        sent = live.where("parent is not null").groupBy(F.col("parent").alias("_to")).agg(
            F.count(F.when(staying, 1)).alias("_left"), F.min(F.when(staying, F.struct("node", "depth", *up))).alias("only"),
            *(F.sum(F.when(staying, 0).otherwise(F.col(o) + F.col(u))).alias(f"_got_{o}") for o, u in zip(own, up)))

        def coin(node: str, depth: str) -> Column:
            return F.shiftright(depth, turn).bitwiseAND(F.lit(1)) if turn < depth_bits else F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1))
        cut = F.col("parent").isNotNull() & (F.col("_left") == 1) & (coin("node", "depth") == 1) & (coin("only.node", "only.depth") == 0)
        inner = live.where("kids > 0").join(sent, F.col("node") == F.col("_to"))
        inner = materialize(inner.select("node", "parent", "depth", F.col("_left").alias("kids"), *((F.col(o) + F.col(f"_got_{o}")).alias(o) for o in own), *up, "only", F.coalesce(cut, F.lit(False)).alias("cut")), "tree")
        gone = inner.where("cut")
        if gone.isEmpty():
            live = inner.drop("only", "cut")
        else:
            spliced.append(gone.select("node", F.col("only.node").alias("child"), *((F.col(o) + F.col(f"only.{u}")).alias(o) for o, u in zip(own, up))))
            lift = gone.select(F.col("only.node").alias("_child"), F.col("parent").alias("_parent"), *((F.col(o) + F.col(u)).alias(f"_lift_{u}") for o, u in zip(own, up)))
            moved = inner.where("not cut").join(lift, F.col("node") == F.col("_child"), "left")
            live = materialize(moved.select("node", F.coalesce("_parent", "parent").alias("parent"), "depth", "kids", *own, *((F.col(u) + F.coalesce(f"_lift_{u}", F.lit(0))).alias(u) for u in up)), "tree")
        turn += 1
    if not raked:
        return tree.select("node", *values).limit(0)
    done = reduce(DataFrame.unionByName, raked)
    if spliced:
        links = reduce(DataFrame.unionByName, spliced)
        for _ in range((len(spliced) - 1).bit_length()):
            links = materialize(links, "spliced")
            further = links.select(F.col("node").alias("_node"), F.col("child").alias("_child"), *(F.col(o).alias(f"_{o}") for o in own))
            links = links.join(further, F.col("child") == F.col("_node"), "left").select(
                "node", F.coalesce("_child", "child").alias("child"), *((F.col(o) + F.coalesce(f"_{o}", F.lit(0))).alias(o) for o in own))
        ends = done.select(F.col("node").alias("_node"), *(F.col(o).alias(f"_{o}") for o in own))
        done = done.unionByName(links.join(ends, F.col("child") == F.col("_node")).select("node", *((F.col(o) + F.col(f"_{o}")).alias(o) for o in own)))
    return done.select("node", *(F.col(o).alias(v) for o, v in zip(own, values)))


def list_hashes(members: DataFrame) -> DataFrame:
    """Of (node: two longs, conv) the SHA-256 of each node's numbers, ascending and comma-joined, as (node, digest).

    Chunks of near numbers become strings everywhere; the strings of a node then run through one hash in order, in a stream.
    """
    chunks = members.withColumn("chunk", F.shiftright("conv", CHUNK_BITS)).groupBy("node", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (a, b):
                    if now is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = (a, b), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([h.hexdigest()])], names=["a", "b", "digest"])
    flat = chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node.a", "node.b", "ids")
    return flat.mapInArrow(run, "a long, b long, digest string").select(F.struct("a", "b").alias("node"), "digest")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    placed = materialize(turns(conversations, id_col, turn_col, role_col, text_col), "placed-turns")
    made, lengths = rebuilt(placed)
    steps, lengths = materialize(prefixes(made), "prefixes"), materialize(lengths, "lengths")
    top = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    found = steps.groupBy("node").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"))
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        top.alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("words"))
    nodes = materialize(found.unionByName(root), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("_node")).agg(F.count("*").alias("_kids"))
    tree = nodes.join(kids, F.col("node") == F.col("_node"), "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("_kids", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    tree = materialize(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "tree")
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    last = lengths.where("length > 0").join(steps.select(F.col("conv").alias("_conv"), "depth", "node"), (F.col("conv") == F.col("_conv")) & (F.col("length") == F.col("depth")))
    ends = list_hashes(last.select("node", "conv").unionByName(lengths.where("length = 0").select(top.alias("node"), "conv")))
    owners = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = hot_join(tree.drop("n_leaves", "saved_tokens"), owners, ["parent"], tree.where(F.col("n_children") > HOT).select(F.col("node").alias("parent")))
    return named.join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256"))
