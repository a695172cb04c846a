"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  A prefix is known by its depth
and the exclusive-or of 120 hash bits of its (position, turn) pairs, which a
scan gives for conversations of any length.  Every node has an enter and an
exit arc; the tour's links come from one ordered scan over families (a parent
followed by its children), the tour is ranked as a linked list
(``list_ranking``), and what lies between a node's two arcs is its subtree:
leaves and savings are differences of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.llm import list_ranking
from feedspark.llm.common import materialize
from feedspark.operators.numbering import number_rows
from feedspark.operators.scan import scan

CHUNK = 1 << 16                            # turns of one conversation that one window sees
HUNDRED, MOST_SHARED = 100, 6              # conversations with a common head, and the head's turns: fewer than this
KEY = ("depth", "x1", "x2")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the one its hundred begins with."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, and code points of the text: turns in order, nulls first.

    Turns of the same number come in the order of their digests.  Rows
    without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.char_length(text).cast("bigint").alias("size"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))
    return number_rows(turns, ["conv_id"], ["turn", "digest"]).drop("turn")


def rebuilt_turns(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth (from 1), digest, size, is_end: the rebuilt conversations, row by row.

    ``convs``: conv_id, n_own, lead (turns from the hundred's first), h.
    """
    # own turns: a conversation's row goes once to every chunk of its turns, so none of them is hot
    per_chunk = convs.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n_own - 1) div {chunk})")))
    own = turns.where(F.col("pos") >= shared_turns(F.col("conv_id"))).withColumn("chunk", F.expr(f"pos div {chunk}"))
    own = own.join(per_chunk, ["conv_id", "chunk"]).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lead") + 1).alias("depth"), "digest", "size", (F.col("pos") == F.col("n_own") - 1).alias("is_end"))
    first = turns.where(F.col("pos") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    shared = convs.where("lead > 0").join(first, "base").where("pos < lead").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "digest", "size", ((F.col("n_own") <= F.col("h")) & (F.col("pos") == F.col("lead") - 1)).alias("is_end"))
    return own.unionByName(shared)


def conversation_heads(turns: DataFrame) -> DataFrame:
    """conv_id, n_own, base (the hundred's first), h, lead = the turns that the base has for it."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    convs = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % HUNDRED, "h": shared_turns(F.col("conv_id"))})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    return convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base")


def prefixes(rebuilt: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rebuilt`` with x1, x2 (the prefix up to the row, with its depth) and p1, p2 (the prefix before it)."""
    mark = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    term = lambda a: F.conv(F.substring("mark", a, 15), 16, 10).cast("bigint")
    rows = rebuilt.withColumn("mark", mark).withColumns({"t1": term(1), "t2": term(16), "chunk": F.expr(f"depth div {chunk}")}).drop("mark", "digest")
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("o1"), F.bit_xor("t2").alias("o2"))
    chunks = chunks.withColumns({c: F.coalesce(F.bit_xor(c).over(across), F.lit(0)) for c in ("o1", "o2")}).where("chunk > 0")
    rows = rows.withColumns({f"x{k}": F.bit_xor(f"t{k}").over(within) for k in (1, 2)}).join(chunks, ["conv_id", "chunk"], "left")
    rows = rows.withColumns({f"x{k}": F.col(f"x{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))) for k in (1, 2)})
    return rows.withColumns({f"p{k}": F.col(f"x{k}").bitwiseXOR(F.col(f"t{k}")) for k in (1, 2)}).drop("t1", "t2", "o1", "o2", "chunk")


def end_hashes(ends: DataFrame) -> DataFrame:
    """KEY and SHA-256 of the conv_ids that end there, ascending and comma-joined.

    Ids are joined to short strings where the sort leaves them; one pass then
    feeds a node's strings, in order, to its hash, and holds none of them.
    """
    key = list(KEY)
    kinds = "depth bigint, x1 bigint, x2 bigint"

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.groupby(key, sort=False)["conv_id"].agg(first="min", ids=lambda c: ",".join(map(str, c))).reset_index()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            done = []
            for *k, _, ids in b.itertuples(index=False):
                if k != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*key, "ends_sha256"])

    pieces = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInPandas(join, f"{kinds}, first bigint, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(digest, f"{kinds}, ends_sha256 string")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, arcs) of nodes with node_id, conv_id, KEY, p1, p2, gain.

    ``links``: node_id of every node but the root with parent_id and
    parent_conv_id.  ``arcs``: the Euler tour as a linked list, enter 2 *
    node_id and exit 2 * node_id + 1, children by their conv_id, with the
    weights one, leaf (1 where a childless node is entered) and gain.
    """
    own = nodes.select("node_id", "conv_id", "gain", *KEY, F.lit(0).alias("kind"))
    child = nodes.where("depth > 0").select("node_id", "conv_id", F.lit(0).cast("bigint").alias("gain"), (F.col("depth") - 1).alias("depth"),
                                            F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.lit(1).alias("kind"))
    family = scan(own.unionByName(child), KEY, ["kind", "conv_id"], carry=F.when(F.col("kind") == 0, F.struct("node_id", "conv_id")),
                  follow=F.col("node_id"))
    family = materialize(family.withColumnsRenamed({"carried": "parent", "following": "then"}), "families")
    enter, leave = (lambda c: c * 2), (lambda c: c * 2 + 1)
    node, zero, one = F.col("node_id"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    then = F.col("then")
    entering = family.where("kind = 0").select(
        enter(node).alias("id"), F.coalesce(enter(then), leave(node)).alias("next"), then.isNull().cast("bigint").alias("leaf"), "gain")
    leaving = family.where("kind = 1").select(
        leave(node).alias("id"), F.coalesce(enter(then), leave(F.col("parent.node_id"))).alias("next"), zero.alias("leaf"), zero.alias("gain"))
    end = family.where("kind = 0 and depth = 0").select(leave(node).alias("id"), F.lit(-1).cast("bigint").alias("next"), zero.alias("leaf"), zero.alias("gain"))
    links = family.where("kind = 1").select("node_id", F.col("parent.node_id").alias("parent_id"), F.col("parent.conv_id").alias("parent_conv_id"))
    return links, entering.unionByName(leaving).unionByName(end).withColumn("one", one)


def build(conversations: DataFrame, chunk: int = CHUNK, block: int = list_ranking.BLOCK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and the positions of its arcs in the tour (enter_at, exit_at).

    ``conversations``: conv_id, turn, role, text; other columns are not looked
    at.  Turns are ordered by turn, null first, ties by a digest of role and
    text; null roles and texts count as empty; repeated rows are turns of
    their own.  Rows without conv_id belong to none.  The root has a null
    parent; an empty table has no conversation and gives no node.
    """
    turns = materialize(ordered_turns(conversations), "turns")
    convs = materialize(conversation_heads(turns), "convs")
    rows = materialize(prefixes(rebuilt_turns(turns, convs, chunk), chunk), "prefixes")
    zero = F.lit(0).cast("bigint")
    top = convs.select(*[zero.alias(c) for c in (*KEY, "p1", "p2", "size")], "conv_id")
    nodes = rows.select(*KEY, "p1", "p2", "size", "conv_id").unionByName(top).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = nodes.withColumn("gain", (F.col("n_convs") - 1) * F.col("size")).drop("size")
    # numbered along conversations, as the tour mostly goes
    nodes = materialize(nodes.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
                        .withColumn("node_id", F.monotonically_increasing_id()), "nodes")
    links, arcs = tour(nodes)
    ranked = list_ranking.rank_list(materialize(arcs, "arcs"), ["one", "leaf", "gain"], block)

    none = F.lit(None).cast("bigint")
    facts = ranked.select(F.expr("id div 2").alias("node_id"), "before_one", "before_leaf", "before_gain", none.alias("parent_conv_id"), none.alias("child"))
    facts = facts.unionByName(links.select("node_id", *[none.alias(f"before_{w}") for w in ("one", "leaf", "gain")], "parent_conv_id", none.alias("child")))
    facts = facts.unionByName(links.select(F.col("parent_id").alias("node_id"), *[none.alias(f"before_{w}") for w in ("one", "leaf", "gain")],
                                           none.alias("parent_conv_id"), F.lit(1).cast("bigint").alias("child")))
    between = lambda c: F.max(c) - F.min(c)
    facts = facts.groupBy("node_id").agg(
        F.min("before_one").alias("enter_at"), F.max("before_one").alias("exit_at"), between("before_leaf").alias("n_leaves"),
        between("before_gain").alias("saved_tokens"), F.max("parent_conv_id").alias("parent_conv_id"), F.count("child").alias("n_children"))
    turnless = convs.where("lead = 0 and n_own <= h").select(*[zero.alias(c) for c in KEY], "conv_id")
    ends = end_hashes(rows.where("is_end").select(*KEY, "conv_id").unionByName(turnless))
    out = nodes.join(facts, "node_id").join(ends, list(KEY), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "enter_at", "exit_at")
