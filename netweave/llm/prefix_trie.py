"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A conversation's turns are numbered, cut into nodes and folded without ever gathering a conversation or a node's
members in one task: rows are sorted by ranges, each task folds its own rows, and what a conversation has gathered in
earlier ranges is added afterwards. A prefix is known by its depth and 128 bits, the exclusive or of two hashes of each
of its turns with their places; that two of n prefixes of one depth fall together by chance is n^2 / 2^129.

Defined cases: rows without conv_id take no part; a null role or text is empty. Equal turns of a conversation come in
the order of role and of the text's hash; repeated rows are turns each. Texts of any length are hashed and counted whole.
An empty table has no nodes, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.common import stored

#: Conversations of so many consecutive ids share a base; at most SHARED - 1 turns are taken from it.
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, order: list[str], sums: dict[str, str], xors: dict[str, str]) -> DataFrame:
    """``rows`` with running sums and exclusive ors (name: column) inside each ``conv``, in ``order``, the own row included.

    Rows are dealt by ranges, so that a conversation of any length is spread over tasks.
    """
    folds = {**{n: (c, np.cumsum, np.add, np.subtract) for n, c in sums.items()}, **{n: (c, np.bitwise_xor.accumulate, np.bitwise_xor, np.bitwise_xor) for n, c in xors.items()}}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(conv)]))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for name, (column, accumulate, join, part_from) in folds.items():
                value = batch.column(column).to_numpy()
                total = accumulate(value)
                total = part_from(total, part_from(total[start], value[start])[run])
                if conv[0] == last:
                    total[run == 0] = join(total[run == 0], carried[name])
                carried[name] = total[-1]
                columns[name] = pa.array(total, pa.int64())
            last = conv[-1]
            columns["part"] = pa.array(np.full(len(conv), part), pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} long" for n in folds] + ["part long"]
    done = stored(rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).mapInArrow(fold, ", ".join(names)))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = done.groupBy("conv", "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.bit_xor(c).alias(n) for n, c in xors.items()])
    earlier = each.select("conv", "part", F.count("*").over(Window.partitionBy("conv")).alias("parts"), *[F.sum(n).over(before).alias(f"_{n}") for n in sums], *[F.bit_xor(n).over(before).alias(f"_{n}") for n in xors])
    cut = F.broadcast(earlier.where("parts > 1").drop("parts"))  # conversations that cross a border: at most two rows a task
    zero = lambda n: F.coalesce(f"_{n}", F.lit(0))
    whole = {**{n: F.col(n) + zero(n) for n in sums}, **{n: F.col(n).bitwiseXOR(zero(n)) for n in xors}}
    return done.join(cut, ["conv", "part"], "left").select(*rows.columns, *[c.alias(n) for n, c in whole.items()])


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, d, a, b, words, length) of every rebuilt turn, (conv, length) of every conversation).

    A conversation starts with the first h turns of its family's first one and goes on with its own turns after the
    first h; h is the id's checksum modulo SHARED. ``a`` and ``b`` are hashes of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    placed = stored(running(turns, ["turn", "role", "a", "b"], {"place": "one"}, {}).select("conv", "place", "a", "b", "words"))
    sizes = placed.groupBy("conv").agg(F.count("*").alias("own"))
    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    told = sizes.select("conv", "own", base, (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h"))
    first = sizes.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plans = stored(told.join(first, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    starts = placed.where((F.col("conv") % FAMILY == 0) & (F.col("place") < SHARED)).withColumnRenamed("conv", "base")  # read by FAMILY conversations at most
    given = plans.where("taken > 0").join(starts, "base").where("place <= taken").select("conv", F.col("place").alias("d"), "a", "b", "words", "length")
    own = placed.join(plans, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), "a", "b", "words", "length")
    return given.unionByName(own), plans.select("conv", "length")


def digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ends_sha256) of (key..., conv): the hash of a key's ids, ascending, comma-joined.

    Ids are sorted by ranges and joined to strings there; the task of a key hashes these one after the other, so that
    it never holds more than one.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, ids = list(zip(*[batch.column(k).to_pylist() for k in key], strict=True)), batch.column("conv").to_pylist()
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            rows = [(*keys[i], part, seq + i, ",".join(map(str, ids[i:j]))) for i, j in zip(edges, edges[1:], strict=False) if i < j]
            seq += len(keys)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*key, "part", "seq", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *own, ids in zip(*[batch.column(k).to_pylist() for k in [*key, "ids"]], strict=True):
                if own == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = own, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*key, "ends_sha256"])

    kinds = ", ".join(f"{k} long" for k in key)
    joined = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(chunks, f"{kinds}, part long, seq long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "part", "seq").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def chains(rest: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """((node, child, values...) of the nodes inside chains, (node, above, up_ values...) of the nodes below chains).

    A chain is a run of nodes with one child each, below a root. Links jump twice as far each round, until each node of a
    chain knows the first node below the chain, its ``child``, and the sums on the way there, its own included; its total
    is these sums and that node's total. Below the chain's upper end that node comes with the sums of the whole chain.
    """
    one = rest.where("kids = 1 and parent is not null")
    below = rest.select(F.col("parent").alias("node"), F.col("node").alias("child"), (F.col("kids") == 1).alias("open"), *[F.col(f"up_{v}").alias(f"below_{v}") for v in values])
    links = stored(one.join(below, "node").select("node", "child", "open", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]))
    while links.where("open").limit(1).count():
        further = links.select(F.col("node").alias("child"), F.col("child").alias("far"), F.col("open").alias("far_open"), *[F.col(v).alias(f"far_{v}") for v in values])
        jumped = links.join(further, "child", "left")
        links = stored(jumped.select("node", F.coalesce("far", "child").alias("child"), F.coalesce("far_open", F.lit(False)).alias("open"), *[(F.col(v) + F.coalesce(f"far_{v}", F.lit(0))).alias(v) for v in values]))
    upper = one.join(one.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.col("parent").alias("above"), *[f"up_{v}" for v in values])
    ends = links.join(upper, "node").select(F.col("child").alias("node"), "above", *[(F.col(v) + F.col(f"up_{v}")).alias(f"add_{v}") for v in values])
    return links.drop("open"), ends


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, values...) of a forest (node, parent or null, values...): sums over each node's subtree, itself included.

    Tree contraction: each round rakes the leaves, which hand their sums to their parents, and compresses the chains that are
    left. After it every node but roots has two children or more, so that the next rake takes half of the nodes; rounds
    grow with the logarithm of the nodes, whatever the depth. Sums on the way up past compressed nodes are kept beside a node (``up_``). Then the compressed
    nodes come back, last round first.
    """
    up = [f"up_{v}" for v in values]
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    alive = stored(tree.join(kids, "node", "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *[F.lit(0).cast("long").alias(u) for u in up]))
    found, compressed = None, []
    while True:
        raked = alive.where("kids = 0")
        own = raked.select("node", *values)
        found = own if found is None else found.unionByName(own)
        handed = raked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(u)).alias(f"got_{v}") for v, u in zip(values, up, strict=True)])
        grown = [(F.col(v) + F.coalesce(f"got_{v}", F.lit(0))).alias(v) for v in values]
        rest = stored(alive.where("kids > 0").join(handed, "node", "left").select("node", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *grown, *up))
        if not rest.limit(1).count():
            break
        links, ends = chains(rest, values)
        compressed.append(links)
        left = rest.where("kids <> 1 or parent is null").join(ends, "node", "left")
        alive = stored(left.select("node", F.coalesce("above", "parent").alias("parent"), "kids", *values, *[F.coalesce(f"add_{v}", u).alias(u) for v, u in zip(values, up, strict=True)]))
    for gone in reversed(compressed):
        below = found.select(F.col("node").alias("child"), *[F.col(v).alias(f"below_{v}") for v in values])
        back = stored(gone.join(below, "child").select("node", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]))
        found = found.unionByName(back)
    return found


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct start of rebuilt conversations, the empty one included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (words that sharing its subtree's turns saves), ends_sha256 (hash of the members that end here).
    """
    turns, lengths = rebuilt_turns(conversations)
    hashed = turns.select("conv", "d", "words", "length", F.xxhash64("d", "a").alias("x1"), F.xxhash64("d", "b").alias("x2"))
    starts = stored(running(hashed, ["d"], {}, {"k1": "x1", "k2": "x2"}))
    over = lambda k, x: F.col(k).bitwiseXOR(F.col(x))
    inner = starts.groupBy("d", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min(over("k1", "x1")).alias("p1"), F.min(over("k2", "x2")).alias("p2"), F.min("words").alias("words"))
    none = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(none.alias("d"), none.alias("k1"), none.alias("k2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), none.alias("words"))
    nodes = stored(inner.unionByName(root))
    ends = starts.where("d = length").select("d", "k1", "k2", "conv").unionByName(lengths.where("length = 0").select(none.alias("d"), none.alias("k1"), none.alias("k2"), "conv"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(above, ["d", "p1", "p2"], "left").join(digests(ends, ["d", "k1", "k2"]), ["d", "k1", "k2"], "left")
    name = lambda depth, conv: F.struct(depth.alias("depth"), conv.alias("conv"))
    parent = F.when(F.col("d") > 0, name(F.col("d") - 1, F.col("parent_conv_id")))
    linked = stored(linked.select(name(F.col("d"), F.col("conv_id")).alias("node"), parent.alias("parent"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), "ends_sha256"))
    children = linked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = stored(linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(tree.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), "saved_tokens"), ["n_leaves", "saved_tokens"])
    done = tree.drop("saved_tokens").join(totals, "node")
    return done.select(F.col("node.conv").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("parent.conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
