"""Similarity join of documents on their sets of five-word shingles: all links of Jaccard 0.75 or more.

Documents with equal sets are one class, and a class is one node of the join. Two classes that link share at
least 0.75 of the larger set's shingles, so, in any one order of all shingles, the first shingles they have in
common are near the front of both sets. That is used twice.

Screening: in the order of hashes, a set's prefix of n - ceil(0.75 n) + m shingles has at least m in common with
the prefix of every set it links with. Tasks settle shingles that they hold twice by themselves and send only
the others, packed by ranges of hashes and at most one entry for each shingle, so frequent shingles cost no more
than rare ones. Classes with fewer shared shingles link with nothing.

Join: the classes that are left count their shingles' frequencies, and order them rare first. Shingles that one
class alone has lead that order and join with nothing, so few prefix shingles are left to join on. Pairs pass
length and positional filters in the join, and a suffix filter (how the sets spread over ranges of hashes)
before their one verification.

Near copies by the thousand would give all their pairs. Components do not need them: a round joins each prefix
shingle's classes with a few of them only, its pivots, and links merge components. A pivot has then met all that
share the shingle and leaves it; pairs inside a component need no test. Rounds go on, with more pivots each, until
no shingle has classes of two components, so every pair that passes the filters is tested or in one component.

Shingles are compared by 64-bit hashes and classes by 128 bits of fingerprints. A wrong link needs two sets that
are short of the threshold by fewer shingles than they have hashes in common by chance: for two sets of 1,000
that chance is below 1e-13. Two classes left by the screening have one 64-bit node by chance in 1e-1 of corpora
with 2e9 such classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import hand_back, id_and_text, stored
from netweave.llm.shingles import identities, in_parts, shingle_sets
from netweave.operators.components import component_labels, salted_join

#: The threshold as a fraction, and one in how many shingles a screening prefix is longer than it must be.
UP, DOWN, LONGER = 3, 4, 16
#: Document ids up to this number are broadcast (8 bytes each) to pick rows; more are joined.
BROADCAST_IDS = 2_000_000
#: Pivots of a prefix shingle in the first round, and how many times more each later round has. One is enough for copies
#: that are all near each other: each is then tested once, not with each other one, and its set is moved once.
PIVOTS, MORE = 1, 4
#: Entries that a task gathers before it hands them on, and that a range of hashes holds on average; ranges at least.
FLUSH, RANGE_ENTRIES, LEAST_RANGES = 1 << 18, 250_000, 64
#: Bytes of text for each entry of the screening, about.
BYTES_ENTRY = 18
#: Ranges of the suffix filter.
SPREAD = 64

_SCANNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("cls", pa.binary()), ("flags", pa.binary()), ("times", pa.binary())])
SCANNED = "doc_id long, n long, f long, g long, part int, keys binary, cls binary, flags binary, times binary"


def bounded(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast up to BROADCAST_IDS of them, so that the other side of a join stays where it is."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def range_bits(entries: int) -> int:
    """Bits of a hash that number its range, so that ranges hold RANGE_ENTRIES or fewer."""
    return max(LEAST_RANGES, -(-entries // RANGE_ENTRIES) - 1).bit_length()


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """Of the screening: one for the first common shingle, and slack."""
    return np.minimum(n, n - -(-UP * n // DOWN) + 1 + n // LONGER)


def ranges_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ranges that ascending hashes fall in, where each one's begin and the last one's end)."""
    part = (h >> np.uint64(64 - bits)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.empty(0, np.int64)
    return part[starts], np.append(starts, len(h))


def cut(values: np.ndarray, places: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


def short_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """What tells hashes of one range apart: the 32 bits after its number. Equal ones of two shingles only let more classes through."""
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def scan(rows: DataFrame, bits: int) -> DataFrame:
    """One pass over the texts, of two kinds of rows: (doc_id, n, f, g), size and fingerprints of each document's set;
    and, by range of hashes, the prefix shingles of the task's classes (keys, cls), those that several of them have
    (flags), and, by range of fingerprints, how many such a class has (cls, times)."""

    def batch_of(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCANNED], schema=_SCANNED)

    def packed(held: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, cls = np.concatenate(held), np.concatenate(classes)
        order = np.argsort(h)
        h, cls = h[order], cls[order]
        same = h[1:] == h[:-1]
        again = np.append(False, same) | np.append(same, False)
        alone = ~again
        part, places = ranges_of(h[alone], bits)
        yield batch_of(part=part, keys=cut(short_keys(h[alone], bits), places), cls=cut(cls[alone], places))
        shared = h[again & np.append(True, ~same)]
        part, places = ranges_of(shared, bits)
        yield batch_of(part=part, flags=cut(short_keys(shared, bits), places))
        own, times = np.unique(cls[again].view(np.uint64), return_counts=True)
        part, places = ranges_of(own, bits)
        yield batch_of(part=part, cls=cut(own, places), times=cut(times.astype("<i4"), places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, classes, size = [], [], 0
        for batch in (part for whole in batches for part in in_parts(whole)):
            own, places = shingle_sets(batch.column("text"))
            n, (f, g) = np.diff(places), identities(own, places)
            yield batch_of(doc_id=batch.column("doc_id"), n=n, f=f, g=g)
            fresh = [k for k, (x, some) in enumerate(zip(f.tolist(), n.tolist(), strict=True)) if some and x not in seen and not seen.add(x)]
            long = prefix_lengths(n[fresh])
            index = np.repeat(places[:-1][fresh] - np.cumsum(long) + long, long) + np.arange(long.sum())
            held.append(own[index])
            classes.append(np.repeat(f[fresh], long))
            size += len(index)
            if size >= FLUSH:
                yield from packed(held, classes)
                held, classes, size = [], [], 0
                seen.clear()
        if size:
            yield from packed(held, classes)
        hand_back()

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x is not None), kind)


def screened(packs: DataFrame) -> DataFrame:
    """(f, shared): by fingerprint, at least the number of a set's prefix shingles that other classes' prefixes have.

    A group is one range of hashes: each task sent it a shingle once at most, and the ranges grow in number with the corpus.
    """

    def met(table: pa.Table) -> pa.Table:
        settled = table.filter(pa.compute.is_valid(table.column("times")))
        rest = table.filter(pa.compute.is_null(table.column("times")))
        keys, cls, flags = _joined(rest, "keys", "<u4"), _joined(rest, "cls", "<i8"), np.unique(_joined(rest, "flags", "<u4"))
        order = np.lexsort((cls, keys))
        keys, cls = keys[order], cls[order]
        single = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]))[: len(keys)]
        keys, cls = keys[single], cls[single]
        same = keys[1:] == keys[:-1]
        shared = (np.append(False, same) | np.append(same, False))[: len(keys)]
        if len(flags):
            shared |= flags[np.minimum(np.searchsorted(flags, keys), len(flags) - 1)] == keys
        every = np.concatenate([cls[shared], _joined(settled, "cls", "<i8")])
        weight = np.concatenate([np.ones(int(shared.sum())), _joined(settled, "times", "<i4")])
        f, place = np.unique(every, return_inverse=True)
        hand_back()
        return pa.table({"f": f, "shared": np.bincount(place, weight, len(f)).astype(np.int64)})

    return packs.groupBy("part").applyInArrow(met, "f long, shared long").groupBy("f").agg(F.sum("shared").alias("shared"))


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, g, n, own): the shingle hashes of the documents of ``ids`` (doc_id), by fingerprint; a null among them stands for all rows without id."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole)):
            own, places = shingle_sets(batch.column("text"))
            f, g = identities(own, places)
            yield pa.RecordBatch.from_pydict({"node": f, "g": g, "n": np.diff(places), "own": pa.array(cut(own, places), pa.binary())})
        hand_back()

    wanted = ids.where("doc_id is not null").select(F.col("doc_id").alias("of")).distinct()
    found = rows.join(bounded(wanted), F.col("doc_id") == F.col("of"), "left_semi").select("text")
    if ids.where("doc_id is null").limit(1).count():
        found = found.unionByName(rows.where("doc_id is null").select("text"))
    return found.mapInArrow(listed, "node long, g long, n long, own binary")


def frequencies(sets: DataFrame) -> DataFrame:
    """(node, h, df): each class's shingles that other classes have as well, with the number of classes that have them."""
    bits = range_bits(sets.agg(F.sum("n")).first()[0] or 0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, size = [], [], 0

        def packed() -> pa.RecordBatch:
            h, node = np.concatenate(held), np.concatenate(nodes)
            order = np.argsort(h)
            part, places = ranges_of(h[order], bits)
            return pa.RecordBatch.from_pydict({"part": part, "h": pa.array(cut(h[order], places), pa.binary()), "node": pa.array(cut(node[order], places), pa.binary())})

        for batch in batches:
            for node, own in zip(batch.column("node").to_pylist(), batch.column("own").to_pylist(), strict=True):
                held.append(np.frombuffer(own, np.uint64))
                nodes.append(np.full(len(held[-1]), node, np.int64))
                size += len(held[-1])
            if size >= FLUSH:
                yield packed()
                held, nodes, size = [], [], 0
        if size:
            yield packed()
        hand_back()

    def counted(table: pa.Table) -> pa.Table:
        h, node = _joined(table, "h", "<i8"), _joined(table, "node", "<i8")
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        single = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        h, node = h[single], node[single]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        df = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
        common = df > 1
        hand_back()
        return pa.table({"node": node[common], "h": h[common], "df": df[common]})

    packs = sets.where("n > 0").select("node", "own").mapInArrow(dealt, "part int, h binary, node binary")
    return packs.groupBy("part").applyInArrow(counted, "node long, h long, df long")


def prefix_postings(sets: DataFrame) -> DataFrame:
    """(h, node, n, pos): each class's prefix in rare-first order, less the shingles that no other class has."""
    sizes = sets.select("node", "n").distinct()
    met = frequencies(sets).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common")).join(sizes, "node")
    alone = F.col("n") - F.size("common")
    left = F.col("n") - F.ceil(F.col("n") * UP / DOWN) + 1 - alone
    return met.where(left > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), left.cast("int"))).alias("i", "c")).select("c.h", "node", "n", (F.col("alone") + F.col("i")).alias("pos"))


def may_link(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    """Length and positional filters: what is left after a pair's first common shingle bounds its overlap."""
    lengths = (DOWN * n >= UP * n2) & (DOWN * n2 >= UP * n)
    needed = UP * (n + n2)
    return lengths & ((UP + DOWN) * F.least(n - pos, n2 - pos2) >= needed)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (x, y) that link."""

    @F.pandas_udf("boolean")
    def links(first: pd.Series, second: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(first, second, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            need = -(-UP * (len(a) + len(b)) // (UP + DOWN))
            spread = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=SPREAD) for s in (a, b)]
            out.append(bool(np.minimum(*spread).sum() >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need))
        return pd.Series(out)

    ids = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    needed = sets.join(bounded(ids), "node", "left_semi")
    left, right = needed.select(F.col("node").alias("x"), F.col("own").alias("a")), needed.select(F.col("node").alias("y"), F.col("own").alias("b"))
    return pairs.join(left, "x").join(right, "y").where(links("a", "b")).select("x", "y")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after the components that ``links`` (x, y) connect have become one, named by their least."""
    at = labels.select(F.col("node").alias("v"), "comp")
    ends = links.join(at.select(F.col("v").alias("x"), F.col("comp").alias("a")), "x").join(at.select(F.col("v").alias("y"), F.col("comp").alias("b")), "y").where("a <> b")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    edges = stored(ends.select(both).select("e.*").distinct())
    if not edges.limit(1).count():
        return labels
    names = component_labels(edges).select(F.col("node").alias("comp"), "component")
    return stored(salted_join(labels, names, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")))


def components(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, comp) of every class that has prefix rows."""
    labels = stored(postings.select("node").distinct().select("node", F.col("node").alias("comp")))
    tested, pivots = None, PIVOTS
    while True:
        now = stored(postings.join(labels, "node")) if tested is not None else postings.withColumn("comp", F.col("node"))
        several = stored(now.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("h"))
        now = stored(now.join(several, "h", "left_semi"))  # shingles all of whose classes are in one component are done
        if not now.limit(1).count():
            return labels
        lot = F.xxhash64("node", F.lit(pivots))
        slots = now.groupBy("h", F.pmod(lot, F.lit(pivots)).alias("slot")).agg(F.min_by(F.struct(F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2")), lot).alias("p"))
        chosen = stored(slots.select("h", "p.*"))
        met = now.join(chosen, "h").where("comp <> comp2").where(may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
        pairs = met.select(F.least("node", "node2").alias("x"), F.greatest("node", "node2").alias("y")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        postings = now.drop("comp").join(chosen.select("h", F.col("node2").alias("node")), ["h", "node"], "left_anti")
        labels = merged(labels, stored(verified(pairs, sets)))
        pivots *= MORE


def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed(doc_id, n, f, g), a row for each of ``rows``; named(f, g, n, root, component_id), a row for each class)."""
    entries = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_ENTRY
    scanned = stored(scan(rows, range_bits(entries)))
    signed = scanned.where("part is null").select("doc_id", "n", "f", "g")
    classes = stored(signed.where("n > 0").groupBy("f", "g", "n").agg(F.min("doc_id").alias("doc_id")))
    smaller = F.ceil(F.col("n") * UP / DOWN)
    survivors = classes.join(screened(scanned.where("part is not null").select("part", "keys", "cls", "flags", "times")), "f").where(F.col("shared") >= 1 + F.floor(smaller / LONGER))
    sets = stored(sets_of(rows, stored(survivors.select("doc_id"))))
    labels = components(stored(prefix_postings(sets)), sets)
    nodes = sets.select("node", "g", "n").distinct().join(labels, "node")
    inside = stored(classes.join(nodes.withColumnRenamed("node", "f"), ["f", "g", "n"]).select("f", "g", "n", "doc_id", F.col("comp").alias("root")))
    least = inside.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = salted_join(inside.select("f", "g", "n", "root"), least, "root")
    alone = classes.join(inside.select("f", "g", "n"), ["f", "g", "n"], "left_anti").select("f", "g", "n", F.col("f").alias("root"), F.col("doc_id").alias("component_id"))
    return signed, stored(named.select("f", "g", "n", "root", "component_id").unionByName(alone))


def link_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Null and wordless texts have no shingles and stand alone. Rows that share an id are documents of their own, each
    linked by its own text; a null id takes the least id of its component. Very long texts are one set each, of 8 bytes a shingle. Repeated rows give a row each. Only
    doc_id and text are read, whatever other columns are called; an empty table gives no rows.
    """
    signed, named = linked(id_and_text(docs))
    found = signed.where("n > 0").join(named.drop("n"), ["f", "g"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every component: that of least id, and of those the one whose set has the least fingerprint.

    Documents without words stay, each. Ids tell which rows go; rows whose id is null or not theirs alone are told by
    their text as well. The ids that go are broadcast up to BROADCAST_IDS of them, and joined beyond.
    """
    signed, named = linked(id_and_text(docs))
    each = signed.where("n > 0").join(named.drop("n"), ["f", "g"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "f", "g")).alias("first")
    chosen = stored(each.groupBy("root").agg(first).select("first.doc_id", "first.f", "first.g"))
    gone = signed.where("n > 0").select("doc_id").distinct().join(chosen.select("doc_id"), "doc_id", "left_anti")
    shared = stored(signed.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("_shared")))
    gone = stored(gone.where("doc_id is not null").select(F.col("doc_id").alias("_gone")).join(shared, F.col("_gone") == F.col("_shared"), "left_anti"))

    kept = docs.join(bounded(gone), docs["doc_id"] == gone["_gone"], "left_anti")
    if not shared.limit(1).count():
        return kept

    @F.pandas_udf("n long, f long, g long")
    def signature(texts: pd.Series) -> pd.DataFrame:
        own, places = shingle_sets(pa.array(texts, pa.string()))
        f, g = identities(own, places)
        return pd.DataFrame({"n": np.diff(places), "f": f, "g": g})

    side = bounded(shared)
    told = docs["doc_id"].eqNullSafe(side["_shared"])
    rows = docs.join(side, told, "left_semi").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"), signature(docs["text"]).alias("_set"))
    own = chosen.select(F.struct("doc_id", "f", "g").alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_key.doc_id")) & (F.col("_set.f") == F.col("_key.f")) & (F.col("_set.g") == F.col("_key.g"))
    once = rows.where("_set.n > 0").join(own, same, "left_semi").dropDuplicates(["_id", "_set"])
    back = once.unionByName(rows.where("_set.n = 0")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return kept.join(side, told, "left_anti").unionByName(back)
