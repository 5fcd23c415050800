"""Language-model scores by context-tree weighting.

A text is its words in lower case with one space between them and an end byte. Each byte is eight binary
decisions; a decision's contexts are the bits before it in its byte and the 0 to ``order`` bytes before that. Every
such context estimates its next bit by Krichevsky and Trofimov's rule, and the tree weights mix the estimates of
all depths. The counts come from the training documents; scoring changes them no more. Where a path leaves the
contexts that training has seen, its deepest seen context decides alone.

A byte's probability depends on the ``order`` bytes before it and on nothing else, so the corpus gives one table of
(order + 1)-byte grams with their log probabilities: Spark counts the grams of all documents (those that only
held-out documents have count 0), sums the counts up the tree, and carries the mixture down again. Levels up to
ORDER are joins; below it the subtrees of whole ORDER-byte contexts are dealt to tasks. Texts then look up their
grams: the most frequent ones in a broadcast table, and the others, which are many but occur seldom, by a join. The base score is an add-0.1 unigram of words: frequent words are looked up in a broadcast
table of fixed size, all others are joined by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import hand_back, id_and_text, stored

#: Bytes of the contexts that plans alone handle, and the default; the query goes to DEEP. MOST fits a gram in a long.
ORDER, DEEP, MOST, FOLDS = 3, 6, 6, 10
#: The most frequent words, which are broadcast; all others are joined.
HEAD_WORDS = 50_000
#: The most frequent grams that are broadcast (12 bytes each); all others are joined. A whole table at ORDER is a matrix of up to so many cells (4 bytes each).
BROADCAST_GRAMS, BROADCAST_CELLS = 6_000_000, 32_000_000
#: Grams of a task of the deep levels, on average.
SHARD_GRAMS = 100_000
#: Entries after which a counting task hands on what it holds, and rows that it hands on at once.
FLUSH_WORDS, FLUSH_GRAMS, HANDED = 300_000, 2_000_000, 100_000
#: Grams, or rows of a table, that are looked at in one step.
STEP = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def grams(own: list[bytes], order: int = ORDER) -> np.ndarray:
    """The (order + 1)-byte grams of a text, each as a number whose last byte is the one that is predicted."""
    return _grams(np.frombuffer(b"\n" * order + b" ".join(own) + b"\n", np.uint8), order)


def _grams(raw: np.ndarray, order: int) -> np.ndarray:
    raw = raw.astype(np.int64)
    total = raw[: len(raw) - order].copy()
    for k in range(1, order + 1):
        total = total << 8 | raw[k : len(raw) - order + k]
    return total


def grams_in_steps(own: list[bytes], order: int) -> Iterator[np.ndarray]:
    """As grams, STEP of them at once, so that a long text's memory is a few times its bytes."""
    raw = np.frombuffer(b"\n" * order + b" ".join(own) + b"\n", np.uint8)
    for begin in range(0, len(raw) - order, STEP):
        yield _grams(raw[begin : begin + STEP + order], order)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending, the sum of each one's times)."""
    turn = np.argsort(keys)
    keys, times = keys[turn], times[turn]
    del turn
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): grams of all documents, with their occurrences in training documents."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, times, size = [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0

        def handed(keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
            for begin in range(0, len(keys), HANDED):
                yield pd.DataFrame({"gram": keys[begin : begin + HANDED], "n": n[begin : begin + HANDED]})

        for batch in batches:
            for train in (True, False):
                for t in batch["text"][batch["held_out"] != train]:
                    for found in grams_in_steps(words(t), order):
                        held.append(found)
                        times.append(np.full(len(found), train, np.int32))
                        size += len(found)
                        if size > FLUSH_GRAMS:
                            keys, n = summed(np.concatenate(held), np.concatenate(times))
                            held, times, size = [keys], [n], len(keys)
                            if size > FLUSH_GRAMS // 2:
                                yield from handed(keys, n)
                                held, times, size = [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
        yield from handed(*summed(np.concatenate(held), np.concatenate(times)))
        hand_back()

    return rows.select("text", "held_out").mapInPandas(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c): words of the training documents."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                own.update(words(t))
            if len(own) > FLUSH_WORDS:
                yield pd.DataFrame({"word": list(own.keys()), "c": list(own.values())})
                own.clear()
        yield pd.DataFrame({"word": list(own.keys()), "c": list(own.values())})
        hand_back()

    return rows.where("not held_out").select("text").mapInPandas(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of the recurrence; x >= 0.5."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """As log_gamma."""
    y, product = x + 8, x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


class Subtrees:
    """The levels ORDER to ``order`` of the tree over some grams, which have all grams of each of their ORDER-byte contexts.

    A level's rows are its grams in order, so that the nodes of each of the eight decisions are runs of rows.
    Levels below ORDER are left out where only its own nodes are asked for (``whole`` False), which bounds the memory.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, whole: bool = True):
        place = np.argsort(keys)
        self.order, self.place, self.keys, self.up, self.nodes = order, place, {order: keys[place]}, {}, {}
        n, below = n[place].astype(float), None
        for depth in range(order, ORDER - 1, -1):
            if depth < order:
                self.keys[depth], self.up[depth + 1] = np.unique(self.keys[depth + 1] & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
                self.up[depth + 1] = self.up[depth + 1].astype(np.int32)
                if depth + 1 < order:
                    del self.keys[depth + 1]
                n = np.bincount(self.up[depth + 1], n, len(self.keys[depth]))
            for j in range(8):
                node = self.keys[depth] >> (8 - j)
                first = np.concatenate([[True], node[1:] != node[:-1]])
                starts, ids = np.flatnonzero(first).astype(np.int32), np.cumsum(first, dtype=np.int32) - np.int32(1)
                total, b = np.add.reduceat(n, starts), np.add.reduceat(n * (self.keys[depth] >> (7 - j) & 1), starts)
                log_e = _log_gamma(total - b + 0.5) + _log_gamma(b + 0.5) - _log_gamma(total + 1.0) - np.log(np.pi)
                log_w, own = log_e, np.ones(len(log_e))
                if depth < order:
                    child = self.nodes[depth + 1, j] if whole else self.nodes.pop((depth + 1, j))
                    below = np.bincount(ids[self.up[depth + 1][child["starts"]]], child["log_w"], len(starts))
                    log_w = np.logaddexp(below, log_e) - np.log(2.0)
                    own = 1 / (1 + np.exp(np.minimum(below - log_e, 700)))
                    del child["log_w"], child["log_e"]
                self.nodes[depth, j] = {"starts": starts, "ids": ids, "a": total - b, "b": b, "log_w": log_w, "log_e": log_e, "own": own}

    def _named(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.keys[ORDER][self.nodes[ORDER, j]["starts"]]
        return at >> 8, 1 << j | (at & 0xFF) >> (8 - j)

    def top(self) -> pd.DataFrame:
        """(ctx, p, a, b, log_e, log_w, own) of the nodes at ORDER."""
        each = []
        for j in range(8):
            ctx, p = self._named(j)
            each.append(pd.DataFrame({"ctx": ctx, "p": p, **{k: self.nodes[ORDER, j][k] for k in ("a", "b", "log_e", "log_w", "own")}}))
        return pd.concat(each)

    def scores(self, above: pd.DataFrame) -> np.ndarray:
        """log10 of each gram's probability, from (ctx, p, mix, rest, p1) at ORDER."""
        named = (above["ctx"].to_numpy() << 8) | above["p"].to_numpy()
        turn = np.argsort(named)
        columns = [above[c].to_numpy()[turn] for c in ("mix", "rest", "p1")]
        found = np.zeros(len(self.place))
        for j in range(8):
            ctx, p = self._named(j)
            mix, rest, p1 = (c[np.searchsorted(named[turn], ctx << 8 | p)] for c in columns)
            for depth in range(ORDER + 1, self.order + 1):
                x = self.nodes[depth, j]
                up = self.nodes[depth - 1, j]["ids"][self.up[depth][x["starts"]]]
                kt, mix, rest = (x["b"] + 0.5) / (x["a"] + x["b"] + 1.0), mix[up], rest[up]
                p1 = np.where(x["a"] + x["b"] > 0, mix + rest * kt, p1[up])
                mix, rest = mix + rest * x["own"] * kt, rest * (1 - x["own"])
            ones = p1[self.nodes[self.order, j]["ids"]]
            found += np.log10(np.where(self.keys[self.order] >> (7 - j) & 1, ones, 1 - ones))
        out = np.empty(len(found))
        out[self.place] = found
        return out


def gram_scores(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, log_p): log10 of the mixture's probability of each gram's last byte after the bytes before it, beside its count."""
    if order > ORDER:
        return _deep_scores(counted, order)
    x = F.col("gram").bitwiseAND(0xFF)

    steps = [F.struct((F.lit(1 << j) + F.shiftright(x, 8 - j)).cast("int").alias("p"), F.shiftright(x, 7 - j).bitwiseAND(1).cast("int").alias("bit")) for j in range(8)]
    decided = counted.select("gram", "n", F.shiftright("gram", 8).alias("ctx"), F.explode(F.array(*steps)).alias("d")).select("gram", "n", "ctx", "d.p", "d.bit")
    log_kt = log_gamma(F.col("a") + 0.5) + log_gamma(F.col("b") + 0.5) - log_gamma(F.col("a") + F.col("b") + 1.0) - float(np.log(np.pi))
    level = decided.groupBy("ctx", "p").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("a"), F.sum(F.col("n") * F.col("bit")).alias("b"))
    top = _carried(stored(level.withColumn("log_e", log_kt).withColumn("log_w", F.col("log_e")).withColumn("own", F.lit(1.0))))
    chosen = F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    return decided.select("gram", "n", "ctx", "p", "bit").join(top.select("ctx", "p", "p1"), ["ctx", "p"]).groupBy("gram").agg(F.first("n").alias("n"), F.sum(F.log10(chosen)).alias("log_p"))


def _deep_scores(counted: DataFrame, order: int) -> DataFrame:
    """gram_scores by shards of whole ORDER-byte contexts: weights up to ORDER, joins above it, and down again."""
    shards = max(1, -(-counted.count() // SHARD_GRAMS))
    shard = lambda ctx: F.pmod(F.hash(ctx), F.lit(shards))
    dealt = counted.select("gram", "n", shard(F.shiftright("gram", 8).bitwiseAND((1 << 8 * ORDER) - 1)).alias("shard")).repartition(shards, "shard")

    def weighted(group: pd.DataFrame) -> pd.DataFrame:
        found = Subtrees(group["gram"].to_numpy(), group["n"].to_numpy(), order, whole=False).top()
        hand_back()
        return found

    def scored(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        tree = Subtrees(group["gram"].to_numpy(), group["n"].to_numpy(), order)
        found = pd.DataFrame({"gram": group["gram"].to_numpy(), "n": group["n"].to_numpy(), "log_p": tree.scores(above)})
        del tree
        hand_back()
        return found

    level = stored(dealt.groupBy("shard").applyInPandas(weighted, "ctx long, p int, a double, b double, log_e double, log_w double, own double"))
    above = _carried(level).select("ctx", "p", "mix", "rest", "p1", shard(F.col("ctx")).alias("shard")).repartition(shards, "shard")
    return dealt.groupBy("shard").cogroup(above.groupBy("shard")).applyInPandas(scored, "gram long, n long, log_p double")


def _carried(level: DataFrame) -> DataFrame:
    """(ctx, p, mix, rest, p1) at ORDER, from its (ctx, p, a, b, log_e, log_w, own)."""
    log_kt = log_gamma(F.col("a") + 0.5) + log_gamma(F.col("b") + 0.5) - log_gamma(F.col("a") + F.col("b") + 1.0) - float(np.log(np.pi))
    levels = [level]
    for depth in range(ORDER - 1, -1, -1):
        up = level.groupBy(F.col("ctx").bitwiseAND((1 << 8 * depth) - 1).alias("ctx"), "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log_w").alias("below"))
        gap = F.col("below") - F.col("log_e")
        level = up.withColumn("log_e", log_kt).withColumn("log_w", F.greatest("below", "log_e") + F.log1p(F.exp(-F.abs(gap))) - float(np.log(2.0))).withColumn("own", 1 / (1 + F.exp(gap))).drop("below")
        level = stored(level)
        levels.append(level)
    kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    seen = F.col("a") + F.col("b") > 0
    passed = ("ctx", "p", "mix", "rest", "p1")
    top = levels[-1].withColumn("p1", kt).withColumn("mix", F.col("own") * kt).withColumn("rest", 1 - F.col("own")).select(*passed)
    for depth in range(1, ORDER + 1):
        up = top.select(F.col("ctx").alias("up"), F.col("p").alias("q"), F.col("mix").alias("mix0"), F.col("rest").alias("rest0"), F.col("p1").alias("p0"))
        joined = levels[ORDER - depth].join(up, (F.col("ctx").bitwiseAND((1 << 8 * (depth - 1)) - 1) == F.col("up")) & (F.col("p") == F.col("q")))
        top = joined.select("ctx", "p", (F.col("mix0") + F.col("rest0") * F.col("own") * kt).alias("mix"), (F.col("rest0") * (1 - F.col("own"))).alias("rest"), F.when(seen, F.col("mix0") + F.col("rest0") * kt).otherwise(F.col("p0")).alias("p1"))
    return top


class DeepTable:
    """Gram scores in the order of their mixed keys, with the first place of each range of these."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, mixed: np.ndarray, log_p: np.ndarray, order: int):
        self.mixed, self.log_p, self.order = mixed, log_p, order
        bits = max(1, len(mixed).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        for begin in range(0, len(mixed), STEP):
            ids = (mixed[begin : begin + STEP] >> self.shift).astype(np.int64)
            self.first[ids[0] + 1 : ids[-1] + 2] += np.bincount(ids - ids[0]).astype(np.int32)
        np.cumsum(self.first, out=self.first)

    @classmethod
    def laid_out(cls, keys: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys.astype(np.uint64) * cls.FACTOR
        turn = np.argsort(mixed)
        return mixed[turn], log_p[turn]

    def score(self, own: list[bytes]) -> float:
        """The sum over a text's grams, all of which the table has."""
        total = 0.0
        for found in grams_in_steps(own, self.order):
            wanted = found.view(np.uint64) * self.FACTOR
            at = self.first[(wanted >> self.shift).astype(np.int64)]
            late = np.flatnonzero(self.mixed[at] != wanted)
            while len(late):
                at[late] += 1
                late = late[self.mixed[at[late]] != wanted[late]]
            total += float(self.log_p[at].sum(dtype=np.float64))
        return total

    def parted(self, own: list[bytes]) -> tuple[float, np.ndarray, np.ndarray]:
        """The sum over a text's grams that the table has, the other grams, and how often each of these occurs."""
        total, others, times = 0.0, np.empty(0, np.int64), np.empty(0, np.int64)
        for found in grams_in_steps(own, self.order):
            wanted = found.view(np.uint64) * self.FACTOR
            spot = (wanted >> self.shift).astype(np.int64)
            at, absent = self.first[spot], np.zeros(len(spot), bool)
            late = np.flatnonzero(self.mixed.take(at, mode="clip") != wanted) if len(self.mixed) else np.arange(len(spot))
            while len(late):
                at[late] += 1
                over = at[late] >= self.first[spot[late] + 1]  # the whole range was looked at
                absent[late[over]] = True
                late = late[~over]
                late = late[self.mixed[at[late]] != wanted[late]]
            if absent.any():
                new, n = np.unique(found[absent], return_counts=True)
                others, times = summed(np.append(others, new), np.append(times, n))
                at = at[~absent]
            total += float(self.log_p[at].sum(dtype=np.float64))
        return total, others, times


class Table:
    """Gram scores as a matrix of contexts by bytes, for lookups without a search."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray):
        keys = keys.astype(np.int64)
        self.symbol = np.zeros(256, np.int32)
        used = np.unique(np.concatenate([keys >> 8 * k & 0xFF for k in range(ORDER + 1)])) if len(keys) else np.zeros(1, np.int64)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used)
        context = self._context(keys)
        rows, place = np.unique(context, return_inverse=True)
        self.row = np.zeros(self.width**ORDER, np.int32)
        self.row[rows] = np.arange(len(rows))
        self.scores = np.zeros((max(len(rows), 1), self.width), np.float32)
        self.scores[place, self.symbol[keys & 0xFF]] = log_p

    def _context(self, keys: np.ndarray) -> np.ndarray:
        total = np.zeros(len(keys), np.int64)
        for k in range(ORDER, 0, -1):
            total = total * self.width + self.symbol[keys >> 8 * k & 0xFF]
        return total

    def score(self, own: list[bytes]) -> float:
        raw = self.symbol[np.frombuffer(b"\n" * ORDER + b" ".join(own) + b"\n", np.uint8)]
        context = raw[: len(raw) - ORDER]
        for k in range(1, ORDER):
            context = context * self.width + raw[k : len(raw) - ORDER + k]
        return float(self.scores[self.row[context], raw[ORDER:]].sum(dtype=np.float64))


def _least_broadcast(scores: DataFrame) -> tuple[int | None, bool]:
    """(The least count of the grams that are broadcast, None if there are none to; whether these are all): whole counts, the highest first."""
    held, least = 0, None
    counts = scores.groupBy("n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect()  # a row a count, of which there are about the root of all occurrences
    for r in counts:
        held += r.grams
        if held > BROADCAST_GRAMS:
            return least, False
        least = r.n
    return least or 0, True


def _collected(scores: DataFrame, whole: bool, order: int = ORDER) -> tuple[str, np.ndarray, np.ndarray]:
    """The kind of table that tasks lay out, the grams and their scores; ``whole``: the grams are all that there are."""
    rows = scores.select("gram", F.col("log_p").cast("float").alias("log_p")).toArrow()
    gram, log_p = rows["gram"].to_numpy(), rows["log_p"].to_numpy()
    del rows
    if whole and order == ORDER and len(np.unique(gram >> 8)) * 128 <= BROADCAST_CELLS:
        return "matrix", gram.astype(np.uint32), log_p
    return "whole" if whole else "ranges", *DeepTable.laid_out(gram, log_p)


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS, broadcast: bool = True, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``score`` is of the text as its words in lower case with one space between them, as the base score's tokens are;
    ``bits_per_byte`` is its code length over that text's bytes, the end byte among them. A very long text is one pass.
    Null and empty texts have the end token alone. Repeated rows are scored and counted each. A null id counts as
    training. An empty table gives no rows. Only doc_id and text are read. ``broadcast`` False takes the joins for
    all grams, frequent or not; a gram's score is a 32-bit float both ways. ``order``: bytes of the deepest contexts, ORDER to MOST.
    """
    if not ORDER <= order <= MOST:
        raise ValueError(f"order is {ORDER} to {MOST}")
    context = docs.sparkSession.sparkContext
    rows = id_and_text(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
    scores = stored(gram_scores(stored(count_grams(rows, order)), order))
    vocabulary = stored(count_words(rows))
    told = vocabulary.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    ends = rows.where("not held_out").count()
    n, v = (told["c"] or 0) + ends, told["v"] + (ends > 0)
    whole = float(np.log10(n + 0.1 * (v + 1)))
    most = vocabulary.orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    head = dict(zip(most["word"].to_pylist(), most["c"].to_pylist(), strict=True))
    least, whole_table = _least_broadcast(scores) if broadcast else (None, False)
    rest = scores if least is None else scores.where(F.col("n") < least)
    shared = context.broadcast(head)
    model = context.broadcast(None if least is None else _collected(scores.where(F.col("n") >= least), whole_table, order))

    end_score = float(np.log10(ends + 0.1)) - whole
    shape = "n_tokens long, size long, known long, base double, model double, tail array<binary>, tail_n array<long>, grams array<long>, grams_n array<long>"

    @F.pandas_udf(shape)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known_words = {w: float(np.log10(c + 0.1)) - whole for w, c in shared.value.items()}
        kind, *parts = model.value or ("none",)
        own_table = Table(*parts) if kind == "matrix" else DeepTable(*parts, order) if parts else None
        for texts in batches:
            out = []
            for text in texts:
                own = words(text)
                base, known, tail, tail_n = end_score, int(ends > 0), [], []
                for w, k in Counter(own).items():
                    s = known_words.get(w)
                    if s is None:
                        tail.append(w)
                        tail_n.append(k)
                    else:
                        base += k * s
                        known += k
                found, score = (np.empty(0, np.int64), np.empty(0, np.int64)), 0.0
                if kind == "none":
                    found = np.unique(grams(own, order), return_counts=True)
                elif kind != "ranges":
                    score = own_table.score(own)
                else:
                    score, *found = own_table.parted(own)
                out.append((len(own) + 1, sum(map(len, own)) + max(len(own), 1), known, base, score, tail, tail_n, *found))
            yield pd.DataFrame(out, columns=["n_tokens", "size", "known", "base", "model", "tail", "tail_n", "grams", "grams_n"])

    first = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", scored("text").alias("r")).select("row", "doc_id", "held_out", "r.*"))
    rare = first.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    each = rare.join(vocabulary, "word", "left").select("row", (F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - whole)).alias("s"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("known"))
    sums = each.groupBy("row").agg(F.sum("s").alias("tail_base"), F.sum("known").alias("tail_known"))
    done = first.select("row", "doc_id", "held_out", "n_tokens", "size", "known", "base", "model").join(sums, "row", "left")
    extra = F.lit(0.0)
    if not whole_table:
        pairs = first.select("row", F.explode(F.arrays_zip("grams", "grams_n")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.grams_n").alias("k"))
        done = done.join(pairs.join(rest, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("log_p").cast("float")).alias("joined")), "row", "left")
        extra = F.coalesce("joined", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), (F.col("model") + extra).alias("score"),
        (-(F.col("model") + extra) * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
