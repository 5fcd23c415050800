"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of every item. A document's words are streamed through it; the state
gives the longest item substring that ends at each word. Where that is at least WINDOW words long, or a whole
item shorter than WINDOW ends, those words are hit. Hits give the spans to remove and the document's coverage.

Words outside the items' vocabulary end every match, so only runs of item words long enough to hold a window
are streamed; the rest of a text is looked up and skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text, stored

WINDOW = 13
#: A document is contaminated when COVERAGE times its hit words are at least its words.
COVERAGE = 20
#: Words of items that one automaton holds (about 130 MB in a worker), or one longer item. More items make more
#: automata, and texts are streamed through one after the other, each in a pass of its own.
BLOCK_WORDS = 100_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z; runs of ASCII letters and digits and of all characters beyond ASCII. Null has none."""
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers; ``items``: (item_id, words), none of them empty."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        owners: dict[int, set[int]] = {}
        whole: list[tuple[int, list[int]]] = []
        self.item_ids = [None if i is None else str(i) for i, _ in items]
        for item, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in text]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            whole.append((item, ids))
            self.shortest = min(self.shortest, len(ids))
        #: Items whose windows (or, if shorter, whole sequence) have the state; filled up along the links.
        self.ends: list[int | None] = [None] * len(self.next)
        for item, ids in whole:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= min(window, len(ids)):
                    owners.setdefault(state, set()).add(item)
        self._close(owners, whole)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _close(self, owners: dict[int, set[int]], whole: list[tuple[int, list[int]]]) -> None:
        """Items of each state that holds a window: its own ends' and those of all longer contexts, up to the windows' length."""
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        holds: dict[int, set[int]] = {s: set(x) for s, x in owners.items()}
        for s in order:
            if s in holds and self.length[self.link[s]] >= self.window:
                holds.setdefault(self.link[s], set()).update(holds[s])
        self.items = {s: frozenset(x) for s, x in holds.items() if self.length[s] >= self.window}
        #: The shortest context along the links that still holds a window: the state that a match's last window ends in.
        self.base = list(range(len(self.next)))
        for s in reversed(order):
            if self.length[self.link[s]] >= self.window:
                self.base[s] = self.base[self.link[s]]
        #: state in which a whole short item ends -> (its length, the items)
        short: dict[int, tuple[int, set[int]]] = {}
        for item, ids in whole:
            if len(ids) < self.window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                short.setdefault((state, len(ids)), set()).add(item)
        by_state: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for (state, n), x in short.items():
            by_state.setdefault(state, []).append((n, frozenset(x)))
        self.short: list[tuple] = [()] * len(self.next)
        for s in reversed(order):  # by ascending length: what ends at the link also ends here
            self.short[s] = (*by_state.get(s, ()), *self.short[self.link[s]])

    def hits(self, text: list[bytes], mask: np.ndarray, found: set[str | None]) -> None:
        """Mark the hit words of a document in ``mask``, and add the ids of items with occurring windows to ``found``."""
        if len(text) < self.shortest:
            return
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in text])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        seen: set[int] = set()
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= self.shortest:
                self._stream(ids[begin:end].tolist(), begin, mask, seen)
        found.update(self.item_ids[i] for i in seen)

    def _stream(self, run: list[int], begin: int, mask: np.ndarray, seen: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for k, c in enumerate(run, begin + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                mask[k - window : k] = True  # a longer match's other words were marked a word ago
                s = self.base[state]
                if s in self.items:
                    seen |= self.items[s]
            for n, items in self.short[state]:
                if n <= matched:
                    mask[k - n : k] = True
                    seen |= items


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over all items that have words, one after the other: the driver holds one block of items at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator():
        own = words(row["text"])
        if own:
            if held + len(own) > block_words and block:
                yield Automaton(block, window)
                block, held = [], 0
            block.append((row["id"], own))
            held += len(own)
    if block:
        yield Automaton(block, window)


def automata(benchmark: DataFrame, **settings) -> list[Automaton]:
    """All ``blocks`` at once, for few items."""
    return list(blocks(benchmark, **settings))


def spans_of(mask: np.ndarray) -> np.ndarray:
    """(start, end, start, end, ...) of a mask's runs."""
    return np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).astype(np.int32)


def in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


def hits(text: Column, shared) -> Column:
    """struct(n_words, spans, items): what one automaton, broadcast, finds in each text."""

    @F.pandas_udf("n_words long, spans array<int>, items array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own, items = words(t), set()
            mask = np.zeros(len(own), bool)
            if shared.value is not None:
                shared.value.hits(own, mask, items)
            rows.append((len(own), spans_of(mask), in_order(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return found.asNondeterministic()(text)  # so that a filter on what it finds does not run it once more


def joined_hits(spans: Column, items: Column) -> Column:
    """struct(spans, items) of several automata's."""

    @F.pandas_udf("spans array<int>, items array<string>")
    def merged(many: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for own, names in zip(many, found, strict=True):
            mask = np.zeros(max((int(x[-1]) for x in own if len(x)), default=0), bool)
            for x in own:
                for begin, end in np.asarray(x).reshape(-1, 2).tolist():
                    mask[begin:end] = True
            rows.append((spans_of(mask), in_order({i for x in names for i in x})))
        return pd.DataFrame(rows, columns=["spans", "items"])

    return merged(spans, items)


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as (_row, _hit): a struct of all columns, and struct(n_words, spans, items).

    One automaton is a narrow pass. Of several, each has a pass that stores what it hits, by the texts' two hashes; the
    last one joins that with the texts again. No more than one is ever with the driver or a worker.
    """
    context, text = docs.sparkSession.sparkContext, docs[f"`{text_col}`"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), text.alias("_text"))
    key = [F.xxhash64("_text").alias("_k1"), F.xxhash64(F.reverse("_text"), F.lit(1)).alias("_k2")]
    found, shared = None, context.broadcast(None)
    waiting = None
    for automaton in blocks(benchmark, block_words=block_words):
        if waiting is not None:  # there is another one after it
            texts = rows.where("_text is not null").select("_text", *key).dropDuplicates(["_k1", "_k2"])
            part = stored(texts.select("_k1", "_k2", hits(F.col("_text"), waiting).alias("h")).where("size(h.spans) > 0").select("_k1", "_k2", "h.spans", "h.items"))
            found = part if found is None else found.unionByName(part)
            waiting.unpersist()
        waiting = context.broadcast(automaton)
    last = hits(F.col("_text"), waiting or shared)
    if found is None:
        return rows.select("_row", last.alias("_hit"))
    other = found.groupBy("_k1", "_k2").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    both = rows.select("_row", *key, last.alias("h")).join(other, ["_k1", "_k2"], "left")
    more = lambda old, new: F.concat(F.coalesce(old, F.array().cast(f"array<{new}>")), F.array(F.col(f"h.{'spans' if 'int' in new else 'items'}")))
    merged = joined_hits(more(F.col("spans"), "array<int>"), more(F.col("items"), "array<string>"))
    return both.select("_row", "h.n_words", merged.alias("m")).select("_row", F.struct("n_words", F.col("m.spans").alias("spans"), F.col("m.items").alias("items")).alias("_hit"))


def n_hit(spans: Column) -> Column:
    """The sum of ends less that of starts."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(hit: Column, coverage: int = COVERAGE) -> Column:
    return (n_hit(hit["spans"]) > 0) & (coverage * n_hit(hit["spans"]) >= hit["n_words"])


def hit_words(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word spans (start, end, start, ...).

    Null and empty texts have no words and no hits; items without text or words have no windows; repeated items
    with different ids count each, and all without id as one, which the digest leaves out. An empty benchmark hits nothing. A very long text is one run over its words.
    Repeated rows give a row each, an empty table none; other columns are not read, whatever they are called. No
    shuffle while the items' words fit one automaton.
    """
    found = with_hits(id_and_text(docs), benchmark, block_words=block_words)
    hit = F.col("_hit")
    digest = F.sha2(F.array_join(hit["items"], ",").cast("binary"), 256)
    return found.select(F.col("_row.doc_id").alias("doc_id"), hit["n_words"].alias("n_words"), n_hit(hit["spans"]).alias("n_hit"), F.size(hit["items"]).cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated(hit).alias("contaminated"), hit["spans"].alias("spans"))


def _cut(texts: Column, spans: Column, longest: int) -> Column:
    @F.pandas_udf("string")
    def cut(own: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, x, longest) for t, x in zip(own, hit, strict=True)], dtype=object)

    return cut(texts, spans)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", longest: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns; hit spans of at least ``longest`` words are cut from their texts.

    Null and empty texts stay as they are. Repeated rows stay each, an empty table stays empty, and columns may have any name.
    """
    kept = with_hits(docs, benchmark, text_col).where(~is_contaminated(F.col("_hit")))
    text = F.col("_row")[text_col]
    cut = F.when(F.size("_hit.spans") > 0, _cut(text, F.col("_hit.spans"), longest)).otherwise(text)
    return kept.select("_row", cut.alias("_text")).select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", longest: int = WINDOW) -> DataFrame:
    """All documents, with every hit span of at least ``longest`` words cut from ``text_col``; all else stays byte for byte. See drop_contaminated."""
    found = with_hits(docs, benchmark, text_col)
    cut = _cut(F.col("_row")[text_col], F.col("_hit.spans"), longest)
    return found.select("_row", cut.alias("_text")).select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def without_spans(text: str | None, spans: np.ndarray, longest: int) -> str | None:
    if not text:
        return text
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).astype(np.int8))).reshape(-1, 2)
    kept, at = [], 0
    for begin, end in np.asarray(spans).reshape(-1, 2).tolist():
        if end - begin >= longest:
            kept.append(raw[at : bounds[begin][0]])
            at = bounds[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()
