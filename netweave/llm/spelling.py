"""Spelling variants: words one edit apart, found through a reduced alphabet, and the frequent form that each stands for.

Letters are mapped to a few symbols. Each word's reduced form, and every reduced form one replacement or deletion away
from it, are joined with the reduced forms of the vocabulary; what meets is compared letter by letter. An insertion seen
from one word is a deletion seen from the other, so that these two give the whole neighbourhood of every pair.

Variants go to shards of the reduced vocabulary by their hashes, packed as arrays; two reduced forms of one hash are
told apart by the letters. Letters are single bytes of Latin-1, so that a byte is a code point.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count each. Texts and words of any
length are taken whole. Of near words equally frequent the smallest in code-point order is the form. No words give no rows. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import hand_back, id_and_text, stored

#: One run in NOISE loses a letter, by its checksum; words have LEAST letters or more and occur TWICE or more; a form is RATIO times as frequent.
NOISE, LEAST, TWICE, RATIO = 31, 7, 2, 10
#: Words counted in a task before they are handed on; words whose variants are made at once; variants of a shard on average; bytes compared at once.
HELD, BATCH, SHARD, AT_ONCE = 200_000, 16_384, 1 << 20, 1 << 22
#: Latin-1 letters as they are, A to Z in lower case, all else as blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
BASE, LENGTHS, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def counted_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, after the loss of letters, with words below the least length left out."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    start = crc32(f"{'' if name is None else name}:".encode())
                    runs = Counter([w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= LEAST])
                    for word, n in runs.items():
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % NOISE == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST:
                                continue
                        held[word] += n
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()
        hand_back()

    return id_and_text(documents, id_col, text_col).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(words: DataFrame) -> tuple[np.ndarray, int, int]:
    """(symbol from 1 of each byte, number of symbols, number of variants) for a vocabulary.

    Symbols grow as the eighth root of the words, so that reduced forms of eight letters have about a word each; letters
    are dealt, most frequent first, to the symbol that is least frequent so far. Only 256 counts reach the driver.
    """

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros(256, np.int64), 0
        for batch in batches:
            seen += np.bincount(np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8), minlength=256)
            words += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(256), -1]), pa.array(np.r_[seen, words])], names=["letter", "n"])

    told = dict(map(tuple, words.select("word").mapInArrow(letters, "letter long, n long").groupBy("letter").agg(F.sum("n")).collect()))
    size = told.pop(-1, 0)
    symbols = max(4, math.ceil(size**0.125))
    table, load = np.ones(256, np.uint64), [0] * symbols
    for letter in sorted(told, key=lambda x: (-told[x], x)):
        least = load.index(min(load))
        table[letter] = least + 1
        load[least] += told[letter]
    return table, symbols, size + symbols * sum(told.values())


def hashed(value: np.ndarray, length: int) -> np.ndarray:
    """Spread 64-bit polynomial values of reduced forms of one length."""
    with np.errstate(over="ignore"):
        x = value ^ (np.uint64(length) * LENGTHS)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * MIX
        return x ^ (x >> np.uint64(29))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASE)], dtype=np.uint64)[:n]


def letter_rows(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def reduced(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Hashes of the reduced forms of words of one length."""
    a = table[letter_rows(words)]
    with np.errstate(over="ignore"):
        return hashed((a * powers(a.shape[1])[::-1]).sum(axis=1, dtype=np.uint64), a.shape[1])


def neighbourhood(words: list[bytes], table: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the word) of the reduced forms of words of one length, and of all forms one replacement or one deletion away.

    No form comes twice: a symbol replaces others only, and of a run of equal symbols only the first is deleted.
    """
    a = table[letter_rows(words)]
    n, length = a.shape
    power, who = powers(length), np.arange(n)
    with np.errstate(over="ignore"):
        parts = a * power[::-1]
        whole = parts.sum(axis=1, dtype=np.uint64)
        found, owners = [hashed(whole, length)], [who]
        for t in range(1, symbols + 1):
            row, at = np.nonzero(a != t)
            found.append(hashed(whole[row] + (np.uint64(t) - a[row, at]) * power[length - 1 - at], length))
            owners.append(row)
        if length > LEAST:  # shorter words are in no vocabulary
            before = np.zeros_like(parts)
            before[:, 1:] = np.cumsum(a[:, :-1] * power[: length - 1][::-1], axis=1, dtype=np.uint64)
            after = whole[:, None] - np.cumsum(parts, axis=1, dtype=np.uint64)
            first = np.ones(a.shape, bool)
            first[:, 1:] = a[:, 1:] != a[:, :-1]
            row, at = np.nonzero(first)
            found.append(hashed((before + after)[row, at], length - 1))
            owners.append(row)
    return np.concatenate(found), np.concatenate(owners)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` become those of ``b``, as long or one shorter, by exactly one replacement or one deletion."""
    n, length = b.shape
    if a.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a[:, :length] == b, a[:, 1:] == b
    lead = np.where(ahead.all(axis=1), length, ahead.argmin(axis=1))
    trail = np.where(behind.all(axis=1), length, behind[:, ::-1].argmin(axis=1))
    return lead + trail >= length


def by_length(words: list[bytes]) -> list[list[bytes]]:
    """Words of one length, in pieces of a bounded number of letters."""
    same = defaultdict(list)
    for w in words:
        same[len(w)].append(w)
    return [own[k : k + step] for length, own in sorted(same.items()) for step in [max(1, min(BATCH, (BATCH << 4) // length))] for k in range(0, len(own), step)]


SHARDS = "shard long, size long, words binary, hashes binary, counts binary"


def sharded(words: DataFrame, table: np.ndarray, symbols: int, shards: int) -> DataFrame:
    """Packed rows of each shard: its own words with their hashes, and (with ``counts``) other words with the hashes of their variants that fall there."""

    def cut(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(33)) % np.uint64(shards), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def rows(own: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = []
        for same in by_length(own):
            same.sort()  # neighbours share letters, which packs them well
            shard, low = cut(reduced(same, table))
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else []
            for i, j in zip(edges, edges[1:], strict=False):
                text = b" ".join(same[k] for k in order[i:j])
                out.append((int(shard[order[i]]), len(text), pa.compress(text, codec="zstd", asbytes=True), low[order[i:j]].tobytes(), None))
            h, who = neighbourhood(same, table, symbols)
            shard, low = cut(h)
            order = np.lexsort((who, shard))
            shard, low, who = shard[order], low[order], who[order]
            edges = np.flatnonzero(np.r_[True, np.diff(shard) != 0, True]) if len(order) else []
            for i, j in zip(edges, edges[1:], strict=False):
                names, counts = np.unique(who[i:j], return_counts=True)
                text = b" ".join(same[k] for k in names)
                out.append((int(shard[i]), len(text), pa.compress(text, codec="zstd", asbytes=True), low[i:j].tobytes(), counts.astype(np.uint32).tobytes()))
                if len(out) >= 64:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    kinds = {"shard": pa.int64(), "size": pa.int64(), "words": pa.binary(), "hashes": pa.binary(), "counts": pa.binary()}

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        for batch in batches:
            own += [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            if len(own) >= BATCH:
                yield from rows(own)
                own = []
        yield from rows(own)
        hand_back()

    return words.select("word").mapInArrow(spread, SHARDS)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): the words of ``words`` (word, distinct) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    table, symbols, variants = alphabet(words)

    def unpacked(group: pa.Table, k: int) -> list[bytes]:
        return pa.decompress(group.column("words")[k].as_py(), decompressed_size=group.column("size")[k].as_py(), codec="zstd", asbytes=True).split(b" ")

    def meet(group: pa.Table) -> pa.Table:
        own, hashes, others = [], [], []
        for k in range(group.num_rows):
            if group.column("counts")[k].is_valid:
                others.append(k)
            else:
                own += unpacked(group, k)
                hashes.append(np.frombuffer(group.column("hashes")[k].as_py(), np.uint32))
        lefts, rights = [], []
        if own:
            key = np.concatenate(hashes)
            order = np.argsort(key, kind="stable")
            key = key[order]
            text = np.frombuffer(b"".join(own), np.uint8)
            size = np.array([len(w) for w in own])
            start = np.cumsum(size) - size
        for k in others if own else []:
            asked = unpacked(group, k)
            length = len(asked[0])
            letters = letter_rows(asked)
            who = np.repeat(np.arange(len(asked)), np.frombuffer(group.column("counts")[k].as_py(), np.uint32))
            wanted = np.frombuffer(group.column("hashes")[k].as_py(), np.uint32)
            low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            hit = np.flatnonzero(high > low)
            total, step = np.cumsum(high[hit] - low[hit]), max(1, AT_ONCE // length)
            for first in range(0, int(total[-1]) if len(total) else 0, step):
                pair = np.arange(first, min(first + step, int(total[-1])))
                of = np.searchsorted(total, pair, "right")
                there = order[high[hit[of]] - (total[of] - pair)]
                here = who[hit[of]]
                for other in (length, length - 1):
                    same = size[there] == other
                    a, b = here[same], there[same]
                    good = one_edit(letters[a], text[start[b][:, None] + np.arange(other)]) if len(a) else np.zeros(0, bool)
                    one, two = [asked[x].decode("latin-1") for x in a[good]], [own[x].decode("latin-1") for x in b[good]]
                    lefts += one if other == length else one + two
                    rights += two if other == length else two + one
        hand_back()
        return pa.table({"word": pa.array(lefts, pa.string()), "other": pa.array(rights, pa.string())})

    return sharded(words, table, symbols, max(1, math.ceil(variants / SHARD))).groupBy("shard").applyInArrow(meet, "word string, other string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round follows twice as far; forms grow by RATIO, so rounds are few."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = stored(links.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return links


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of all texts with LEAST letters and TWICE occurrences or more."""
    words = stored(counted_words(documents, id_col, text_col).where(F.col("n") >= TWICE))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_pairs(words).join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left")
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
