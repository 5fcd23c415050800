"""Byte-pair encoding and decoding from a public tokenizer file.

A word's symbols form a doubly linked list. A heap holds the adjacent pairs that the merge table knows, by
rank and then position. Popping the lowest rank joins its two symbols and pushes the pairs that the new symbol
forms with its neighbours; entries whose symbols have changed meanwhile are stale and skipped. Decoding joins
the vocabulary strings of the ids, as the file's decoder says.

Words repeat, so each Python worker keeps the ids of words it has met in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text

#: Entries of a worker's word cache; a full cache is emptied, which costs time but changes no result.
CACHE_WORDS = 150_000
_SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


def latin_pattern(pattern: str) -> str:
    """``pattern`` with its Unicode classes spelled out for the first 256 characters."""
    letters, numbers, spaces = ("".join(re.escape(chr(c)) for c in range(256) if test(chr(c))) for test in (lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c)[0] == "N", lambda c: regex.match(r"\p{White_Space}", c)))
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        pattern = pattern.replace(old, new)
    return pattern


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; fills itself."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = np.array(self.codec.word(word), dtype="<u4").tobytes()
        return ids


class Codec:
    """The encoder and decoder that a tokenizer file describes: byte-level BPE, with or without word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.normalized = spec["normalizer"] is not None
        self.bytes_out = spec["decoder"] is not None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.first = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + self.suffix) for c in alphabet]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] << _SHIFT | vocab[b], (rank, vocab[a + b]))
        self.strings: dict[int, str] = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.from_alphabet = {ord(c): b for b, c in enumerate(alphabet)}
        pre = spec["pre_tokenizer"]
        if pre["type"] == "ByteLevel":
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        else:
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        self.any_pieces = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        self.latin_pieces = re.compile(latin_pattern(pattern)).findall
        self.ids_of = WordIds(self)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        symbols = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] << _SHIFT | symbols[i + 1]
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << _SHIFT | symbols[j] != pair:
                continue
            merged = symbols[i] = merges[pair][1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = merged << _SHIFT | symbols[k]
                if pair in merges:
                    heappush(heap, (merges[pair][0], i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] << _SHIFT | merged
                if pair in merges:
                    heappush(heap, (merges[pair][0], h, pair))
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; the standard module is the faster one where its characters allow it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces(text)
        return self.latin_pieces(text)

    def _plain(self, text: str) -> bytes:
        if self.normalized:
            # the file's normalizer lower-cases each character by itself, so a capital sigma never becomes a final one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self.ids_of.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed; null is empty. Special tokens' strings in a text become their ids."""
        if not text:
            return b""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            if len(parts) > 1:
                return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        strings = map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.bytes_out:
            return " ".join(strings)
        table = self.from_alphabet
        return b"".join(s.encode() if s in self.special else bytes(map(table.__getitem__, map(ord, s))) for s in strings).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str | None, default: str = "word_bpe_49k.json") -> Codec:
    """The worker's codec for a file; ``path`` None takes the installed public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(text: Column, path: str | None = None) -> Column:
    """array<int> of token ids; a null text has none."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return texts.map(lambda t: np.frombuffer(own.encode(t), "<i4"))

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text that token ids stand for; null for null."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        own = codec(path)
        return rows.map(lambda x: None if x is None else own.decode(np.asarray(x, "<u4").tobytes()))

    return texts(ids)


def digest(text: Column, path: str | None = None) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): a text encoded, and its ids decoded, in one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = codec(path)
        rows = []
        for t in texts:
            ids = own.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def encode_and_digest(text: Column, path: str | None = None) -> Column:
    """struct(ids, n_tokens, ids_sha256, decoded_sha256): the ids themselves besides their digests."""

    @F.pandas_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = codec(path)
        rows = []
        for t in texts:
            ids = own.encode(t)
            rows.append((np.frombuffer(ids, "<i4"), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens. Repeated rows give a row each. Only doc_id and text are read, so other
    columns cannot clash. One narrow pass: no shuffle, and a worker holds one batch of texts and its cache.
    """
    return id_and_text(docs).select("doc_id", digest(F.col("text"), path).alias("r")).select("doc_id", "r.*")
