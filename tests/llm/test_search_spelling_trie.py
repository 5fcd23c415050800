"""Nearest neighbours, spelling variants and the prefix trie against brute force, and at the edges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netweave.llm import permutation, prefix_trie, spelling
from netweave.llm.queries import op11_nearest


def true_neighbours(rows, k=20, every=20):
    """{query: [(vec_id, score)]} of (vec_id, vector), exactly."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {q: sorted(((i, float(sum(a * b for a, b in zip(x, y, strict=False)))) for i, y in rows if i != q), key=lambda r: (-r[1], r[0]))[:k] for q, x in rows if q % every == 0}


def found_neighbours(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall_on_the_embeddings(spark):
    found = found_neighbours(op11_nearest(spark, "/root/testdata/sf0.01"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    true = true_neighbours(rows)
    assert found.keys() == true.keys()
    scores = {q: dict(t) for q, t in true_neighbours(rows, k=len(rows)).items()}
    assert all(len(found[q]) == 20 and all(abs(scores[q][i] - s) < 1e-12 for i, s in found[q]) for q in found)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in true[q]}) for q in true]) / 20 >= 0.9


def test_neighbours_of_copies_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    hot = [float(x) for x in rng.normal(size=6)]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(size=6) * (1 + i % 4)]) for i in range(120)]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, []), (None, hot), (320, [1.0, 2.0]), (40, rows[40][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, shared int")
    found, true = found_neighbours(permutation.nearest_neighbours(df)), true_neighbours(rows)
    assert found.keys() == true.keys()
    scores = {q: dict(t) for q, t in true_neighbours(rows, k=999).items()}
    assert all(len(f) == 20 and all(abs(scores[q][i] - s) < 1e-9 for i, s in f) for q, f in found.items())
    assert [i for i, _ in found[60]] == [i for i, _ in true[60]] or found[60][0][1] >= true[60][19][1]  # copies of the query's own vector, smaller ids first
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in true[q]}) for q in true]) / 20 >= 0.85


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (20, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in f] for q, f in found_neighbours(permutation.nearest_neighbours(few)).items()} == {0: [1, 2, 20], 20: [1, 2, 0]}
    assert permutation.nearest_neighbours(few.where("vec_id < 0")).collect() == []
    assert permutation.nearest_neighbours(few.where("vec_id = 1")).collect() == []
    assert permutation.nearest_neighbours(few.where("vec_id = 0")).collect() == []


def test_a_bound_that_finds_too_few_is_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(permutation, "TARGET", 0.01)  # the bound is about the best true neighbour's
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    true, found = true_neighbours(rows), found_neighbours(permutation.nearest_neighbours(df))
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in t] for q, t in true.items()}


def spelled(rows):
    """The words by plain counting and by deletion of every letter."""
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, same = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            same[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, n[w], len(near[w]), form.get(w) or "", n[form[w]] if w in form else 0, root(w)) for w in n)


def spelled_by_spark(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in spelling.spelling_variants(df).collect())


def test_spelling_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = spelled_by_spark(df)
    assert found == spelled([tuple(r) for r in df.select("doc_id", "text").collect()]) and any(r[3] for r in found)


def test_spelling_at_the_edges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 200)  # many shards
    monkeypatch.setattr(spelling, "AT_ONCE", 64)
    monkeypatch.setattr(spelling, "HELD", 5)
    long = "abcdefghij" * 300
    texts = ["anagram " * 4000 + "anagrams " * 300 + "anagramss " * 25 + "anagramsss anagramsss", "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa", f"{long} {long} {long}x {long}x", "éclairé éclairé éclaire éclaire ÉCLAIRE×÷ÿ", None, "", " \n1234567,;", "bananas bananas banana banana bandanas bandanas", "ordinary word_boundary-here ordinary", "ordinary unordinary 中文ordinary中文 ORDINARY"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n int, word string")
    found = spelled_by_spark(df)
    assert found == spelled(rows)
    assert ("anagramss", 25, 2, "anagrams", 300, "anagram") in found and (long, 2, 1, "", 0, long) in found
    assert spelling.spelling_variants(df.where("doc_id < 0")).collect() == []


def test_one_symbol_does_not_hide_letters(spark):
    words = [a + "bcdefgh" for a in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(1000 + i, f"{w} {w} {w}") for i, w in enumerate(words)], "doc_id long, text string")
    assert spelled_by_spark(df) == spelled([tuple(r) for r in df.collect()])


def trie(rows):
    """Nodes by sets of members of every prefix."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in conv.items()}
    built = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    saved, leaves, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        children[k[:-1]] += [k] if k else []
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[j] for j in children[k])
        leaves[k] = sum(leaves[j] for j in children[k]) or 1
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_by_spark(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(df).select(names).collect())


def test_trie_of_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie_by_spark(df) == trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("ranges", [3, 16])
def test_trie_at_the_edges(spark, ranges):
    rows = [(0, t, "user", f"turn {t} of a long talk") for t in range(400)] + [(c, t, "user", f"turn {t} of a long talk") for c in (3, 7, 12) for t in range(90)]
    rows += [(20, None, None, None), (20, 1, "user", ""), (21, 5, "user", "alone"), (45, 0, "a", "b"), (46, 0, "a", "b"), (47, 0, "a", "b"), (47, 0, "a", "b"), (None, 0, "user", "no id")]
    rows += [(100 + c, t, "user", "the same for all" if t == 0 else f"{c % 3} {t}") for c in range(60) for t in range(3)] + [(50, 0, "long", "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, d int, part string")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert trie_by_spark(df) == trie(rows)
        assert prefix_trie.prefix_trie(df.where("conv_id < 0")).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_contraction_of_a_chain_a_comb_and_a_forest(spark):
    chain = [(i, i - 1 if i else None) for i in range(120)]
    comb = [(1000 + i, 1000 + i - 2 if i % 2 == 0 and i else 1000 + i - 1 if i else None) for i in range(80)]
    rows = [(n, p, n % 7) for n, p in chain + comb + [(5000, None), (5001, 5000)]]
    found = {r.node: r.value for r in prefix_trie.subtree_totals(spark.createDataFrame(rows, "node long, parent long, value long"), ["value"]).collect()}
    total = {n: v for n, _, v in rows}
    for n, p, _ in reversed(rows):
        if p is not None:
            total[p] += total[n]
    assert found == total
