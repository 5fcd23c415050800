"""Operators against brute force on small fixtures, exact round trips, and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netweave.llm import bpe, decontaminate, html, langid, lm, media, ngram_join, pii, queries, tokenfiles, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALPHABET = [chr(c) for c in [*range(1, 0x250), 0x3A3, 0x130, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0x660, 0x1C, 0x85]]


def fuzz(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(file, texts):
    own, library = bpe.codec(public_tokenizers.path(file)), Tokenizer.from_file(public_tokenizers.path(file))
    for text in [*list(texts.values())[:40], *fuzz(1), "<|endoftext|> Hi <|startoftext|>x", "it's we'll  I'd\n\n x", "a" * 3000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, "<u4").tobytes()
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark, texts):
    df = spark.createDataFrame(list(texts.items())[:20], "doc_id long, text string").withColumn("ids", bpe.encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    assert all(r.text == r.back for r in df.withColumn("back", bpe.decode(F.col("ids"), public_tokenizers.path("byte_bpe_50k.json"))).collect())


def test_simple_8b_round_trip():
    rng = random.Random(3)
    for _ in range(200):
        n, block = rng.randint(1, 300), rng.choice([7, 64, 4096])
        values = np.array([rng.choice([0, 1, rng.getrandbits(rng.randint(1, 20)), rng.getrandbits(rng.choice([16, 60, 61, 64]))]) for _ in range(n)], np.uint64)
        words, offsets = tokenfiles.pack(values, block)
        assert (tokenfiles.unpack(words, n, offsets, block) == values).all()
        k = len(offsets) // 2
        part = words[offsets[k] : offsets[k + 1]] if k + 1 < len(offsets) else words[:0]
        if len(part):
            own = values[k * block : (k + 1) * block]
            assert (tokenfiles.unpack(part, len(own), np.array([0, len(part)]), block) == own).all()


def test_token_files_are_the_librarys(spark, sf_dir, texts, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(queries.op5_token_files(spark, sf_dir).collect())
    start = 0
    for r in found:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    monkeypatch.setattr(tokenfiles, "CACHE_PIECES", 300)
    own = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    hard = [*fuzz(2), "<|endoftext|> Hi x", None, "", *list(texts.values())[:20]]
    for text, ids in zip(hard, own.encode(hard), strict=True):
        assert ids == np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def hits(doc, items, window):
    mask, found = [False] * len(doc), set()
    for item, own in items:
        n = min(window, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in wins:
                found.add(str(item))
                mask[i : i + n] = [True] * n
    return mask, found


def test_automaton_finds_all_windows():
    rng = random.Random(9)
    for _ in range(800):
        own = [bytes([97 + i]) for i in range(rng.choice([2, 3, 6]))]
        window = rng.choice([2, 3, 4, 13])
        items = [(i, [rng.choice(own) for _ in range(rng.randint(1, rng.choice([3, 8, 20])))]) for i in range(rng.randint(1, 5))]
        doc = [rng.choice([*own, b"z"]) for _ in range(rng.randint(0, 40))] + (rng.choice(items)[1] if rng.random() < 0.5 else [])
        mask, found = np.zeros(len(doc), bool), set()
        decontaminate.Automaton(items, window).hits(doc, mask, found)
        assert (mask.tolist(), found) == hits(doc, items, window)


def test_decontamination_query(spark, sf_dir, texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in queries.op1_decontamination(spark, sf_dir).collect():
        own = words(texts[r.doc_id])
        mask, found = hits(own, items, 13)
        want = (len(own), sum(mask), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < sum(mask) and 20 * sum(mask) >= len(own))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_blocks_of_items_and_cut_spans(spark, sf_dir):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(6)], "item_id long, text string")
    assert len(decontaminate.automata(bench, block_words=50)) == 3
    docs = spark.createDataFrame([(1, "Keep THIS, " + " ".join(f"W3x{k}" for k in range(20)) + "! and that.")], "doc_id long, text string")
    assert decontaminate.remove_spans(docs, bench).collect()[0].text == "Keep THIS, ! and that."


def test_media_round_trip(spark, sf_dir, texts):
    for r in queries.op4_media(spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.media_bytes == len(padded) + 44
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(576 * 4) / 576)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:, 1] == 40).all()
    t, h = media.fingerprint(tone)
    assert (np.diff(t) >= 0).all() and len(t) == 9 * (3 + 2 + 1)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stands(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_base_spans(spark, sf_dir, texts):
    rng = random.Random(5)
    bits = ["a", "@", ".", "b@c.de", "_", "1", "22", "255", "4111111111111111", "4111-1111 1111-1111", " ", "-", "+", "(", ")", "+1 (301) 555-0346", "é", "😀", "1.2.3.4", "300.1.1.1", "0000001.2.3.4", "x@y.com_z@q.org", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1500)] + [(10**6 + i, t) for i, t in texts.items()]
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {k: [m.span() for m in re.finditer(p, dict_of(rows)[r.doc_id]) if stands(k, m.group())] for k, p in PATTERNS.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in found.values()]
        base = [f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}


_known: dict = {}


def dict_of(rows):
    if id(rows) not in _known:
        _known[id(rows)] = dict(rows)
    return _known[id(rows)]


def test_hostile_texts_end(spark):
    rows = [(0, "1" * 200_000), (1, "a." * 100_000), (2, "a@b" + ".c" * 50_000), (3, "+1" + " " * 100_000), (4, "1 " * 50_000)]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def components(rows):
    sets, parent, inverse = shingle_sets(rows), {}, collections.defaultdict(list)
    for d, s in sets.items():
        parent[d] = d
        for x in s:
            inverse[x].append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(x, y) for ids in inverse.values() for x in ids for y in ids if x < y}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_rows():
    rng = random.Random(4)
    own = [f"w{i}" for i in range(4000)]
    rows = []
    for size, copies, changes in [(3, 3, 1), (5, 4, 1), (8, 8, 1), (20, 10, 1), (60, 12, 3), (200, 12, 9), (150, 90, 4), (40, 60, 2)]:
        base = [rng.choice(own) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(len(text))] = rng.choice(own)
            rows.append(" ".join(text[: rng.randint(int(size * 0.8), size)] if rng.random() < 0.3 else text))
    line = " ".join(rng.choice(own) for _ in range(60))
    rows += [" ".join(rng.choice(own) for _ in range(rng.randint(5, 150))) + " " + line for _ in range(60)]
    return [(i * 7 % 100_003, t) for i, t in enumerate(rows)] + [(900_001, None), (900_002, ""), (900_004, "A b"), (900_005, "a  B")]


def test_join_loses_no_link(spark, sf_dir, texts, monkeypatch):
    rows = near_rows()
    want = components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()} == want
    own = components(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, sf_dir).collect()} == own
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()} == want


def tree_scores(rows):
    """Base and tree scores by the definitions, one bit at a time."""
    nodes, words = collections.defaultdict(lambda: [0, 0]), collections.Counter()
    bits = lambda x: [((1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1) for j in range(8)]
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            own = lm.words(t)
            words.update([*own, None])
            s = b"\n\n\n" + b" ".join(own) + b"\n"
            for i in range(3, len(s)):
                for p, bit in bits(s[i]):
                    for k in range(4):
                        nodes[s[i - k : i], p][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below, weight, own_share = collections.defaultdict(float), {}, {}
    for c, p in sorted(nodes, key=lambda x: -len(x[0])):
        e = kt(*nodes[c, p])
        deep = below[c, p]
        weight[c, p] = e if len(c) == 3 else np.logaddexp(e, deep) - math.log(2)
        own_share[c, p] = 1 if len(c) == 3 else 1 / (1 + math.exp(min(700, deep - e)))
        if c:
            below[c[1:], p] += weight[c, p]
    out, n, v = {}, sum(words.values()), len(words)
    for d, t in rows:
        own = lm.words(t)
        s, score = b"\n\n\n" + b" ".join(own) + b"\n", 0.0
        for i in range(3, len(s)):
            for p, bit in bits(s[i]):
                mix, rest, best = 0.0, 1.0, 0.5
                for k in range(4):
                    if (s[i - k : i], p) not in nodes:
                        break
                    a, b = nodes[s[i - k : i], p]
                    q = (b + 0.5) / (a + b + 1)
                    best = mix + rest * q
                    mix += rest * own_share[s[i - k : i], p] * q
                    rest *= 1 - own_share[s[i - k : i], p]
                score += math.log10(best if bit else 1 - best)
        tokens = [*own, None]
        out[d] = (len(tokens), sum(words[x] > 0 for x in tokens), n, sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), score)
    return out


@pytest.mark.parametrize("settings", [{}, {"head_words": 30}, {"head_words": 30, "broadcast": False}])
def test_language_model(spark, texts, settings):
    rows = [(d, t) for d, t in texts.items() if len(t) < 1500][:30] + [(1000, None), (1001, ""), (1010, "Zz qq\x00 ÿ nothing seen")]
    want = tree_scores(rows)
    for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][4], rel_tol=1e-4)


def test_language_accuracy(spark):
    found = queries.op8_language(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = found.join(lang, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in both]) > 0.97 and all(0 <= r.score <= 1 for r in both)


def test_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id", "left").collect()
    marked = re.compile(r"\b(?:idiot|clown|moron|scum|trash|worthless|pathetic|disgusting|stupid|loser)\b", re.I)
    assert np.mean([r.rejected for r in rows if marked.search(r.text)]) > 0.97
    assert np.mean([r.rejected for r in rows if not marked.search(r.text) and r.toxic != 1]) < 0.02
    assert all(0 <= p <= 1 for r in rows for p in (r.p_insult, r.p_severe, r.p_toxic))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=promo-box>Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>
 three.<br>four<p>Five&nbsp;six &lt;x&gt;</p><div class="comments"><p>first!</p></div></article><div>Same on all pages</div><form>Name</form><footer>&copy;</footer>"""


def test_page_text():
    assert html.main_text(html.parse(PAGE)) == "A & B\nOne two three. four\nFive six <x>"
    assert html.main_text(html.parse("<div>a<div>b</div>c</div><p title='x>y'>d<!-- no --> e")) == "a\nb\nc\nd e"


def test_templates_of_a_host(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Menu of it</div><div>own {i}</div><div>tail</div></body>") for i in range(4)] + [(9, "http://other.example/", "<body><div>Menu of it</div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"own {i}" for i in range(4)} | {9: "Menu of it"}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    monkeypatch.setattr(html, "BROADCAST_HASHES", -1)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_pipeline_keeps_and_drops(spark, sf_dir):
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("rejected").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    near = components(left)
    dirty = {r.doc_id for r in queries.op1_decontamination(spark, sf_dir).where("contaminated").collect()}
    assert kept == {d for d, _ in left if near[d][1] == d} - dirty
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_sigma_and_scores():
    assert bpe.codec(None).encode("ΟΔΟΣ") == np.array(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("ΟΔΟΣ", add_special_tokens=False).ids, "<u4").tobytes()
    assert langid.train([]) is None and toxicity.best_threshold(np.array([0.2]), np.array([0.0])) == 1.0
