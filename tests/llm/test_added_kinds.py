"""Personal data: how much of every added kind is found, columns of any name, no caps on length."""

import random

from netweave.llm import pii


def planted(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return {
        "email": (f"please mail {rng.choice('abc')}x{digits(3)} [at] example [dot] org ", 12),
        "phone": (f"call us: ({digits(3)}) {digits(3)}-{digits(4)} ", 9),
        "iban": (f"our IBAN DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} ", 9),
        "secret": (f"token: {hexes} ", 7),
        "ssn": (f"file {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} ", 5),
    }


def test_recall_of_every_added_kind(spark):
    rng, rows, want = random.Random(2), [], {}
    for k in range(400):
        kind, (text, at) = rng.choice(sorted(planted(rng).items()))
        rows.append((k, "some words before. " + text + "and after, 12 of 30"))
        want[k] = f"{kind}:{19 + at}:{19 + len(text) - 1}"
    rows += [(1000 + k, f"order {k} of 2024-05-{k % 28 + 1:02d}, 10 20 30 pieces, page {k * 7} / 991, 000-12-3456") for k in range(400)]
    found = {r.doc_id: r.spans.split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_kind = {}
    for k, span in want.items():
        by_kind.setdefault(span.split(":")[0], []).append(span in found[k])
    assert len(by_kind) == 5 and all(sum(x) >= 0.9 * len(x) for x in by_kind.values()), {k: sum(x) / len(x) for k, x in by_kind.items()}
    assert sum(found[k] != [""] for k in found if k >= 1000) <= 4


def test_long_local_parts_and_keys(spark):
    local, key = "a" * 300, "0123456789abcdef" * 40
    found = pii.find(spark.createDataFrame([(0, f"mail {local} [at] example [dot] org"), (1, f"key={key}")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in found} == {0: f"email:5:{5 + 300 + 23}", 1: "secret:4:644"}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "x", "mail a@b.org", "y"), (2, "x", None, "y")], "doc_id long, `a.b` string, text string, `c d` string")
    done = pii.redact(docs)
    assert done.columns == docs.columns and sorted(map(tuple, done.collect())) == [(1, "x", "mail [EMAIL]", "y"), (2, "x", None, "y")]
