"""Personal data: kinds that are rare, or that the base patterns do not name."""

from netweave.llm import pii

IBAN = "BE68 5390 0754 7034"


def spans(spark, rows):
    return {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_rare_kind_is_found_in_any_table(spark):
    filler = [(i, f"mail me{i}@x.org or order 1234-5678-{i:04d} and 10 20 30 40 {i}") for i in range(3000)]
    key = "0123456789abcdef" * 10
    rows = [(10**6, f"Pay to IBAN {IBAN} now"), (10**6 + 1, f"token: {key}")]
    for found in (spans(spark, filler + rows), spans(spark, rows)):
        assert f"iban:12:{12 + len(IBAN)}" in found[10**6].split(",")
        assert "secret:7:167" in found[10**6 + 1].split(",")


def test_thresholds_weigh_classes_by_all_candidates():
    counts = [(1, 1.0, 900, 10), (1, 0.0, 900, 10), (1, 1.0, 950, 10), (4, 1.0, 990, 3)]
    sizes = {(1, 1.0): 4000, (1, 0.0): 10, (4, 1.0): 3, (4, 0.0): 7}
    found = pii.chosen_thresholds(counts, sizes)
    assert found[1] == 0.9 and found[4] == 2.0 and found[0] == 2.0


def test_planted_national_phones_and_addresses_in_words(spark):
    rows = [(0, "call 555-123-4567 today"), (1, "phone: (301) 555-0346."), (2, "mail john at example dot com please"), (3, "look at this dot"), (4, "order 555-123-4567-88-1234567890123")]
    found = spans(spark, rows + [(10 + i, f"invoice {i} of 10 20 30 40 50 60 70 {i}") for i in range(200)])
    assert [found[k] for k in range(5)] == ["phone:5:17", "phone:7:21", "email:5:28", "", ""]


def test_what_context_leaves_open_has_no_label(spark):
    rows = [(0, "555-123-4567"), (1, "john at example dot com"), (2, "ab" * 16 + "12"), (3, "call 555-123-4567"), (4, "1234567 8 9 10 11 12")]
    made = pii.with_candidates(pii.with_base(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    labels = {r.doc_id: [c.label for c in r.candidates] for r in made}
    assert labels == {0: [None], 1: [None], 2: [None], 3: [1.0], 4: [0.0]}
