"""Personal data: many matches in one text, places across the parts of a text, account numbers by their check digits."""

import re

from netweave.llm import pii


def test_many_matches_in_one_text(spark):
    text = "é" * 1000 + " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(6000)) + " 😀" * 700 + " 10.0.0.1 end"
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    (found,) = pii.find(docs).collect()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert found.n_email == 6000 and found.spans.split(",")[:6000] == want and found.n_ip == 1
    (clean,) = pii.redact(docs).collect()
    assert clean.text == "é" * 1000 + " ".join(["[EMAIL]"] * 6000) + " 😀" * 700 + " [IP] end"


def test_account_numbers_need_no_word(spark):
    rows = [(0, "send it to DE89 3704 0044 0532 0130 00 please"), (1, "GB29NWBK60161331926819"), (2, "ref BE68 5390 0754 7034 12 pieces"), (3, "ref BE69 5390 0754 7034"), (4, "IBAN BE69 5390 0754 7034")]
    found = {r.doc_id: r.spans.split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:11:38" in found[0] and "iban:0:22" in found[1] and "iban:4:23" in found[2] and "iban:5:24" in found[4]
    assert not any(s.startswith("iban") for s in found[3])
