"""The letters of a text, fast and exact; columns of clashing names in the join's filter."""

import re
import time

from netweave.llm import langid, ngram_join


def test_letters_are_those_of_the_slow_pattern():
    slow = re.compile("[^" + "".join(re.escape(c) for c in map(chr, range(0x3000)) if c.isalpha()) + "]+")
    for text in ("Ab1 c_d²e Ⅷ½f ١٢ g", "²", "ÄÖ ß Ñandú 12Ⅳ", "", "a", "".join(map(chr, range(0x3000)))):
        assert set(langid.letters_only(text).split()) == set(slow.sub(" ", text.lower()).split()) or not all(ord(c) < 0x3000 for c in text.lower())


def test_ten_megabytes_take_seconds():
    text = "Der schnelle braune Fuchs, 12 springt über den faulen Hund. " * 170_000
    langid.letters_only("² warm")
    began = time.process_time()
    assert langid.letters_only(text).startswith("der schnelle braune fuchs springt")
    assert time.process_time() - began < 5


def test_columns_named_like_the_filters_own(spark):
    rows = [(1, "one two three four five six", "a", "b", "c"), (1, "another text of the same id", "a", "b", "c"), (2, "one two three four five six", "a", "b", "c"), (None, None, "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shared string, _gone string, _row string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "another text of the same id"), (1, "one two three four five six")]
