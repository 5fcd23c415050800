"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base patterns with checks of their values (parts of an address, a card's check digit, a phone's digits) give
spans that always stand. High-recall generators propose more, overlapping spans: obfuscated addresses, numbers
in any grouping, hexadecimal keys, account numbers. Boosted trees score these by their format and the words
before them; a threshold for each generator, calibrated on the candidates of all documents that training did not
see, selects what is added. What a strict rule names is always added, so that a kind without evidence for a
threshold has its rule. The trees are trained by Spark's own library on a sample of each kind and class, with the
base checks and the rules as labels, and applied as nested CASE expressions, so that a scan, its patterns and the
scores are one JVM stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text, stored

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
#: The base patterns. Possessive repeats and the looks behind keep matching linear; they change no match: a run
#: whose first character begins no match has none that begins later, save after another match (\\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators: the kind that their spans get, and a pattern of high recall.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]| at ) ?[A-Za-z0-9-]++(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,}+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,18}+",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[0-9]{1,3}(?![A-Za-z0-9]))?+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}+(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: Dates and numbers of the last form, which are no phones.
_NO_PHONE = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
#: Numbers of that form that are never given out. Fixed values.
_NO_SSN = r"^(?:000|666|9)|-00-|-0000$"
CONTEXT = 24
#: Code points of the parts into which a text is cut to be put together again without its spans.
CUT = 1024
_CALL = r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|contact)\b"
_MAIL = r"(?i)\b(?:e-?mail|mail|contact|write)\b"
_KEY = r"(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer)\W{0,5}$"
_BANK = r"(?i)\b(?:iban|account|konto|compte|cuenta)\b"
#: Candidates of each kind and class that training reads, about; precision that a threshold has to reach; its steps.
SAMPLE_CANDIDATES, PRECISION, BINS = 500, 0.95, 1000
TREES, DEPTH, SEED = 8, 3, 11


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, start: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<out>: what each item of a not empty array adds, from left to right.

    ``step(state, item)`` gives the next state and an array to add. An array that grows item by item would be
    copied each time, so items are folded in as many blocks as a block has items.
    """
    empty, nested = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def folded(whole: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(whole))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(whole), width), lambda i: F.slice(whole, i, width))

        def one(a: Column, x: Column) -> Column:
            state, added = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["out"], added).alias("out"))

        def block(a: Column, own: Column) -> Column:
            return F.aggregate(own, F.struct(a["state"].alias("state"), empty.alias("out")), one, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(blocks, F.struct(start.alias("state"), nested.alias("out")), block, lambda a: F.flatten(a["out"]))

    return once(items, folded)


SPAN = "struct<s:int,e:int,m:string,b:string,f:string>"


def located(text: Column, pattern: str, needs: str) -> Column:
    """array<struct(s, e, m, b, f)>: the pattern's matches from left to right, in code points, end exclusive, with
    the CONTEXT characters before and the one after.

    The matches and the gaps between them, laid end to end, give the places and what stands around them, so that
    no match looks into the whole text. ``needs``: a pattern without which a text has no match, so that most texts
    are only searched once.
    """
    start = F.lit(None).cast("struct<at:int,s:int,e:int,m:string,b:string,tail:string>")

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        at, before = F.coalesce(a["at"], F.lit(0)), F.right(F.concat(F.coalesce(a["tail"], F.lit("")), x["gap"]), F.lit(CONTEXT))
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["match"])
        state = F.struct(end.alias("at"), begin.alias("s"), end.alias("e"), x["match"].alias("m"), before.alias("b"), F.right(F.concat(before, x["match"]), F.lit(CONTEXT)).alias("tail"))
        after = F.substring(F.concat(x["gap"], F.coalesce(x["match"], F.lit(""))), 1, 1)
        done = F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"), a["m"].alias("m"), a["b"].alias("b"), after.alias("f")))
        return state, F.when(a["m"].isNotNull(), done).otherwise(F.array().cast(f"array<{SPAN}>"))

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.when(text.rlike(needs), running(zipped, start, SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 13 to 19 digits has the right check digit; false for other lengths."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add) % 10 == 0).otherwise(False)


def account(m: Column) -> Column:
    """Whether an account number, spaces aside, leaves 1 when divided by 97, its first four characters last and letters as 10 to 35."""

    def holds(moved: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            c = F.substring(moved, i, F.lit(1))
            return F.when(c.between("0", "9"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1

    own = F.regexp_replace(m, " ", "")
    return once(F.concat(F.substring(own, 5, 1 << 20), F.left(own, F.lit(4))), holds)


def overlapped(own: Column, x: Column) -> Column:
    """Whether a span has a common character with one of ``own``, spans of one kind in order: by halving, the last that begins before its end."""
    n = F.size(own)

    def look(low: Column, k: Column) -> Column:
        at = low + F.call_function("shiftleft", F.lit(1), k)
        return F.when((at <= n) & (F.get(own, at - 1)["s"] < x["e"]), at).otherwise(low)

    last = F.aggregate(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), F.lit(0), look)
    return F.coalesce(F.get(own, last - 1)["e"] > x["s"], F.lit(False))


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def with_base(rows: DataFrame) -> DataFrame:
    """Add ``base``: array<struct(k, s, e)> of all base spans of ``text``, by kind and start; ``bases``: the same, an array for each kind."""
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}

    def spans(k: int, kind: str) -> Column:
        kept = F.filter(located(F.col("text"), BASE[kind], needs[kind]), lambda x: valid(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return rows.withColumn("bases", F.array(*(spans(k, kind) for k, kind in enumerate(BASE)))).withColumn("base", F.flatten("bases"))


def without_count(x: Column) -> Column:
    """An account number without the number of up to three digits after it, if only so its check holds."""
    short = F.regexp_replace(x["m"], " [0-9]{1,3}$", "")
    cut = F.struct(x["s"].alias("s"), (x["s"] + F.length(short)).alias("e"), short.alias("m"), x["b"].alias("b"), F.lit(" ").alias("f"))
    return F.when((short != x["m"]) & ~account(x["m"]) & account(short), cut).otherwise(x)


FEATURES = ("digits", "length", "separators", "groups", "letters", "plus", "luhn", "at", "distinct", "call", "mail", "key", "bank", "word_before", "word_after", "kind")


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add ``candidates``: array<struct(k, s, e, label, features...)> of all generators' spans."""
    needs = {"email": r"@|[\[(]at[\])]| at ", "phone": "[0-9][ ().-]{0,2}[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[0-9A-Fa-f]{24}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
    text = F.col("text")

    def candidates(kind: str, pattern: str) -> Column:
        k = KINDS.index(kind)

        def described(x: Column) -> Column:
            m, before, number = x["m"], x["b"], digits(x["m"])
            values = {
                "digits": F.length(number), "length": F.length(m), "separators": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), "groups": F.size(F.split(m, "[^A-Za-z0-9]+")),
                "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "plus": m.startswith("+"), "luhn": luhn(number), "at": m.contains("@"),
                "distinct": F.size(F.array_distinct(F.split(F.lower(m), ""))), "call": before.rlike(_CALL), "mail": before.rlike(_MAIL), "key": before.rlike(_KEY), "bank": before.rlike(_BANK),
                "word_before": before.rlike("[A-Za-z0-9]$"), "word_after": x["f"].rlike("[A-Za-z0-9]"), "kind": F.lit(k),
            }
            rule = {"email": m.rlike(r"[\[(]at[\])].*[\[(]dot[\])]"), "phone": F.lit(False), "iban": account(m), "secret": before.rlike(_KEY), "ssn": ~m.rlike(_NO_SSN)}[kind]
            in_words = m.rlike(r"(?i) at .* dot ")
            number_of_call = F.length(number).between(7, 15) & before.rlike(_CALL) & ~before.rlike("[A-Za-z0-9]$")
            grouped = F.length(number).between(7, 15) & m.rlike(r"^[+(]?[0-9]{2,5}\)?(?:[ .-]{1,2}[0-9]{2,5}){1,4}$")
            # By its context a candidate is of the kind as well, or its label is open: not trained on, not judged by.
            context = {"email": in_words & before.rlike(_MAIL), "phone": number_of_call, "iban": F.lit(False), "secret": F.lit(False), "ssn": F.lit(False)}[kind]
            ambiguous = {"email": in_words | m.rlike(r"[\[(](?:at|dot)[\])]"), "phone": grouped, "iban": before.rlike(_BANK), "secret": m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "ssn": F.lit(False)}[kind]
            rule = rule | context
            overlaps = F.exists("bases", lambda own: overlapped(own, x))
            label = F.when(overlaps | rule, 1.0).when(~ambiguous, 0.0)
            if kind == "iban":
                rule = rule | before.rlike(_BANK)  # stands without its check as well, but nothing is learned from that
            return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), overlaps.alias("known"), rule.alias("rule"), label.alias("label"), *(values[f].cast("double").alias(f) for f in FEATURES))

        proposed = located(text, pattern, needs[kind])
        if kind == "phone":
            proposed = F.filter(proposed, lambda x: ~x["m"].rlike(_NO_PHONE))
        if kind == "iban":
            proposed = F.transform(proposed, without_count)
        return F.transform(proposed, described)

    return rows.withColumn("candidates", F.concat(*(candidates(kind, pattern) for kind, pattern in GENERATORS.items())))


def tree_sql(debug: str) -> str:
    """A regression tree's text form as nested CASE, over a lambda variable ``c`` with the features as fields."""
    lines = [x.strip() for x in debug.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def node(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return f"({float(lines[at].split(':')[1])!r}D)", at + 1
        index, bound = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", lines[at]).groups()
        left, after = node(at + 1)
        right, after = node(after + 1)
        return f"(CASE WHEN c.{FEATURES[int(index)]} <= {float(bound)!r}D THEN {left} ELSE {right} END)", after

    return node(0)[0]


def fit(docs: DataFrame) -> tuple[str, dict[int, float]] | None:
    """(SQL of a candidate's probability, threshold by kind); None if the candidates to train on have one class only.

    The trees see about SAMPLE_CANDIDATES of each kind and class, of four fifths of the documents. Thresholds come
    from the candidates of all documents but these, each class in its share of all candidates of the kind.
    """
    # Outer, for Spark would put a filter on the size of the candidates before a plain one, with the base spans made anew for each candidate.
    found = with_candidates(with_base(docs.where("text is not null"))).select("doc_id", F.explode_outer("candidates").alias("c"))
    every = stored(found.select("c.*", (F.xxhash64("doc_id") % 5 == 0).alias("kept"), F.pmod(F.xxhash64("doc_id", "c.s", "c.k"), F.lit(1 << 30)).alias("h")).where("label is not null"))
    sizes = {(r["k"], r["label"]): (r["n"], r["open"]) for r in every.groupBy("k", "label").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("open")).collect()}
    if not sizes:
        return None
    bound = F.expr("CASE " + " ".join(f"WHEN k = {k} AND label = {label!r}D THEN {int((1 << 30) * min(1.0, SAMPLE_CANDIDATES / max(free, 1)))}" for (k, label), (_, free) in sizes.items()) + " END")
    marked = every.withColumn("trained", ~F.col("kept") & (F.col("h") < bound))
    sample = stored(marked.where("trained").select("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label").coalesce(1))
    margin = " + ".join(f"{w!r}D * {tree_sql(t.toDebugString)}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    score = f"1D / (1D + exp(-2D * ({margin})))"
    judged = marked.where("not trained").select("k", "label", F.struct(*FEATURES).alias("c")).selectExpr("k", "label", f"cast(floor(({score}) * {BINS}) AS int) AS bin")
    return score, chosen_thresholds([tuple(r) for r in judged.groupBy("k", "label", "bin").count().collect()], {key: n for key, (n, _) in sizes.items()})


def chosen_thresholds(counts: list[tuple[int, float, int, int]], sizes: dict[tuple[int, float], int]) -> dict[int, float]:
    """By kind, the least bound, 0.5 at least, from which candidates are right; above 1, which leaves the rule alone,
    without evidence. From counts (k, label, bin, n) of the judged and the sizes (k, label) of all candidates."""
    seen: dict[tuple[int, float], int] = {}
    for k, label, _, n in counts:
        seen[k, label] = seen.get((k, label), 0) + n
    thresholds = {}
    for k in range(len(KINDS)):
        own: dict[int, list[float]] = {}
        for kind, label, at, n in counts:
            if kind == k:
                own.setdefault(at, [0.0, 0.0])[int(label)] += n * sizes[k, label] / seen[k, label]
        right, total, best = 0.0, 0.0, 2.0
        for at in sorted(own, reverse=True):
            right, total = right + own[at][1], total + sum(own[at])
            if right >= PRECISION * total:
                best = at / BINS
        thresholds[k] = max(best, 0.5) if (k, 0.0) in seen else 2.0  # none where nothing could speak against
    return thresholds


def with_spans(rows: DataFrame, model: tuple[str, dict[int, float]] | None) -> DataFrame:
    """Add ``base`` and ``spans``: the base spans and the selected candidates beside them, by kind and start."""
    based = with_base(rows)
    score, thresholds = model or ("0D", dict.fromkeys(range(len(KINDS)), 2.0))
    needed = "CASE c.k " + " ".join(f"WHEN {k} THEN {t!r}D" for k, t in thresholds.items()) + " END"
    added = F.expr(f"transform(filter(candidates, c -> NOT c.known AND (c.rule OR {score} >= {needed})), c -> struct(c.k AS k, c.s AS s, c.e AS e))")
    return with_candidates(based).withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates", "bases")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null and empty texts have no spans. Repeated rows give a row each. Only doc_id and text are read. Nothing is
    shuffled but counts of candidates and the training sample.
    """
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    found = with_spans(rows, fit(rows))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    Null texts stay null. Other columns stay as they are, whatever their names; repeated rows give a row each; an
    empty table gives no rows. A text of any length is one pass; of spans that begin together the longer one's end holds.
    """
    names = F.array(*map(F.lit, KINDS))
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[text_col].alias("text"))
    model = fit(docs.select(F.col("doc_id"), docs[text_col].alias("text")))
    found = with_spans(inner, model)
    text, end = F.col("text"), F.length("text")
    last = F.struct(end.alias("s"), end.alias("e"), F.lit(-1).alias("k"))
    ordered = F.concat(F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))), F.array(last))
    piece = "struct<begin:int,end:int,k:int>"

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        own = F.array(F.struct(a["at"].alias("begin"), x["s"].alias("end"), x["k"].alias("k")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at")), F.when(x["s"] >= a["at"], own).otherwise(F.array().cast(f"array<{piece}>"))

    def joined(z: Column) -> Column:
        def between(p: Column) -> Column:
            first, after = F.floor(p["begin"] / CUT).cast("int"), F.floor(p["end"] / CUT).cast("int")
            around = F.array_join(F.slice(z["cuts"], first + 1, after - first + 1), "")
            return F.concat(F.substring(around, p["begin"] % CUT + 1, p["end"] - p["begin"]), F.when(p["k"] >= 0, F.concat(F.lit("["), F.upper(F.get(names, p["k"])), F.lit("]"))).otherwise(""))

        return F.array_join(F.transform(z["pieces"], between), "")

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    cleaned = once(F.struct(cuts.alias("cuts"), running(ordered, F.struct(F.lit(0).alias("at")), piece, step).alias("pieces")), joined)
    result = found.select("_row", F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text")).alias("_text"))
    return result.select(*[(F.col("_text") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
