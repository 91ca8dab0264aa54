"""Personal data: pattern spans, and terms that give a protected value away.  DataFrame functions only.

*Base spans.*  Email, ip, card and phone are found by patterns, leftmost and not overlapping within a kind, and checked
(parts of at most 255; 16 to 19 digits with a right Luhn sum; 8 to 15 digits); a match that fails is dropped without retry.  The
patterns match what their plain forms match, written with possessive repeats and a guard at the start so that long runs
of one kind of sign take linear time.

*Disclosure.*  The protected entities are the values found.  Over the whole corpus, of N texts, a term t that stands in n_t of them and
together with entity e (in n_e texts) in n_et has pointwise mutual information log2(n_et N / (n_e n_t)); e's information is
log2(N / n_e).  Their ratio is the share of e's identity that t discloses.  In texts with e, terms with a ratio of at least
``disclosure`` are spans of kind "term": sanitising replaces base spans by their kind and terms by [TERM].

With ``support`` joint texts the counts are taken as they stand.  With fewer, and for every entity that stands in one or two texts only, the
share n_et / n_t of t's texts that hold e is replaced by its lower 95 % bound (Wilson), so what one joint text proves depends on N: a term that
stands nowhere else discloses an entity of one text from N = 2,650 on.  Equal texts count once, so copies are no evidence.  n_t counts every text
with the word, joint counts leave out words that stand within an entity only.

Offsets are code points, ends exclusive.  Null text counts as empty; null and repeated doc_ids are kept, a row each; an empty table gives
no rows; ``sanitize`` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Kinds in the order in which spans are listed; "term" is what disclosure adds.
KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns of the kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur at all: cheaper than the pattern.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_WORD = r"[\p{L}]+"
#: Fixed value: the normal quantile of the lower bound, squared.
_Z2 = 1.96**2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("999").cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        n = F.length(digits)
        return F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: Column | str, kind: int) -> Column:
    """Spans of all matches: the stretches between them (split) and the matches themselves give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + p["gap"]
        b = a + F.length(p["m"])
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), p["m"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Valid spans by kind, then start."""

    def of(i: int, kind: str) -> Column:
        spans = F.filter(located(text, PATTERNS[kind], i), lambda s: _valid(kind, s["value"]))
        return F.when(_HINTS[kind](text), spans).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS[:4])])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def terms_of(text: Column) -> Column:
    """Distinct lower-cased words of at least four letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))


def _lower_share(k: Column, n: Column) -> Column:
    """The lower 95 % bound (Wilson) of a share of which k in n were seen."""
    p = k / n
    return (p + _Z2 / (2 * n) - F.sqrt(_Z2 * (p * (1 - p) / n + _Z2 / (4 * n * n)))) / (1 + _Z2 / n)


def disclosing_terms(found: DataFrame, rows: DataFrame, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """(_h, term): the terms of each text that disclose an entity of it; ``found`` has _h, _text and _base of texts with base spans, ``rows`` _h and _text of all."""
    unique = found.groupBy("_h").agg(F.min(F.struct("_text", "_base")).alias("x")).select("_h", "x.*")
    entities = F.array_distinct(F.transform("_base", lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])))
    bare = F.aggregate("_base", F.col("_text"), lambda t, s: F.replace(t, s["value"], F.lit(" ")))
    held = shared.table(unique.select("_h", entities.alias("es"), terms_of(bare).alias("ts")), "entity-texts")
    n_e = held.select(F.explode("es").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    seen = held.select("_h", F.explode("es").alias("entity"), "ts").select("_h", "entity", F.explode("ts").alias("term"))
    joint = shared.table(seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).join(n_e, "entity"), "joint-counts")
    wanted = joint.select("term").distinct()
    # Document frequencies over the distinct texts of the corpus: terms are counted within each task before they are shuffled.
    texts = rows.select("_h", "_text").dropDuplicates(["_h"])
    n_t = texts.select(F.explode(terms_of(F.col("_text"))).alias("term")).groupBy("term").count().withColumnRenamed("count", "n_t").join(wanted, "term")
    scored = joint.join(n_t, "term").withColumn("n_all", F.lit(rows.select("_h").distinct().count())).withColumn("n_t", F.greatest("n_t", "n_et"))
    share = F.when(F.col("n_et") >= support, F.col("n_et") / F.col("n_t")).otherwise(_lower_share(F.col("n_et"), F.col("n_t")))
    information = F.log2(F.col("n_all") / F.col("n_e"))
    pmi = F.log2(share) + information
    risky = shared.table(scored.where((information > 0) & (pmi >= information * disclosure)).select("entity", "term"), "disclosing-terms")
    # A text's own terms only: the terms of all texts of an entity would meet all its texts.
    return seen.join(risky, ["entity", "term"], "left_semi").select("_h", "term").distinct()


def find_pii(docs: DataFrame, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """Of every row d (a struct of all columns of ``docs``, so no name of theirs can clash), text (null: empty), base and spans (base spans, then term
    spans): arrays of (kind, start, end, value)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    rows = docs.select(own, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    any_hint = F.lit(False)
    for hint in _HINTS.values():
        any_hint = any_hint | hint(F.col("_text"))
    found = rows.where(any_hint).select("_h", "_text").withColumn("_base", base_spans(F.col("_text"))).where(F.size("_base") > 0)
    found = shared.table(found, "base-spans")
    by_text = disclosing_terms(found, rows.select("_h", "_text"), support, disclosure)
    # Letters only, so a term is its own pattern; longer ones first.
    ordered = F.reverse(F.array_sort(F.transform(F.collect_list("term"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    words = by_text.groupBy("_h").agg(F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.concat_ws("|", F.transform(ordered, lambda x: x["t"])), F.lit(r")(?!\p{L})")).alias("_pattern"))
    words = shared.table(words, "term-patterns")
    out = _with_patterns(rows, words, any_hint).withColumn("_base", base_spans(F.col("_text")))
    terms = F.filter(located(F.col("_text"), F.coalesce("_pattern", F.lit("(?!)")), 4), lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.select("d", F.col("_text").alias("text"), F.col("_base").alias("base"), F.when(F.col("_pattern").isNull(), F.col("_base")).otherwise(F.concat("_base", terms)).alias("spans"))


def _with_patterns(rows: DataFrame, words: DataFrame, may_hold: Column) -> DataFrame:
    """Texts meet their term patterns by hash: a shuffle of the texts that may hold an entity, unless no text has a pattern."""
    none = F.lit(None).cast("string")
    if words.limit(1).count() == 0:
        return rows.withColumn("_pattern", none)
    met = rows.where(may_hold).join(words, "_h", "left").select(*rows.columns, "_pattern")
    return met.unionAll(rows.where(~may_hold).withColumn("_pattern", none))


def pii_spans(docs: DataFrame, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row."""
    out = find_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), support, disclosure)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return out.select("d.doc_id", *[count(i) for i in range(5)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitize(docs: DataFrame, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """``docs`` with each stretch of overlapping spans in text replaced by the kind of its first span: [EMAIL], [IP], [CARD], [PHONE], [TERM]."""
    out = find_pii(docs, support, disclosure)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(by_start, first, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("d")["text"])
    return out.select(*[text.alias(c) if c == "text" else F.col("d")[c].alias(c) for c in docs.columns])
