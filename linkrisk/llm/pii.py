"""PII [native]: candidate gradient boosting.

Base rules find emails, IP addresses, card and phone numbers; a match that fails
its check (octets, digit count, Luhn) is dropped. Base spans always stay.
High-recall generators then propose more, possibly overlapping spans: card and
phone numbers inside runs that the base rules swallowed and dropped, phone
numbers without a country code, written-out emails. Gradient-boosted trees over
format and context features judge the proposals. The trees are fitted on the
base rules' own matches (accepted ones against dropped ones), and the accepting
threshold is calibrated on held-out matches to a wanted precision.

Only DataFrame expressions and Spark ML run; there is no Python code in tasks.
Positions come from the lengths between matches: splitting a text at a pattern
gives the stretches between the same leftmost, non-overlapping matches.

Scale: texts are read in one narrow pass; what is kept per document is its spans
and proposals. The trees are fitted and the threshold is calibrated on every base match,
and all documents are judged.

Edge cases: a null text is empty. Empty texts and texts without a match have no
spans. Without both accepted and dropped matches to learn from, nothing is added.
Repeated rows are judged row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import store

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Possessive loops and the "start of a run or end of the last
#: match" condition change no match; they keep long runs linear and the stack flat.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A byte that every text with a match holds (cheap test before the pattern).
NEEDS = {"email": "@", "phone": "+"}
#: Generators: kind -> patterns of proposed spans.
LOOSE = {
    "email": [r"[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++"],
    "card": [r"(?<![0-9.+-])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?:[0-9]{1,3})?(?![0-9])"],
    "phone": [r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{3,4}){2}(?![0-9])",
              r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"],
}
HINTS = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|credit|account|ip|host|server|contact)[^A-Za-z0-9]*$"
FEATURES = ("kind_no", "chars", "digits", "groups", "luhn", "octets", "plus", "at", "before", "after", "hint", "first_digit")
PRECISION, SEED = 0.99, 7


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a digit string (false beyond 32 digits)."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    steps = F.when((n > 0) & (n <= 32), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    return (n > 0) & (n <= 32) & (F.aggregate(steps, F.lit(0), add) % 10 == 0)


def octets_ok(s: Column) -> Column:
    short = F.transform(F.split(s, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def accepted(kind: str, s: Column) -> Column:
    """The check that a base match must pass."""
    n = F.length(_digits(s))
    if kind == "ip":
        return octets_ok(s)
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn_ok(_digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,s>> of the matches ``found`` of ``pattern`` in ``text``
    (code points, end exclusive)."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out"))

    def step(acc, i):
        begin = acc["at"] + F.get(gaps, i)
        end = begin + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), F.get(found, i).alias("s")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"]))


def _find(text: Column, pattern: str, needs: str | None = None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(needs), hits).otherwise(F.array().cast("array<string>")) if needs else hits


def _described(text: Column, spans: Column, kind: str, base: bool) -> Column:
    """Spans with what the features need: 24 characters before, one after."""
    def one(x):
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
                        F.substr(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))).alias("pre"),
                        F.substr(text, x["end"] + 1, F.lit(1)).alias("post"),
                        F.lit(base).alias("base"), (accepted(kind, x["s"]) if base else F.lit(False)).alias("ok"))
    return F.transform(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,s:string>>")), one)


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, spans): every base match (ok or not) and every proposal, stored.
    ``row`` tells repeated rows apart."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = {f"base_{k}": _find(F.col("text"), BASE[k], NEEDS.get(k)) for k in KINDS}
    gate = {"email": F.col("text").contains("(at)") | F.col("text").contains("[at]"),
            "card": F.exists("base_card", lambda s: F.length(s) >= 16), "phone": F.exists("base_card", lambda s: F.length(s) >= 3)}
    df = df.withColumns(found)
    none = F.array().cast("array<string>")
    loose = {f"loose_{k}_{i}": F.when(gate[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none)
             for k, ps in LOOSE.items() for i, p in enumerate(ps)}
    df = df.withColumns(loose)
    text = F.col("text")
    parts = [_described(text, spans_of(text, BASE[k], F.col(f"base_{k}")), k, True) for k in KINDS]
    parts += [_described(text, spans_of(text, p, F.col(f"loose_{k}_{i}")), k, False) for k, ps in LOOSE.items() for i, p in enumerate(ps)]
    some = reduce(lambda a, b: a | b, [F.size(c) > 0 for c in [*found, *loose]])
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,s:string,pre:string,post:string,base:boolean,ok:boolean>>")
    df = df.select("doc_id", F.when(some, F.concat(*parts)).otherwise(empty).alias("spans"))
    return store(df.withColumn("row", F.monotonically_increasing_id()), "pii-spans")


def described(c: DataFrame) -> DataFrame:
    """Feature columns of candidates (columns of the span struct)."""
    digits = _digits(F.col("s"))
    side = lambda x: F.when(x == "", 0).when(x.rlike("[0-9]"), 1).when(x.rlike("[A-Za-z]"), 2).when(x.rlike(r"\s"), 3).otherwise(4)
    return c.withColumns({
        "kind_no": reduce(lambda o, i: F.when(F.col("kind") == KINDS[i], i).otherwise(o), range(4), F.lit(-1)).cast("double"),
        "chars": F.least(F.length("s"), F.lit(60)).cast("double"), "digits": F.least(F.length(digits), F.lit(40)).cast("double"),
        "groups": F.least(F.size(F.split("s", "[^0-9]+")), F.lit(20)).cast("double"),
        "luhn": luhn_ok(digits).cast("double"),
        "octets": (F.col("s").rlike(r"^[0-9]+(\.[0-9]+){3}$") & octets_ok(F.col("s"))).cast("double"),
        "plus": F.col("s").startswith("+").cast("double"), "at": F.col("s").rlike(r"@|[\[(]at[\])]").cast("double"),
        "before": side(F.substring("pre", -1, 1)).cast("double"), "after": side(F.col("post")).cast("double"),
        "hint": F.col("pre").rlike(HINTS).cast("double"), "first_digit": F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0))})


def fit_trees(candidates: DataFrame, precision: float = PRECISION):
    """(model, threshold) from all base matches, or None without both kinds of them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    known = candidates.filter("base").withColumn("label", F.col("ok").cast("double"))
    n = known.groupBy("label").count().collect()
    if len(n) < 2 or min(r["count"] for r in n) < 10:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(known))
    data = store(data.select("features", "label", (F.pmod(F.xxhash64(F.lit(SEED + 1), "row"), F.lit(4)) == 0).alias("held")), "pii-fit")
    if data.filter("not held").select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=SEED, minInstancesPerNode=2).fit(data.filter("not held"))
    held = _probability(model, data.filter("held")).groupBy((F.floor(F.col("p") * 100) / 100).alias("p")).agg(
        F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # at most 101 rows
    threshold, good, seen = 1.01, 0.0, 0
    for r in held:
        good, seen = good + r["good"], seen + r["n"]
        if good / seen >= precision:
            threshold = r["p"]
    return model, max(threshold, 0.5)


def _probability(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, added): arrays of (kind_no, start, end), each in order of kind
    and start. ``base`` holds the rules' spans, ``added`` those the trees accept."""
    from pyspark.ml.feature import VectorAssembler
    rows = propose(docs, id_col, text_col)
    as_span = lambda x: F.struct((F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]) - 1).cast("int").alias("kind_no"),
                                 x["start"].alias("start"), x["end"].alias("end"))
    kept = F.array_sort(F.transform(F.filter("spans", lambda x: x["base"] & x["ok"]), as_span))
    rows = rows.withColumn("kept", kept)
    fitted = fit_trees(rows.select("row", F.inline("spans")), precision)
    nothing = F.array().cast(rows.schema["kept"].dataType)
    if fitted is None:
        return rows.select("doc_id", F.col("kept").alias("base"), nothing.alias("added"))
    model, threshold = fitted
    # proposals that touch no base span
    free = F.filter("spans", lambda x: ~x["base"] & ~F.exists("kept", lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])))
    props = rows.select("row", F.inline(free))
    props = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(props))
    # a proposed card must also be a possible number
    good = _probability(model, props).filter((F.col("p") >= threshold) & ((F.col("kind") != "card") | (F.col("luhn") == 1)))
    best = good.groupBy("row").agg(F.collect_set(F.struct(
        F.col("kind_no").cast("int").alias("kind_no"), "start", "end", "p")).alias("c"))
    # of overlapping accepted spans, the likelier (then the longer, then the earlier) one stays
    def better(a, b):
        return (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["end"] - a["start"] > b["end"] - b["start"]) | (
            (a["end"] - a["start"] == b["end"] - b["start"]) & (F.struct(a["start"], a["kind_no"]) < F.struct(b["start"], b["kind_no"])))))
    alone = F.filter("c", lambda b: ~F.exists("c", lambda a: (a["start"] < b["end"]) & (b["start"] < a["end"]) & better(a, b)))
    best = best.select("row", F.array_sort(F.transform(alone, lambda x: F.struct(x["kind_no"], x["start"], x["end"]))).alias("added"))
    return rows.join(best, "row", "left").select("doc_id", F.col("kept").alias("base"), F.coalesce(F.col("added"), nothing).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind_no"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[PII]") -> Column:
    """The text with every span (start, end; merged where they overlap) replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"])))

    def step(acc, x):
        new = x["start"] >= acc["at"]
        gap = F.when(new, F.concat(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.greatest(F.length(text) - done["at"], F.lit(0))))
