"""Personal data by generated candidates and boosted trees, in native columns only.

Base rules give spans that always stay: e-mail addresses, IPv4 addresses, card and
phone numbers. On top of them, high-recall generators propose overlapping spans
(spelled-out addresses, numbers of any grouping, formats inside longer matches).
Boosted trees, taught on all documents by what the base rules accept and refuse,
score each proposal by its format and its context; per-kind thresholds, calibrated
on rows kept aside, select what is added. The trees become column expressions, so
that finding and redacting are one pass over the texts without a shuffle.

Every pattern runs in linear time: runs are possessive, and a match may start only
where its run starts or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.scratch import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's patterns to be tried.
HINT = {"email": r"@|[\[(](?i:at)[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){3}", "phone": r"\+[0-9]"}
#: The same for the wide generators.
WIDE_HINT = HINT | {"phone": r"[0-9][\x20./-]?[0-9]"}
WIDE = {
    "email": [rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|[\[(](?i:at)[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)*+"],
    "ip": [r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}(?![0-9])", r"(?<![0-9])[0-9]{13,19}(?![0-9])"],
    "phone": [
        r"(?:\+|(?<![0-9]))[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]++(?:[\x20./-][0-9]++)*+",
    ],
}
CONTEXT = {"email": "mail|contact|write|@", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|konto|carte|tarjeta", "phone": "tel|phone|call|fax|mobil"}
FEATURES = ["kind", "size", "digits", "groups", "plus", "brackets", "dots", "blanks", "luhn", "octets", "letter_before", "digit_before", "letter_after", "digit_after", "named", "stretch"]
_NONE = "array<struct<start:int,stop:int,body:string,digits:string>>"


def located(text: Column, pattern: str) -> Column:
    """start, stop (code points, stop exclusive), body and its digits of each leftmost non-overlapping match."""
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(bodies), F.lit(0)))
    steps = F.zip_with(gaps, bodies, lambda gap, body: F.struct(F.length(gap).alias("gap"), F.length(body).alias("own"), body.alias("body"), F.regexp_replace(body, "[^0-9]+", "").alias("digits")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["own"]).alias("stop"), x["body"].alias("body"), x["digits"].alias("digits"))
        return F.struct((begin + x["own"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Does a short digit string pass the Luhn check?"""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _octets(body: Column) -> Column:
    """Are all numbers between dots at most 255? Leading zeros don't count."""
    return F.forall(F.split(body, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _passes(kind: str, span: Column) -> Column:
    digits = span["digits"]
    if kind == "ip":
        return _octets(span["body"])
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _if_hinted(hint: str, text: Column, found: Column) -> Column:
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(_NONE))


def base_spans(kind: str, text: Column) -> Column:
    """Spans of a kind by its base rule: failing matches are dropped, without a second try."""
    return _if_hinted(HINT[kind], text, F.filter(located(text, BASE[kind]), lambda m: _passes(kind, m)))


def _clear_of(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))


def _features(kind: str, text: Column, span: Column) -> Column:
    """Format and context of a proposed span as a struct of doubles, in the order of FEATURES."""
    body, digits = span["body"], span["digits"]
    count = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    before = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    after = F.substring(text, span["stop"] + 1, F.lit(1))
    short = F.length(digits).between(12, 19)
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "size": F.least(F.length(body), F.lit(99)),
        "digits": F.least(F.length(digits), F.lit(40)),
        "groups": F.least(F.size(F.split(body, "[^0-9]+")), F.lit(20)),
        "plus": body.startswith("+"),
        "brackets": F.least(count("()[]"), F.lit(9)),
        "dots": F.least(count("."), F.lit(9)),
        "blanks": F.least(count(" "), F.lit(9)),
        "luhn": F.when(short, _luhn(digits)).otherwise(False),
        "octets": _octets(body) if kind == "ip" else F.lit(False),
        "letter_before": before.rlike(r"\p{L}$"),
        "digit_before": before.rlike(r"[0-9][\x20-]?$"),
        "letter_after": after.rlike(r"^\p{L}"),
        "digit_after": after.rlike("^[0-9]"),
        "named": F.lower(before).rlike(CONTEXT[kind]),
        "stretch": body.contains("@"),
    }
    return F.struct(*[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def proposals(kind: str, text: Column) -> Column:
    """Overlapping spans of a kind from its wide generators, by start."""
    wide = [located(text, p) for p in WIDE[kind]]
    every = F.concat(*wide) if len(wide) > 1 else wide[0]
    every = F.filter(every, lambda s: F.length(s["digits"]).between(7, 19)) if kind in ("card", "phone") else every
    return _if_hinted(WIDE_HINT[kind], text, F.array_sort(F.array_distinct(every)))


@dataclass
class Model:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, their weights, and a threshold by kind.

    A kind without a threshold gets nothing added.
    """

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    cuts: dict[str, float] = field(default_factory=dict)

    def margin(self, features: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(features[FEATURES[feature]] <= threshold, value(left)).otherwise(value(right))

        return reduce(lambda a, b: a + b, [value(t) * F.lit(float(w)) for t, w in zip(self.trees, self.weights)])


def _tree(node) -> object:
    """A fitted tree's nodes as plain tuples."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = 8, depth: int = 3, precision: float = 0.95, least: int = 20) -> Model:
    """Fit on the proposals of all documents, whole texts.

    A proposal that is a base span is a positive, one that touches none a negative. A
    quarter is kept aside; a kind's threshold is the lowest score from which on the
    share of positives there is ``precision`` (kinds with fewer than ``least`` positives
    aside get none). Features are small whole numbers: proposals with the same ones are
    counted, and learned from once with their number as the weight.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    body = F.col("text")
    labelled = []
    for kind in KINDS:
        # the plain scan comes first, so that each array is worked out once
        spans = rows.filter(body.rlike(WIDE_HINT[kind])).select("doc_id", "text", base_spans(kind, body).alias("base"), proposals(kind, body).alias("wide"))
        one = spans.select("doc_id", "text", "base", F.explode("wide").alias("s"))
        exact = F.exists("base", lambda b: (b["start"] == F.col("s.start")) & (b["stop"] == F.col("s.stop")))
        touch = F.exists("base", lambda b: (b["start"] < F.col("s.stop")) & (F.col("s.start") < b["stop"]))
        labelled.append(one.filter(exact | ~touch).select("doc_id", exact.cast("double").alias("label"), _features(kind, body, F.col("s")).alias("f")))
    aside = (F.pmod(F.xxhash64("doc_id", "f"), F.lit(4)) == 0).alias("aside")
    seen = reduce(DataFrame.unionByName, labelled).select("label", "f.*", aside)
    seen = seen.groupBy("label", "aside", *FEATURES).agg(F.count("*").cast("double").alias("n"))
    # the same order each time
    seen = materialize(seen.repartition(4, F.xxhash64(*FEATURES)).sortWithinPartitions("label", "aside", *FEATURES), "spans")
    if seen.filter("not aside").select("label").distinct().count() < 2:
        return Model()
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, weightCol="n").fit(vector.transform(seen.filter("not aside")))
    model = Model([_tree(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights))
    scored = seen.filter("aside").select("kind", "label", "n", F.round(model.margin(F.struct(*FEATURES)), 6).alias("margin"))
    by = scored.groupBy("kind", "margin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    for i, kind in enumerate(KINDS):
        good = n = 0.0
        steps = sorted((r for r in by if r["kind"] == i), key=lambda r: -r["margin"])
        if sum(r["good"] for r in steps) < least:
            continue
        for r in steps:
            good, n = good + r["good"], n + r["n"]
            if good / n >= precision and r["margin"] > 0:
                model.cuts[kind] = r["margin"] - 1e-6
    return model


def _added(kind: str, text: Column, base: Column, model: Model) -> Column:
    """Selected proposals clear of base spans; of overlapping ones the first to start, then the longest."""
    if kind not in model.cuts:
        return F.array().cast(_NONE)
    free = _clear_of(proposals(kind, text), base)
    # features first, so that the trees compare values that are there
    seen = F.transform(free, lambda s: F.struct(s.alias("s"), _features(kind, text, s).alias("f")))
    chosen = F.transform(F.filter(seen, lambda x: model.margin(x["f"]) >= model.cuts[kind]), lambda x: x["s"])
    ordered = F.array_sort(chosen, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))

    def keep(acc: Column, s: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)["stop"]).otherwise(0)
        return F.when(s["start"] >= last, F.concat(acc, F.array(s))).otherwise(acc)

    return F.when(F.size(chosen) > 0, F.aggregate(ordered, F.array().cast(_NONE), keep)).otherwise(F.array().cast(_NONE))


def with_spans(rows: DataFrame, model: Model, text: str, base: str = "base", spans: str = "spans") -> DataFrame:
    """``rows`` with two arrays of (start, order, kind, stop), by start and kind: base spans, all spans.

    Each step is a projection of its own: what is used several times is worked out once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = rows.columns
    step = rows.select(*keep, *[base_spans(k, body).alias(f"__{k}") for k in KINDS])
    step = step.select(*step.columns, *[_added(k, body, F.col(f"__{k}"), model).alias(f"__{k}_more") for k in KINDS])

    def named(kind: str, suffix: str) -> Column:
        of = lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), m["stop"].alias("stop"))
        return F.transform(f"__{kind}{suffix}", of)

    def listed(suffixes: list[str]) -> Column:
        return F.array_sort(F.concat(*[named(k, s) for k in KINDS for s in suffixes]))

    return step.select(*keep, listed([""]).alias(base), listed(["", "_more"]).alias(spans))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; all columns stay, NULL texts too."""
    holder, work = "__spans", "__text"
    rows = with_spans(docs.withColumn(work, F.col(text)), model, work, "__base", holder)
    body = F.col(work)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.when(s["stop"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["stop"].alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["stop"].alias("at"), new.alias("out")))

    whole = F.aggregate(holder, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    new = F.when(F.size(holder) > 0, whole).otherwise(body)
    return rows.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of ``docs``.

    * The counts and base_sha256 (of kind:start:end, by start and kind, comma-joined)
      are of the base spans; spans lists these and what the trees added, joined likewise.
    * A NULL or empty text has no spans. Offsets are code points, ends exclusive. Kinds
      are searched apart, so spans of different kinds may overlap. Repeated rows get
      equal answers; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, doc_id, text) if model is None else model
    rows = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
