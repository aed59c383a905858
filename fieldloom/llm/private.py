"""Personal data by candidate gradient boosting, with column functions only.

1. Generators propose spans, which may overlap: the four base patterns, whose matches also have to
   pass a check (base spans), and a looser pattern per kind with other signs in the place of the
   plain ones. Base spans always stay.
2. Boosted trees score every proposal by its format, with the signs that the base patterns ask for
   written alike, and by its context. They learn from all proposals of all rows but held-out ones:
   one that lies on a base span of its kind is positive, any other negative, with less weight where
   no base pattern has judged it.
3. On the held-out rows, three in ten by hash, every kind gets the least score from which on enough
   proposals are positive. Proposals from there on are added where no base span and no better one
   lies, but never a match of a base pattern that failed its check.

All work on a text stays in its row: nothing is shuffled but the numbers of proposals, equal ones as
one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import let
from fieldloom.llm.stage import whole_text, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive where giving back could not help; a match of the
# first begins where a run of its characters begins, or where the match before ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: bracketed or spelled-out signs, other separators, no country code.
_AT, _DOT = r"\x20?[\[({]\x20?at\x20?[\])}]\x20?", r"\x20?[\[({]\x20?dot\x20?[\])}]\x20?"
LOOSE = {
    "email": rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:(?:{_AT}|＠)[A-Za-z0-9-]++(?:(?:\.|{_DOT}|\x20dot\x20)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?i)(?<![0-9.])[0-9]{1,3}+(?:(?:\x20?\[(?:\.|dot)\]\x20?|\x20?\((?:\.|dot)\)\x20?|\x20\.\x20)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{2,}+(?:[\x20._/ -]{1,2}+[0-9]{2,}+)++",
    "phone": r"(?<![0-9A-Za-z+(])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}+\)?){1,5}+(?![0-9A-Za-z])",
}
# What a text must have for a pattern to be tried: cheap searches first, most texts have nothing.
_SPELLED = r"(?i)[\[({]\x20?at\x20?[\])}]"


def _hint(source: str, kind: str, text: Column) -> Column:
    digits = F.col("_digits")
    any_of = lambda *parts: reduce(lambda a, b: a | b, [text.contains(part) for part in parts])
    return {
        ("base", "email"): any_of("@"),
        ("base", "ip"): digits & text.contains("."),
        ("base", "card"): digits,
        ("base", "phone"): digits & text.contains("+"),
        ("loose", "email"): any_of("＠", " dot ", " Dot ", " DOT ") | (any_of("(", "[", "{") & text.rlike(_SPELLED)),
        ("loose", "ip"): digits & any_of("(", "[", " . "),
        ("loose", "card"): digits,
        ("loose", "phone"): digits,
    }[source, kind]


CUES = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|pay",
    "phone": r"(?i)\btel|phone|call|fax|mobile",
}
ID_CUES = r"(?i)token|key|sha|hash|\bid\b|ref|order|isbn|version"

# Examples that training fits to, at least.
LEAST_POSITIVES = 20
# Share of held-out proposals from a threshold on that must be positive.
PRECISION = 0.95
UNJUDGED_WEIGHT = 0.5
CONTEXT = 24

FEATURES = (
    "kind", "digits", "groups", "last_group", "longest_group", "letters", "luhn", "octets",
    "top_label", "labels", "distinct_digits", "left", "right", "cue", "id_cue",
)


def _running_sums(sizes: Column) -> Column:
    """Inclusive running sums of an array, in as many steps as the logarithm of its size."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    shift = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(steps, sizes, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - shift(k)), F.lit(0))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether at most 20 digits have a check sum of Luhn that ends in 0."""

    def total(row: Column) -> Column:
        one = lambda text, i: F.substring(text, i, 1).cast("int")
        return reduce(lambda x, y: x + y, [one(row["doubled"] if i % 2 else row["plain"], i) for i in range(1, 21)])

    # In an array of one, so that the padded digits are made once and not for every place.
    plain = F.lpad(digits, 20, "0")
    row = F.array(F.struct(plain.alias("plain"), F.translate(plain, "0123456789", "0246813579").alias("doubled")))
    return F.get(F.transform(row, total), F.lit(0)) % 10 == 0


_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _passes(kind: str, value: Column, digits: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & passes_luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(text: Column, source: str, kind: str) -> dict[str, Column]:
    """Matches of a pattern and what lies between them, for texts that have its hint."""
    pattern = (BASE if source == "base" else LOOSE)[kind]
    hit = _hint(source, kind, text)
    nothing = F.array().cast("array<string>")
    name = f"_{source}_{kind}"
    return {
        f"{name}_found": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing),
        f"{name}_parts": F.when(hit, F.split(text, pattern, -1)).otherwise(nothing),
    }


def _proposals(source: str, kind: str) -> Column:
    """Spans of a pattern with value and context, from the columns of ``_found``."""
    found, parts = F.col(f"_{source}_{kind}_found"), F.col(f"_{source}_{kind}_parts")
    sizes = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda f, p: F.char_length(f) + F.char_length(p))
    number = F.lit(KINDS.index(kind))

    def span(end: Column, i: Column) -> Column:
        value = F.get(found, i)
        return F.struct(
            (end - F.char_length(value)).alias("start"),
            number.alias("kind"),
            end.alias("end"),
            value.alias("value"),
            F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"),
            _digits(value).alias("digits"),
            F.lit(source == "base").alias("judged"),
        )

    spans = F.transform(_running_sums(sizes), span)
    checked = F.transform(spans, lambda s: s.withField("base", _passes(kind, s["value"], s["digits"]) if source == "base" else F.lit(False)))
    return F.when(F.size(found) > 0, checked).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string,digits:string,judged:boolean,base:boolean>>"


def proposals(docs: DataFrame, text: str, name: str = "_spans") -> DataFrame:
    """``docs`` with all proposed spans of its whole texts in one array, base and loose ones."""
    pairs = [(source, kind) for source in ("base", "loose") for kind in KINDS]
    docs = docs.withColumn("_digits", whole_text(text).rlike("[0-9]"))
    matched = docs.withColumns({k: v for source, kind in pairs for k, v in _found(whole_text(text), source, kind).items()})
    spans = matched.withColumn(name, F.concat(*(_proposals(*pair) for pair in pairs)))
    return spans.drop("_digits", *(f"_{source}_{kind}_{part}" for source, kind in pairs for part in ("found", "parts")))


def _beside(char: Column) -> Column:
    """0 where nothing or white space stands, 1 a letter, 2 a digit, 3 anything else."""
    return F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike(r"^[0-9]"), 2).when(char.rlike(r"^\p{L}"), 1).otherwise(3)


def _alike(span: Column) -> Column:
    """The text of a proposal with the signs of the base patterns and those in their place written
    alike, without the code of a country."""
    value = span["value"]
    mail = F.regexp_replace(value, rf"(?i){_AT}|＠|\x20at\x20", "@")
    mail = F.regexp_replace(mail, rf"(?i){_DOT}|\x20dot\x20|\x20?\[\.\]\x20?|\x20?\(\.\)\x20?|\x20\.\x20", ".")
    return F.when(span["kind"] == 3, F.regexp_replace(value, r"^\+[0-9]{1,3}(?=[\x20(.-])", "")).otherwise(mail)


def features(spans: Column) -> Column:
    """For every proposal its numbers on format and context, as an array in the order of ``FEATURES``.

    In two steps, so that what several numbers need is made once."""
    parts = F.transform(
        spans,
        lambda s: F.struct(
            s.alias("s"),
            _alike(s).alias("alike"),
            F.transform(F.filter(F.split(_alike(s), "[^0-9]+", -1), lambda g: g != ""), F.char_length).alias("sizes"),
            F.split(F.regexp_extract(_alike(s), "@(.*)$", 1), r"\.", -1).alias("labels"),
        ),
    )

    def numbers(x: Column) -> Column:
        s, sizes, labels = x["s"], x["sizes"], x["labels"]
        kind, value, digits = s["kind"], s["value"], s["digits"]
        cue = F.lit(False)
        for i, name in enumerate(KINDS):
            cue = F.when(kind == i, s["before"].rlike(CUES[name])).otherwise(cue)
        flag = lambda c: F.when(c, 1).otherwise(0)
        own = [
            kind,
            F.aggregate(sizes, F.lit(0), lambda a, b: a + b),
            F.size(sizes),
            F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)),
            F.coalesce(F.array_max(sizes), F.lit(0)),
            F.char_length(F.regexp_replace(value, "[^A-Za-z]", "")),
            flag(F.char_length(digits).between(12, 19) & passes_luhn(digits)),
            flag((kind == 1) & x["alike"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
            F.char_length(F.element_at(labels, -1)),
            F.size(labels),
            F.size(F.array_distinct(F.split(digits, ""))),
            _beside(F.right(s["before"], F.lit(1))),
            _beside(F.left(s["after"], F.lit(1))),
            flag(cue),
            flag(s["before"].rlike(ID_CUES)),
        ]
        return F.array(*(c.cast("double") for c in own))

    return F.transform(parts, numbers)


@dataclass
class Selector:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, with their
    weights, and the least score of every kind; a kind without one adds nothing."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, numbers: list[Column]) -> Column:
        """Probability of a proposal with these features."""

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(numbers[feature] <= threshold, value(left)).otherwise(value(right))

        margin = reduce(lambda a, b: a + b, [F.lit(weight) * value(tree) for weight, tree in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> object:
    if "Leaf" in node.getClass().getSimpleName():
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _lies_on(s: Column, spans: Column) -> Column:
    """Whether a span shares half of what both cover with one of ``spans``, which are in order and
    do not overlap: such a one holds or touches the middle, so it is found by halving."""
    middle = s["start"] + s["end"]
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    powers = F.reverse(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(spans), F.lit(1)))).cast("int")))
    last = F.aggregate(powers, F.lit(-1), lambda at, k: F.when(2 * F.get(spans, at + step(k))["start"] <= middle, at + step(k)).otherwise(at))
    half = lambda b: 2 * (F.least(b["end"], s["end"]) - F.greatest(b["start"], s["start"])) >= F.greatest(b["end"], s["end"]) - F.least(b["start"], s["start"])
    near = lambda at: F.exists(F.array(F.get(spans, at), F.get(spans, at - 1)), lambda b: b.isNotNull() & half(b))
    return F.when(F.size(spans) > 0, let(last, near)).otherwise(False)


def labelled_proposals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All proposals of all rows: their features, ``label`` and whether they are ``held_out``, by a
    hash of key and text. Equal ones are one row with their number ``n`` and summed ``weight``."""
    some = docs.select(F.xxhash64(key, text).alias("_hash"), F.col(text).alias("_text"))
    # Without a filter on the spans: it would move below the patterns and match them for every span.
    rows = proposals(some, "_text")
    of_kind = lambda k: F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))
    rows = rows.select("_hash", "_spans", *(of_kind(k).alias(f"_base_{k}") for k in range(len(KINDS))))

    # Each proposal is put forward as every kind: as a foreign one it is an example of what is not
    # that kind.
    def as_kind(s: Column, k: int) -> Column:
        judged = s["judged"] | (s["kind"] != k)
        return F.struct(s.withField("kind", F.lit(k)).alias("s"), _lies_on(s, F.col(f"_base_{k}")).alias("label"), judged.alias("judged"))

    put = F.flatten(F.transform("_spans", lambda s: F.array(*(as_kind(s, k) for k in range(len(KINDS))))))
    flat = rows.select("_hash", F.explode(put).alias("x"))
    flat = flat.select("_hash", "x", F.get(features(F.array("x.s")), F.lit(0)).alias("numbers"))
    each = flat.select(
        *(F.get("numbers", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)),
        F.col("x.label").cast("double").alias("label"),
        F.when(F.col("x.label") | F.col("x.judged"), 1.0).otherwise(UNJUDGED_WEIGHT).alias("weight"),
        (F.pmod(F.shiftright("_hash", 24), F.lit(10)) < 3).alias("held_out"),
    )
    return each.groupBy(*FEATURES, "label", "held_out").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def fit_selector(examples: DataFrame, precision: float = PRECISION, trees: int = 12, depth: int = 4) -> Selector:
    """Trees and thresholds from labelled proposals; without enough of both labels, none."""
    counts = {(r["held_out"], r["label"]): r for r in examples.groupBy("held_out", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    learned = [counts.get((False, label)) for label in (0.0, 1.0)]
    if any(r is None or r["n"] < LEAST_POSITIVES for r in learned):
        return Selector()
    # As many bins as make Spark look for splits in all rows: it takes their square, else a sample.
    bins = max(32, math.isqrt(sum(r["rows"] for r in learned)) + 1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples.where(~F.col("held_out")))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=7, weightCol="weight", minInstancesPerNode=1).fit(table.select("features", "label", "weight"))
    selector = Selector([(w, _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)])

    score = selector.score([F.col(name) for name in FEATURES])
    held = examples.where("held_out").select(F.col("kind").cast("int").alias("kind"), F.floor(score * 100).cast("int").alias("step"), "label", "weight")
    steps = held.groupBy("kind", "step").agg(F.sum(F.col("weight") * F.col("label")).alias("pos"), F.sum(F.col("weight") * (1 - F.col("label"))).alias("neg")).collect()  # 101 per kind at most
    for kind in range(len(KINDS)):
        pos = neg = 0.0
        for row in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            pos, neg = pos + row["pos"], neg + row["neg"]
            if pos >= LEAST_POSITIVES and pos >= precision * (pos + neg + 1):
                selector.thresholds[kind] = row["step"] / 100
    return selector


def _chosen(selector: Selector) -> Column:
    """Proposals of ``_open`` that the selector adds: none on a base span, of overlapping ones the
    best (by score, then length, then place), walked in order of their starts."""
    if not selector.thresholds:
        return F.filter("_open", lambda s: F.lit(False))
    least = F.create_map(*(F.lit(x) for pair in selector.thresholds.items() for x in pair))

    rated = F.zip_with(
        "_open",
        features(F.col("_open")),
        lambda s, x: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            s["base"].alias("base"),
            F.when(s["base"], 2.0).otherwise(selector.score([F.get(x, F.lit(i)) for i in range(len(FEATURES))])).alias("score"),
        ),
    )
    enough = F.filter(rated, lambda s: s["base"] | F.coalesce(s["score"] >= F.try_element_at(least, s["kind"]), F.lit(False)))
    kind = "struct<start:int,end:int,kind:int,base:boolean,score:double>"
    none = F.lit(None).cast(kind)
    begin = F.struct(none.alias("held"), F.lit(0).alias("till"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        held, till, out = acc["held"], acc["till"], acc["out"]
        meets = held.isNotNull() & (s["start"] < held["end"])
        size = lambda x: x["end"] - x["start"]
        better = (s["score"] > held["score"]) | ((s["score"] == held["score"]) & (size(s) > size(held)))
        free = held.isNotNull() & ~meets
        flushed = F.when(free, F.array_append(out, held)).otherwise(out)
        inside = s["start"] < till
        return (
            F.when(s["base"], F.struct(F.when(meets, none).otherwise(held).alias("held"), F.greatest(till, s["end"]).alias("till"), out.alias("out")))
            .when(inside, acc)
            .when(meets, F.struct(F.when(better, s).otherwise(held).alias("held"), till.alias("till"), out.alias("out")))
            .otherwise(F.struct(s.alias("held"), till.alias("till"), flushed.alias("out")))
        )

    walked = F.aggregate(F.array_sort(enough), begin, step, lambda acc: F.when(acc["held"].isNotNull(), F.array_append(acc["out"], acc["held"])).otherwise(acc["out"]))
    return F.when(F.exists("_open", lambda s: ~s["base"]), walked).otherwise(F.array().cast(f"array<{kind}>"))


def find_private(docs: DataFrame, selector: Selector | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of ``start, kind, end`` in order: code
    points, end exclusive, ``kind`` as a place in ``KINDS``. ``spans`` has those of the trees, too.

    Without a ``selector`` one is trained on ``docs``. Null and empty texts have no spans; repeated
    rows are repeated; columns with the names of added ones are replaced, others stay. Texts of any
    length and number of spans are read whole.
    """
    docs = docs.drop("base_spans", "spans")
    selector = selector or fit_selector(written(labelled_proposals(docs, key, text)))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    rows = proposals(docs, text)
    base = F.array_sort(F.transform(F.filter("_spans", lambda s: s["base"]), plain))
    opened = rows.withColumns({"base_spans": base, "_open": F.filter("_spans", lambda s: s["base"] | ~s["judged"])})
    both = opened.withColumn("_added", F.transform(_chosen(selector), plain))
    return both.withColumn("spans", F.array_sort(F.concat("base_spans", "_added"))).drop("_spans", "_open", "_added")


def as_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: Callable[[str], str] = lambda kind: f"[{kind}]") -> Column:
    """A text with a mark in the place of every span; of overlapping spans the first one's mark
    stands for all."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    marks = F.array(*(F.lit(mark(kind)) for kind in KINDS))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        shown = F.when(apart, F.concat(acc["out"], gap, F.get(marks, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), shown.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)
