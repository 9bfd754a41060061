"""Personal data: fixed patterns give seeds, and bootstrapped contextual extraction finds what they miss.

Seeds induce lexical patterns, the words around them. Spark scores the graph of patterns and instances in rounds: a
pattern is as sure as the share of its different values that are known instances of a kind, an instance as sure as its
patterns make it together. The places of sure instances in sure patterns are what the method finds; a seed beyond the
base kinds counts only where such a pattern confirms it.

Built-in functions only. Positions of matches are running sums of the lengths of what a text is split into, taken by
doubling steps, so a text of many matches costs no more than sorting them would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.skew import splittable_join
from lightsieve.session import discard, materialize

#: base kinds, then kinds that are only seeds of the method
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
CHECKED = ("ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns. A match cannot start inside a run that failed from its first character on, so runs are
#: entered at their start (or where the last match ended) and are never given back: linear time on junk.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # seeds alone, never a result by themselves: 32 hex digits or more, letters among them
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])",
}
#: what may be an identifier that the patterns miss: a run without spaces, quotes, brackets and marks, with a digit or an at sign
_MARKS = r"\s\"'<>()\[\]{},;!?|*%$&"
CANDIDATE = rf"(?:(?<![^{_MARKS}])|\G)[^{_MARKS}0-9@]*+[0-9@][^{_MARKS}]*+"
#: what must stand somewhere in a text that has a match which counts
NEEDED = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "secret": "[0-9a-f]{32}",
}
CONTEXT_CHARS = 80  # a context's words are whole ones among as many characters
_OPENING, _CLOSING = r"[\"'`(\[{<]", r"[\"'`)\]}>.,;:!?]"
_MATCH = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima, ...) of an array, each element included, in log2(size) passes over it."""
    n = F.size(values)

    def double(acc: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        earlier = F.concat(F.array_repeat(F.lit(None).cast("int"), shift), F.slice(acc, 1, F.size(acc) - shift))
        return F.zip_with(acc, earlier, lambda a, b: F.when(b.isNull(), a).otherwise(both(a, b)))

    return F.when(n < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), values, double))


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches in code points, end exclusive, with what stands around them.

    left and right: the whole words among CONTEXT_CHARS characters on either side, back to the start of the match
    before and up to the end of the one after it.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(found)
    sizes = F.zip_with(F.slice(between, 1, n), found, lambda b, v: (F.length(b) + F.length(v)).cast("int"))
    ends = running(sizes, lambda a, b: a + b)
    value = F.zip_with(found, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
    before = F.concat(F.array(F.lit("")), F.slice(found, 1, n - 1))
    near = F.lit(CONTEXT_CHARS + 1)  # one more, to tell whether the furthest word is cut
    whole_words = lambda side, cut: F.when(F.length(side) > CONTEXT_CHARS, F.regexp_replace(side, cut, "")).otherwise(side)
    left = F.zip_with(before, F.slice(between, 1, n), lambda v, b: whole_words(F.right(F.concat(v, b), near), r"^\S+"))
    after = F.concat(F.slice(found, 2, n), F.array(F.lit("")))
    right = F.zip_with(F.slice(between, 2, n), after, lambda b, v: whole_words(F.left(F.concat(b, v), near), r"\S+$"))
    whole = F.zip_with(F.zip_with(value, left, lambda m, x: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), x.alias("left"))), right, lambda m, x: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left"), x.alias("right")))
    return F.when(n > 0, whole.cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit doubled, less 9 when above 9."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.when(F.length(F.regexp_replace(part, "^0+", "")) > 3, False).otherwise(F.regexp_replace(part, "^0+", "0").cast("int") <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    raise ValueError(kind)


def _check(kind: str):
    return lambda m: valid(kind, m["value"])


def _of_kind(kind: Column):
    return lambda m: F.struct(kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"))


def seed_spans(text: Column, has_digit: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """array<struct<kind (place in KINDS), start, end, value, left, right>>, by kind and start."""
    parts = []
    for kind in kinds:
        needed = has_digit & text.rlike(NEEDED[kind]) if kind in NEEDED else F.contains(text, F.lit("@"))
        found = F.when(needed, matches(text, PATTERNS[kind])).otherwise(F.array().cast(_MATCH))
        if kind in CHECKED:
            found = F.filter(found, _check(kind))
        parts.append(F.transform(found, _of_kind(F.lit(KINDS.index(kind)))))
    return F.concat(*parts)


def clear_of(candidates: Column, spans: Column) -> Column:
    """The candidates that no span overlaps, found in one order of both by their starts."""
    mark = lambda is_span: lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(is_span).alias("span"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"))
    both = F.array_sort(F.concat(F.transform(candidates, mark(False)), F.transform(spans, mark(True))))
    ends = running(F.transform(both, lambda m: F.when(m["span"], m["end"]).otherwise(-1).cast("int")), lambda a, b: F.greatest(a, b))
    starts = F.reverse(running(F.reverse(F.transform(both, lambda m: F.when(m["span"], m["start"]).otherwise(2**31 - 1).cast("int"))), lambda a, b: F.least(a, b)))
    kept = F.zip_with(F.zip_with(both, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"))), starts, lambda x, s: F.when(~x["m"]["span"] & (x["e"] <= x["m"]["start"]) & (s >= x["m"]["end"]), x["m"]))
    return F.filter(kept, lambda m: m.isNotNull())


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: the name it is assigned to, the two words before it, the word on either side.

    Case is folded, numbers are all written 0, and quotes, brackets and stops next to the place are left out.
    """
    fold = lambda side, marks: F.regexp_replace(F.regexp_replace(F.lower(side), marks, ""), "[0-9]++", "0")
    left, right = fold(left, rf"{_OPENING}+$"), fold(right, rf"^{_CLOSING}+")
    before2 = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    before, after = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(right, r"^\s*(\S+)", 1)
    name = F.regexp_extract(left, r"([\p{L}0-9_-]+)[\"'`]?\s*[=:]\s*$", 1)
    found = F.array(
        F.when(name != "", F.concat(F.lit("assigned "), name)),
        F.when(before2 != "", F.concat(F.lit("before "), F.regexp_replace(before2, r"\s+", " "))),
        F.when((before != "") & (after != ""), F.concat(F.lit("around "), before, F.lit(" _ "), after)),
    )
    return F.filter(found, lambda c: c.isNotNull())


def score_graph(edges: DataFrame, rounds: int, smoothing: float) -> tuple[DataFrame, DataFrame]:
    """Sure patterns and instances, (pattern, kind, score) and (value, kind, score).

    edges: (pattern, value, kind), different rows; kind is null for unknown values. Patterns score by the weight of
    known values over all of their different values plus ``smoothing``, so copies of a text add nothing; instances by
    how likely it is that one of their patterns is right. Known values keep score 1.
    """
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    known = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    unknown = materialize(edges.filter("kind is null").select("pattern", "value"), "unknown-edges")
    seeds = materialize(edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("weight")), "seed-weights")
    instances = None
    patterns = None
    for _ in range(rounds):
        weights, before = seeds, [x for x in (patterns, instances) if x is not None]
        if instances is not None:
            gained = unknown.join(instances, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("weight"))
            weights = seeds.unionByName(gained).groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"))
        patterns = materialize(splittable_join(weights, totals, ["pattern"]).select("pattern", "kind", F.least(F.lit(0.999), F.col("weight") / (F.col("total") + smoothing)).alias("score")), "patterns")
        instances = materialize(
            unknown.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score")),
            "instances",
        )
        discard(*before)
    discard(unknown, seeds)
    return patterns, instances.unionByName(known)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, smoothing: float = 2.0, sure: float = 0.8) -> DataFrame:
    """(id_col, base, found): spans by fixed patterns and by the method, array<struct<kind, start, end, value>>.

    One row for each input row, repeated ones and those without id too. Null texts count as empty, empty texts have
    no spans, long ones are searched whole; an empty table gives no rows. ``found`` holds what learned patterns find:
    candidates that overlap no seed, and seeds of the kinds beyond the base ones. With no seeds at all nothing is
    learned. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    rows = rows.select("row", "id", seed_spans(F.col("text"), F.col("digit")).alias("seeds"), F.when(F.col("digit") | F.contains("text", F.lit("@")), matches(F.col("text"), CANDIDATE)).otherwise(F.array().cast(_MATCH)).alias("candidates"))
    place = lambda kind: lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), contexts(s["left"], s["right"]).alias("patterns"))
    places = F.concat(F.transform("seeds", place(lambda s: s["kind"])), F.transform("other", place(lambda s: F.lit(None).cast("int"))))
    marked = materialize(rows.withColumn("other", clear_of(F.col("candidates"), F.col("seeds"))).select("row", "id", places.alias("places")), "places")

    at = marked.select("row", F.explode("places").alias("p")).select("row", "p.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = materialize(at.select("pattern", "value", "kind").distinct(), "edges")
    patterns, instances = score_graph(edges, rounds, smoothing)
    sure_instances = instances.filter(F.col("score") >= sure).select("value", F.col("kind").alias("found_kind"))
    sure_patterns = patterns.filter(F.col("score") >= sure).select("pattern", F.col("kind").alias("found_kind"))
    learned = splittable_join(at.filter(F.col("kind").isNull() | (F.col("kind") >= len(BASE))).drop("kind"), sure_patterns.groupBy("pattern").agg(F.collect_set("found_kind").alias("kinds")), ["pattern"])  # len(KINDS) at most
    learned = (
        learned.withColumn("found_kind", F.explode("kinds"))
        .join(sure_instances, ["value", "found_kind"])
        .groupBy("row", "start", "end", "value")
        .agg(F.min("found_kind").alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("learned"))
    )
    spans = "array<struct<kind:int,start:int,end:int,value:string>>"
    base = F.transform(F.filter("places", lambda p: p["kind"] < len(BASE)), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"))).cast(spans)
    joined = marked.select("row", "id", base.alias("base")).join(learned, "row", "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce(F.array_sort("learned"), F.array()).cast(spans).alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
