"""License scan with ordered signature rules, in Spark SQL functions throughout.

A text is normalised to words between single blanks. Only a text with some rule's keyword is
looked at further; then the rules whose own keyword it contains are applied, each finding
every place it fires. A detection that lies inside another one of the same or a higher
priority is suppressed; the labels of the others stand. Base phrases are found the same way,
count at every place, and are never suppressed.

Everything happens within the row of a document: no shuffle, no join, no Python.

Cases: a null text is empty; an empty one has no words, null positions, empty labels and score
0; repeated rows get a result each; an empty table gives no rows; other columns are carried in
the struct ``doc``; a very long text with very many mentions takes time in proportion to its
length. Letters beyond A-Z are lower-cased too, which changes no word's extent.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.license_rules import Rule, rules

BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
_BASE_PRIORITY = -1
_LEVELS = 4
_OPEN, _CLOSE = "\x01", "\x02"
#: detections folded at once
_RUN = 128
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DETECTION = "struct<start:int,stop:int,priority:int,label:string,confidence:double>"


def normalised(text: Column) -> Column:
    """Each word between single blanks; a lone blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), _SEPARATORS, " ")


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, rule: Column) -> Column:
    """Every detection of one rule, in time linear in the text.

    Matches are marked at their first and last word, so that the numbers of the marked words
    are the places; normalised text holds no control characters.
    """
    marked = F.split(F.regexp_replace(text, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), " ")
    numbered = lambda edge: F.filter(F.transform(marked, lambda w, k: F.when(edge(w), k)), lambda k: k.isNotNull())
    starts, stops = numbered(lambda w: w.startswith(_OPEN)), numbered(lambda w: w.endswith(_CLOSE))
    one = lambda d: F.struct(
        (d["start"] - 1).alias("start"),  # the text begins with a blank
        d["stop"].alias("stop"),
        rule["priority"].alias("priority"),
        rule["label"].alias("label"),
        rule["confidence"].alias("confidence"),
    )
    return F.transform(F.arrays_zip(starts.alias("start"), stops.alias("stop")), one)


def _from_word(rule: Rule) -> str:
    """A rule's keyword from the beginning of a word on."""
    return " " + rule.keyword.lstrip()


def _table(found: list[Rule]) -> Column:
    """The rules as one literal array; it is parsed once, while the plan is made."""
    rows = [
        {"priority": r.priority, "label": r.label, "confidence": r.confidence, "keyword": _from_word(r), "pattern": f"(?<= )(?:{r.pattern})(?= )"}
        for r in found
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<priority:int,label:string,confidence:double,keyword:string,pattern:string>>")


def _standing(found: Column) -> Column:
    """Detections that no other of the same or a higher priority contains.

    In order of start, the longest and then the highest priority first, one detection lies
    inside an earlier one if that one's stop is not smaller; so the largest stop seen so far
    on each priority level tells.
    """
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), (-d["stop"]).alias("longest"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")
            ),
        )
    )
    none = F.array().cast(f"array<{DETECTION}>")
    unreached = F.array(*[F.lit(-1)] * _LEVELS)

    def step(s: Column, d: Column) -> Column:
        stop, level = -d["longest"], d["priority"]
        inside = F.exists(F.slice(s["reach"], 1, level + 1), lambda r: r >= stop)
        one = F.struct(d["start"].alias("start"), stop.alias("stop"), level.alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence"))
        reach = F.transform(s["reach"], lambda r, k: F.when(k == level, F.greatest(r, stop)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(one))).alias("kept"))

    def run(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s["reach"].alias("reach"), none.alias("kept")), step)
        joined = lambda i: F.struct(i["reach"].alias("reach"), F.concat(s["runs"], F.array(i["kept"])).alias("runs"))
        return F.element_at(F.transform(F.array(inner), joined), 1)

    # arrays grow within a run of detections only, so the fold stays linear in their number
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _RUN).cast("int")), lambda k: F.slice(all_, k * _RUN + 1, _RUN))
    parts = F.element_at(F.transform(F.array(ordered), cut), 1)
    begin = F.struct(unreached.alias("reach"), F.array().cast(f"array<array<{DETECTION}>>").alias("runs"))
    return F.aggregate(parts, begin, run, lambda s: F.flatten(s["runs"]))


def scan(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``doc`` (a struct of ``keep``), n_words, base detections and standing detections."""
    own = rules()
    base = [Rule(_BASE_PRIORITY, 0.9, label, phrase, phrase) for label, phrase in BASE]
    gate = " (?:" + "|".join(sorted({_from_word(r)[1:] for r in own + base})) + ")"
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), normalised(docs["text"]).alias("norm"))
    rows = rows.select("doc", "norm", F.greatest(_blanks(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"), F.col("norm").rlike(gate).alias("gated"))
    fired = F.filter(_table(base + own), lambda r: F.contains(F.col("norm"), r["keyword"]))
    places = F.flatten(F.transform(fired, lambda r: _places(F.col("norm"), r)))
    none = F.array().cast(f"array<{DETECTION}>")
    rows = rows.select("doc", "n_words", F.when(F.col("gated"), places).otherwise(none).alias("found"))
    rows = rows.select(
        "doc",
        "n_words",
        F.filter("found", lambda d: d["priority"] == _BASE_PRIORITY).alias("base"),
        F.filter("found", lambda d: d["priority"] != _BASE_PRIORITY).alias("found"),
    )
    return rows.select("doc", "n_words", "base", F.when(F.size("found") > 0, _standing(F.col("found"))).otherwise(F.col("found")).alias("standing"))


def summarise(found: DataFrame) -> DataFrame:
    """Counts, positions, labels and score of ``scan``'s rows."""
    label = lambda c: F.array_distinct(F.transform(c, lambda d: d["label"]))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    best = F.array_max(F.transform(F.concat("base", "standing"), lambda d: d["confidence"]))
    return found.select(
        "doc",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(label("base"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(label("base"), label("standing")))).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
