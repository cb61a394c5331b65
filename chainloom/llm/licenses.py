"""License scans: ordered signature rules behind a keyword prefilter.

Rules (`license_rules.py`) are hand-written patterns over a document's words, lower-cased and joined by single spaces.
Each has keywords, a confidence and a label, and its place in the list is its priority. The words of a document are
met with all keywords at once; a document without any runs no rule, and others run only rules whose keywords they hold.

Detections are intervals of words. Rules are taken in the order of their priority: a detection stays if no word of it
belongs to a better one that stayed, which also suppresses what a better detection contains; of detections of one rule,
which never overlap, all such stay. Everything happens inside a row with SQL functions: no shuffle, no Python, memory
bounded by one document, and time linear in its words for each rule that matches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import bind, lower_ascii, text_of
from chainloom.llm.license_rules import table as rule_table

#: What separates words: all of ASCII but digits and a-z, after A-Z became a-z.
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values of the result's contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """One signature: the pattern matches words between single spaces; a lower priority number wins."""

    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    confidence: float


def signature_rules() -> list[Rule]:
    """All rules; their order is the priority.

    >>> len(signature_rules()) >= 200
    True
    """
    return [Rule(k, label, words, f"(?<= )(?:{pattern})(?= )", confidence) for k, (label, confidence, words, pattern) in enumerate(rule_table())]


RULE_TYPE = "array<struct<priority:int,label:string,keywords:array<string>,pattern:string,confidence:double>>"
DETECTION = "struct<start:int,end:int,rule:int,label:string,confidence:double>"


def _rule_column(rules: list[Rule]) -> Column:
    """The rules as one constant, best first."""
    rows = [{"priority": r.priority, "label": r.label, "keywords": list(r.keywords), "pattern": r.pattern, "confidence": r.confidence} for r in sorted(rules, key=lambda r: r.priority)]
    return F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)


#: They mark the first and the last word of a match; no word holds them.
FIRST, LAST = "\x01", "\x02"


def _places(norm: Column, rule: Column) -> Column:
    """Intervals array<struct<start, end>> of a rule's matches, in order: matches are marked in the text, and the marked
    words counted."""
    marked = F.regexp_replace(norm, rule["pattern"], F.lit(FIRST + "$0" + LAST))

    def found(words: Column) -> Column:
        at = lambda mark, after: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i + after)), lambda i: i.isNotNull())
        return F.zip_with(at(FIRST, 0), at(LAST, 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return bind(marked, lambda m: F.when(F.contains(m, F.lit(FIRST)), bind(F.split(F.trim(m), " "), found)).otherwise(none))


def _detections(norm: Column, keys: Column, n_words: Column, rules: Column) -> Column:
    """The detections that stay, best rule first."""
    run = F.filter(rules, lambda r: F.arrays_overlap(r["keywords"], keys))
    found = F.transform(run, lambda r: F.struct(r.alias("rule"), _places(norm, r).alias("places")))
    found = F.filter(found, lambda x: F.size(x["places"]) > 0)
    start = F.struct(F.array_repeat(F.lit(False), n_words.cast("int")).alias("taken"), F.array().cast(f"array<{DETECTION}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["places"], lambda p: ~F.exists(F.sequence(p["start"], p["end"] - 1), lambda i: F.get(acc["taken"], i)))

        def settled(kept: Column) -> Column:
            # The words of what stays: false up to its start, true up to its end, piece by piece.
            before = F.zip_with(kept, F.concat(F.array(F.lit(0)), F.transform(kept, lambda p: p["end"])), lambda p, e: F.struct(p.alias("p"), e.alias("e")))
            runs = F.transform(
                F.filter(before, lambda y: y["p"].isNotNull()),
                lambda y: F.concat(F.array_repeat(F.lit(False), y["p"]["start"] - y["e"]), F.array_repeat(F.lit(True), y["p"]["end"] - y["p"]["start"])),
            )
            taken = F.zip_with(acc["taken"], F.flatten(runs), lambda a, b: a | F.coalesce(b, F.lit(False)))
            rule = x["rule"]
            rows = F.transform(
                kept,
                lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), rule["priority"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence")),
            )
            return F.struct(F.when(F.size(kept) > 0, taken).otherwise(acc["taken"]).alias("taken"), F.concat(acc["out"], rows).alias("out"))

        return bind(free, settled)

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts the places of the base phrases, first_word and last_word are the smallest and largest word number at
    which one starts. ``labels`` joins the base labels and those of the surviving detections; detections are
    array<struct<start, end, rule, label, confidence>> with word numbers, end exclusive. The score is the best
    confidence of what was found, 0.5 at least if a base phrase was, and 0 if nothing was.

    Edge cases: a null text counts as empty: no words, null first_word and last_word, empty labels, score 0. Repeated
    rows and null ids give a row each. Of matches with the same interval the rule of better priority stays. Very long
    texts are read whole, in time linear in their words. An empty table gives no rows. Only the id and text columns are
    read, so names of others don't matter.
    """
    rules = signature_rules() if rules is None else rules
    rules_col = _rule_column(rules)
    # "license" is a keyword as base phrases end in it.
    keywords = F.array(*[F.lit(w) for w in sorted({w for r in rules for w in r.keywords} | {"license"})])

    def counted(parts: Column) -> Column:
        # Only the first and the last part can be empty.
        return F.filter(parts, lambda w: w != "")

    words = bind(F.split(lower_ascii(text_of(text_col)), NOT_WORDS, -1), counted)

    def read(words: Column) -> Column:
        keys = F.array_intersect(words, keywords)
        held = lambda k: F.struct(
            F.size(words).cast("long").alias("n_words"), k.alias("keys"),
            F.when(F.size(k) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias("norm"),
            F.when(F.array_contains(k, "license"), words).alias("words"),
        )
        return bind(keys, held)

    step = docs.select(F.col(id_col).alias("id"), bind(words, read).alias("read")).select("id", "read.*")
    base = []
    for phrase, label in BASE:
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _phrase_at(F.col("words"), phrase.split(" ")))
        base.append(F.transform(places, _labelled(label)))
    none = F.array().cast("array<struct<at:int,label:string>>")
    step = step.withColumn("base", F.when(F.col("words").isNotNull(), F.concat(*base)).otherwise(none)).drop("words")
    found = F.when(F.col("norm").isNotNull(), _detections(F.col("norm"), F.col("keys"), F.col("n_words"), rules_col))
    step = step.withColumn("kept", F.coalesce(F.array_sort(found), F.array().cast(f"array<{DETECTION}>"))).drop("norm", "keys")
    at = F.transform("base", lambda b: b["at"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)),
        F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
    )
    return step.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("kept", lambda d: d["label"]))), ",").alias("labels"),
        score.alias("score"),
        F.col("kept").alias("detections"),
    )


def _phrase_at(words: Column, parts: list[str]):
    def at(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return out

    return at


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
