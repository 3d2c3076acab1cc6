"""License scan with ordered signature rules, in DataFrame functions only.

Texts that contain none of the rules' keywords are done after a few substring tests. Keywords are looked for where
runs of white space count as one blank, so a keyword that is wrapped over two lines is found. In the others each
keyword found opens its rules' regexes, which are literals of the plan and so compiled once a task. Every match becomes an
interval; the intervals of a row are sorted by start, and one that lies inside an earlier one of the same or a higher
priority is suppressed, which the running maxima of the ends of each priority tell. Base phrases are looked for among the
words of every text and their labels always stay.

Running sums and maxima go over blocks of the square root of an array's length, so n intervals cost n to the power of
1.5 steps and no copying of lists.

Defined results: a null or empty text has no words, no labels ('') and score 0. Equal intervals of equal
priority keep the rule that comes first. Repeated rows are scanned each; an empty table gives no rows. A long
text costs one regex pass for each rule whose keyword it has. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import ascii_lower, text_or_empty
from turnscope.llm.license_rules import Rule, build

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words. Java matches this class an order of magnitude faster than its complement, so texts are split by it.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose labels every scan has.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PRIORITIES = (4, 3, 2)
BASE_SCORE = 0.5
#: White space that a keyword's single blank does not equal, as the rules' \\s has it.
_ODD_BLANKS = ("  ", "\t", "\n", "\x0b", "\f", "\r")
_HIT = "struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>"
#: Set around each match to find its place; where a text has this character of its own, another one of its width stands in.
_MARK, _STAND_IN = "\ue000", "\ue001"


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, as indices of the first."""
    first, *rest = phrase.split(" ")

    def here(word: Column, i: Column) -> Column:
        fits = word == first
        for k, other in enumerate(rest, 1):
            fits = fits & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(fits, i)

    return F.array_compact(F.transform(words, here))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """For each place of ``values``, what ``join`` makes of all values before it."""
    start = F.lit(start)

    def over(v: Column, block: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        whole = F.transform(number, lambda b: F.aggregate(F.slice(v, b * block + 1, block), start, join))

        def from_blocks(whole: Column) -> Column:
            before = F.transform(number, lambda b: F.aggregate(F.slice(whole, F.lit(1), b), start, join))
            own = lambda i: F.aggregate(F.slice(v, i - i % block + 1, i % block), start, join)
            return _let(before, lambda before: F.transform(v, lambda _, i: join(F.get(before, F.floor(i / block).cast("int")), own(i))))

        return _let(whole, from_blocks)

    sized = lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda block: over(v, block))
    return _let(values, lambda v: F.when(F.size(v) > 0, sized(v)).otherwise(F.array().cast("array<int>")))


def _marked(text: Column, spaced: Column, rules: list[Rule]) -> Column:
    """(text, rule) for each rule that matches: the text with its matches marked. A keyword is looked for once for all its rules."""
    by: dict[str, list[Column]] = {}
    for number, r in enumerate(rules):
        marked = F.regexp_replace(text, F.lit(f"(?:{r.pattern})"), F.lit(f"{_MARK}$0{_MARK}"))
        by.setdefault(r.keyword, []).append(F.when(F.rlike(text, F.lit(r.pattern)), F.struct(marked.alias("text"), F.lit(number).alias("rule"))))
    opened = [F.when(F.contains(spaced, F.lit(k)), F.array(*found)) for k, found in by.items()]
    return F.flatten(F.array_compact(F.array(*opened)))


def _constants(rules: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in rules))


def _one_blank(text: Column) -> Column:
    """The text with every run of white space as one blank."""
    odd = F.lit(False)
    for blank in _ODD_BLANKS:
        odd = odd | F.contains(text, F.lit(blank))
    return F.when(odd, F.regexp_replace(text, r"\s+", " ")).otherwise(text)


def _intervals(marked: Column, rule: Column) -> Column:
    """Every match of the rule. The text's parts are gaps and matches in turn, so the running sum of lengths gives places."""
    lengths = F.transform(F.split(marked["text"], _MARK, -1), F.length)
    end = lambda at, i: F.get(at, 2 * i + 2)

    def hit(at: Column, i: Column) -> Column:
        return F.struct(F.get(at, 2 * i + 1).alias("start"), end(at, i).alias("end"), rule["priority"].alias("priority"), marked["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

    hits = lambda at: F.transform(F.sequence(F.lit(0), F.floor((F.size(at) - 1) / 2).cast("int") - 1), lambda i: hit(at, i))
    return _let(_running(lengths, lambda a, b: a + b, 0), hits)


def _survivors(hits: Column) -> Column:
    """Hits not inside another of the same or a higher priority that comes before them by start and length."""
    longest_first = F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (-h["end"]).alias("b"), (-h["priority"]).alias("c"), h["rule"].alias("d"), h.alias("hit")))
    ordered = F.transform(F.array_sort(longest_first), lambda s: s["hit"])

    def reach(hits: Column, p: int) -> Column:
        ends = F.transform(hits, lambda h: F.when(h["priority"] >= p, h["end"]).otherwise(-1))
        return _running(ends, lambda a, b: F.greatest(a, b), -1).alias(f"reach{p}")

    def visible(hits: Column) -> Column:
        covered = lambda z: F.greatest(*(F.when(z["hit"]["priority"] == p, z[f"reach{p}"]).otherwise(-1) for p in PRIORITIES))
        together = F.arrays_zip(hits.alias("hit"), *(reach(hits, p) for p in PRIORITIES))
        return F.transform(F.filter(together, lambda z: covered(z) < z["hit"]["end"]), lambda z: z["hit"])

    return _let(ordered, visible)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections (the surviving intervals, in characters of the text)."""
    rules = build() if rules is None else rules
    text, lowered = F.col("text"), docs.select("doc_id", ascii_lower(text_or_empty()).alias("text"))
    unmarked = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _STAND_IN)).otherwise(text)
    spaced, lowered = F.col("spaced"), lowered.withColumn("spaced", _one_blank(text))
    any_keyword = F.lit(False)
    for keyword in _covering(sorted({r.keyword for r in rules})):
        any_keyword = any_keyword | F.contains(spaced, F.lit(keyword))
    any_base = F.lit(False)
    for phrase in BASE:
        whole = F.lit(True)
        for word in phrase.split(" "):
            whole = whole & F.contains(text, F.lit(word))
        any_base = any_base | whole
    every_word = F.array_remove(F.split(text, _BETWEEN, -1), "")
    none = F.array().cast(f"array<{_HIT}>")
    words = F.when(any_base, every_word).otherwise(F.array().cast("array<string>"))
    marked = F.when(any_keyword, _marked(unmarked, spaced, rules)) if rules else F.lit(None).cast("array<struct<text:string,rule:int>>")
    gated = lowered.select("doc_id", F.size(every_word).cast("long").alias("n_words"), words.alias("words"), marked.alias("marked"))
    every = F.flatten(F.transform(F.array_compact("marked"), lambda m: _intervals(m, F.get(_constants(rules), m["rule"]))))
    hits = F.when(F.exists("marked", lambda m: m.isNotNull()), _survivors(every)).otherwise(none)
    found = gated.select("doc_id", "n_words", "words", hits.alias("detections"))
    places = found.select("doc_id", "n_words", "detections", *(_places(F.col("words"), phrase).alias(f"p{i}") for i, phrase in enumerate(BASE)))
    spots = F.concat(*(F.col(f"p{i}") for i in range(len(BASE))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))
    method = F.transform("detections", lambda h: h["label"])
    best = F.array_max(F.transform("detections", lambda h: h["confidence"]))
    return places.select(
        "doc_id",
        "n_words",
        F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, method))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(spots) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        "detections",
    )


def _covering(keywords: list[str]) -> list[str]:
    """The keywords that contain no other: whatever has one of the rest has one of these."""
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]
