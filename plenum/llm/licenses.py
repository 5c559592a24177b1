"""License scan: fixed phrases, and a set-similarity join of text blocks with license templates.

Blocks are the paragraphs of a text (runs of lines with words, so a wrapped
paragraph is the same block as one on a single line) and, as a notice may go on
after an empty line, overlapping windows over all its words: every run of words
twice as long as the longest template lies in one of them. A template is found
in a block if the block holds at least ``threshold`` of the template's distinct
words. The join is exact: the words of a template are ordered by their frequency
over all documents, the rarest first, and

* prefix filter: a block without any of the |T| - need + 1 rarest words of T can't reach ``need``, so an inverted
  table of these words gives a block the templates to look at, and no others;
* length filter: a block with fewer than ``need`` words of the templates can't either;
* positional filter: if the first shared word stands at place i of T and at place j of the block's words in the same
  order, at most 1 + min(|T| - i - 1, |B| - j - 1) words are shared;

before the shared words are counted. Of templates that are near-equal
themselves (a license and its variant), the one with the higher score counts in
a block, of equal scores the one with more words. The templates are a parameter
and bounded, so their table is a literal of the plan and blocks are not
shuffled. All steps are built-in expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_texts import TEMPLATES

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
THRESHOLD = 0.9
#: The templates are literals of the plan; more words than this are refused.
MOST_WORDS = 20_000


def _sequence(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def _words(text: str) -> list[str]:
    return list(dict.fromkeys(_sequence(text)))


def _flat(text: Column) -> Column:
    """The words of a text with single spaces between them; empty without words.

    lower() also changes letters outside ASCII. Phrases and templates are ASCII,
    so this matters only for the two letters that it turns into ASCII ones;
    another letter outside ASCII takes their place.
    """
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    plain = F.when(odd, F.regexp_replace(text, "[\u0130\u212a]", "\u0131")).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), NOT_WORD, " "))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the (bounded) vocabulary occurs, over all documents."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_intersect(F.split(_flat(F.col("text")), " "), words)).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per word of the templates at most
    return {w: counts.get(w, 0) for w in vocabulary}


def _blocks(text: Column, flat: Column, longest: int) -> Column:
    """Arrays of words: the paragraphs of a text, and if there are several the windows over all its words.

    A window starts every ``longest`` words and is three times as long.
    """
    lines = F.array_join(F.transform(F.split(text, "\n"), _flat), "\n")
    paragraphs = lambda joined: F.transform(F.filter(F.split(joined, "\n{2,}"), lambda p: p != ""), lambda p: F.split(F.trim(F.replace(p, F.lit("\n"), F.lit(" "))), " "))
    windows = lambda words: F.transform(F.sequence(F.lit(1), F.size(words), F.lit(longest)), lambda i: F.slice(words, i, 3 * longest))
    several = lambda joined: F.regexp_like(joined, F.lit("[^\n]\n{2,}[^\n]"))
    return let(lines, lambda joined: F.when(several(joined), F.concat(paragraphs(joined), let(F.split(flat, " "), windows))).otherwise(paragraphs(joined)))


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _scored(block: Column, ordered: list[tuple[str, list[str], int]], vocabulary: list[str]) -> Column:
    """block: array of distinct words. Struct t (number of the template), score of each template that the block reaches need of.

    ordered: label, words (the rarest first) and need of each template; vocabulary: all their words in the same order.
    """
    prefixes: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, need) in enumerate(ordered):
        for i, w in enumerate(words[: len(words) - need + 1]):
            prefixes.setdefault(w, []).append((t, i))
    place = lambda t, i: F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"))
    inverted = F.create_map(*[x for w, at in prefixes.items() for x in (F.lit(w), F.array(*[place(t, i) for t, i in at]))])
    table = F.array(*[F.struct(_array(words).alias("words"), F.lit(need).alias("need")) for _, words, need in ordered])

    def of(own: Column) -> Column:  # the block's words that templates have, the rarest first
        hits = F.flatten(F.transform(own, lambda w, j: F.transform(F.coalesce(F.try_element_at(inverted, w), F.array().cast("array<struct<t:int,i:int>>")), lambda x: F.struct(x.t.alias("t"), x.i.alias("i"), j.alias("j")))))

        def one(first: Column) -> Column:
            template = F.get(table, first.t)
            size = F.size(template.words)
            may = (F.size(own) >= template.need) & (1 + F.least(size - first.i - 1, F.size(own) - first.j - 1) >= template.need)
            return F.struct(first.t.alias("t"), F.when(may, let(F.size(F.array_intersect(own, template.words)), lambda shared: F.when(shared >= template.need, shared / size))).alias("score"))

        firsts = let(hits, lambda h: F.transform(F.array_distinct(F.transform(h, lambda x: x.t)), lambda t: F.get(F.filter(h, lambda x: x.t == t), F.lit(0))))
        return F.filter(F.transform(firsts, one), lambda x: x.score.isNotNull())

    return let(F.array_intersect(_array(vocabulary), block), of)


def _rivals(ordered: list[tuple[str, list[str], int]], threshold: float) -> list[list[int]]:
    """For each template, those of other labels that share so many words that one block can reach both."""
    close = lambda a, b: len(set(a) & set(b)) >= threshold * min(len(a), len(b))
    return [[j for j, (other, b, _) in enumerate(ordered) if other != label and close(a, b)] for label, a, _ in ordered]


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (start, label of each phrase), found (label, score of each template).

    Null counts as empty; texts without words have no places and nothing found.
    Rows may repeat, an empty table gives an empty one, other columns are not
    read. The frequencies of the templates' words are counted at once.
    """
    sets = [(label, _words(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    often = frequencies(docs, vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _flat(text).alias("flat"))
    n_words = F.when(F.col("flat") == "", F.lit(0)).otherwise(F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))

    def places(phrase: str, label: str) -> Column:
        want = phrase.split()

        def starts(words: Column) -> Column:
            stands = lambda i: reduce(lambda x, y: x & y, [F.get(words, i + k) == w for k, w in enumerate(want)])
            first = F.filter(F.transform(words, lambda w, i: F.when(w == want[0], i)), lambda i: i.isNotNull())
            return F.transform(F.filter(first, stands), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

        at = let(F.split("flat", " "), starts)  # the words are split once, however often the first one occurs
        return F.when(F.contains(padded, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))

    # Blocks that hold a prefix word of any template, as arrays of distinct words.
    ordered = [(label, sorted(ws, key=lambda w: (often[w], w)), math.ceil(threshold * len(ws) - 1e-9)) for label, ws in sets]
    rare = sorted({w for _, ws, need in ordered for w in ws[: len(ws) - need + 1]})
    any_rare = F.array(*[F.lit(w) for w in rare])
    longest = max(1, *(len(_sequence(t)) for _, t in templates))
    blocks = F.transform(F.filter(_blocks(F.col("text"), F.col("flat"), longest), lambda b: F.arrays_overlap(b, any_rare)), F.array_distinct)
    may = reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {w} ")) for w in rare])
    blocks = F.when(may, blocks).otherwise(F.array().cast("array<array<string>>"))
    traits = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(words)).alias("size"), F.array(*[F.lit(j) for j in near]).cast("array<int>").alias("near")) for (label, words, _), near in zip(ordered, _rivals(ordered, threshold), strict=True)])

    def best(scored: Column) -> Column:
        def beaten(x: Column) -> Column:
            own = F.get(traits, x.t)
            better = lambda y: F.array_contains(own.near, y.t) & ((y.score > x.score) | (y.score == x.score) & (F.get(traits, y.t)["size"] > own["size"]))
            return F.exists(scored, better)

        return F.transform(F.filter(scored, lambda x: ~beaten(x)), lambda x: F.struct(F.get(traits, x.t).label.alias("label"), x.score.alias("score")))

    none = F.array().cast("array<struct<label:string,score:double>>")
    order = sorted(vocabulary, key=lambda w: (often[w], w))
    found = F.when(F.size("blocks") > 0, F.array_distinct(F.flatten(F.transform("blocks", lambda b: let(_scored(b, ordered, order), best))))).otherwise(none)
    rows = rows.withColumns({"n_words": n_words.cast("long"), "places": F.concat(*[places(p, label) for p, label in phrases]), "blocks": blocks})
    return rows.select("doc_id", "n_words", "places", found.alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = scan(docs)
    starts, labels = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    more = F.transform("found", lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(labels).alias("base_labels"), joined(F.concat(labels, more)).alias("labels"), score.alias("score"))
