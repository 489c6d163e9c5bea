"""License scan: phrases, and an exact set-similarity join of runs of words with templates.

A run is a number of consecutive words of a text, whatever line breaks stand between them;
for a template of n words it has at most n / ``THRESHOLD`` words.  A run matches a template
if it holds at least ``THRESHOLD`` of its distinct words, all of its marks, and no rival.
Marks are the words that name the licence; rivals are the marks that a more specific
template has on top of the same ones (``lesser`` for the GPL, ``nc`` for CC BY), so a
notice is not taken for a notice of its family.  ``matches`` finds all such places:

* words are ordered by how often the whole input holds them, rare first;
* prefix filter: with an overlap of o out of n words, a run holds one of the first
  n - o + 1 of the template;
* length filter: only words no farther away from it than a run is long count;
* positional filter: if that word is the rarest that run and template share, all others
  stand behind it in the order; there have to be enough of those around it;
* what is left is verified: of the runs with that word the one that holds most of the
  template counts, and of several the last, which has no needless words in front.

Only words that some template has can be shared, so texts are reduced to those, with their
numbers and line breaks, when they are read.  Around each rare word a slice of bounded size
goes on; no text and no line meets another.  The templates are a parameter of bounded size
(``MOST_TOKENS`` distinct words, checked); frequencies and prefixes are tables of at most
that many rows.  Everything is DataFrame functions.

Words: maximal runs of characters other than ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z.  Null counts as empty and has no words, places, labels; score 0.  Rows
that share a doc_id keep the matches of their own texts (told apart by a 64-bit hash of the
text within the doc_id); equal rows have equal results.  An empty table has no rows.  Of
other columns none is read, whatever their names.  A very long text is one row whose
template words go on in slices; its runs are found like others.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexing import once
from ..functions.text import running_ends
from ..plans.stages import materialize

THRESHOLD, MOST_TOKENS = 0.8, 10_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One or more characters that are in no word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, marks, and the words of a common notice.
TEMPLATES = (
    ("apache", "apache", "licensed under the apache license version 2 0"),
    ("apache", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "permission granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "gnu general public", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "gnu lesser general public", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "gnu affero general public", "licensed under the gnu affero general public license version 3"),
    ("agpl", "gnu affero general public", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("bsd", "redistribution source binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc0", "waived copyright", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), F.lit(pattern), F.lit(0))


def places(tokens: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other."""
    parts = phrase.split()
    last = F.size(tokens) - len(parts)

    def here(i: Column) -> Column:
        same = F.get(tokens, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(tokens, i + k) == part)
        return same

    possible = (last >= 0) & F.array_contains(tokens, parts[0]) & F.array_contains(tokens, parts[-1])
    return F.when(possible, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


class Template(NamedTuple):
    number: int
    label: str
    length: int
    words: list[str]    # distinct
    marks: list[str]    # all of them have to be in a run
    rivals: list[str]   # none of them may be


def template_table(templates: tuple[tuple[str, str, str], ...]) -> list[Template]:
    sets = [(label, set(marks.split()), text.split()) for label, marks, text in templates]
    if len({w for *_, ws in sets for w in ws}) > MOST_TOKENS:
        raise ValueError(f"templates may have {MOST_TOKENS} distinct words")
    if any(not marks <= set(ws) for _, marks, ws in sets):
        raise ValueError("marks have to be words of their template")
    return [Template(n, label, len(ws), sorted(set(ws)), sorted(marks),
                     sorted({w for _, other, _ in sets if other > marks for w in other} - set(ws)))
            for n, (label, marks, ws) in enumerate(sets)]


def template_words(table: list[Template]) -> list[str]:
    return sorted({w for t in table for w in t.words})


def split_texts(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, text, text_hash, split): the words and line breaks of every text."""
    return docs.select(F.col(row).alias("row"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text), rf"{WORD}|\n").alias("split"))


def template_cells(vocabulary: list[str]) -> Column:
    """Template words and line breaks of ``split`` with their numbers."""
    cells = F.transform("split", lambda c, i: F.struct(i.alias("at"), c.alias("token")))
    return F.filter(cells, lambda c: c["token"].isin(*vocabulary, "\n"))


def with_words(texts: DataFrame) -> DataFrame:
    """Texts whose cells are not line breaks only."""
    return texts.filter(F.exists("cells", lambda c: c["token"] != "\n"))


def around(texts: DataFrame, rare: list[str], reach: int) -> DataFrame:
    """(row, text_hash, token, at, hood): every rare word with the template words before and behind it; at and line count words and line breaks."""
    some = texts.filter(F.exists("cells", lambda c: c["token"].isin(*rare)))
    counted = once(some, line=running_ends(F.transform("cells", lambda c: (c["token"] == "\n").cast("bigint"))))
    placed = F.transform(F.arrays_zip("cells", "line"), lambda z: F.struct(
        (z["cells"]["at"] - z["line"]).alias("at"), z["line"].alias("line"), z["cells"]["token"].alias("token")))
    kept = once(counted.select("row", "text_hash", F.filter(placed, lambda c: c["token"] != "\n").alias("c")), known=F.col("c")).drop("c")
    numbers = F.filter(F.sequence(F.lit(1), F.size("known")), lambda k: F.element_at("known", k)["token"].isin(*rare))
    return kept.select("row", "text_hash", F.explode(F.transform(numbers, lambda k: F.struct(
        F.element_at("known", k).alias("own"), F.slice("known", F.greatest(k - reach, F.lit(1)), F.lit(2 * reach + 1)).alias("hood")))).alias("n")).select(
        "row", "text_hash", "n.own.token", "n.own.at", "n.hood")


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """(row, text_hash, line, template, label, containment) of all runs that match a template.

    ``row`` is the doc_id, ``line`` the line in which the run starts; null texts have none.
    """
    table = template_table(templates)
    cells = template_cells(template_words(table)).alias("cells")
    return matched(materialize(with_words(split_texts(docs, doc_id, text).select("row", "text_hash", cells))), table, threshold)


def matched(texts: DataFrame, table: list[Template], threshold: float) -> DataFrame:
    """``matches`` in materialised texts (row, text_hash, cells): template words and line breaks with their numbers."""
    # one row per template word
    frequency = {r["token"]: r["n"] for r in texts.select(F.explode("cells.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    prefixes, reach = [], 1
    for t in table:
        need = max(1, math.ceil(len(t.words) * threshold - 1e-9))
        run = math.ceil(t.length / threshold - 1e-9)
        reach = max(reach, run)
        ordered = sorted(t.words, key=lambda w: (frequency.get(w, 0), w))
        prefixes += [(t.number, t.label, t.words, len(t.words), t.marks, t.rivals, need, run, ordered[k:], ordered[k]) for k in range(len(ordered) - need + 1)]
    prefix = texts.sparkSession.createDataFrame(
        prefixes, "template int, label string, words array<string>, size int, marks array<string>, rivals array<string>, need int, run int, "
                  "behind array<string>, token string")

    def tokens(cells: Column) -> Column:
        return F.array_distinct(F.transform(cells, lambda c: c["token"]))

    def marked(found: Column) -> Column:
        return F.size(F.array_except(F.col("marks"), found)) == 0

    candidates = around(texts, sorted({p[-1] for p in prefixes}), reach).join(F.broadcast(prefix), "token")
    near = F.filter("hood", lambda c: F.array_contains("words", c["token"]) & (F.abs(c["at"] - F.col("at")) < F.col("run")))
    barred = F.transform(F.filter("hood", lambda c: F.array_contains("rivals", c["token"])), lambda c: c["at"])
    near = once(candidates, near=near, barred=barred).drop("hood").filter(
        marked(tokens(F.col("near"))) & (F.size(F.array_intersect(tokens(F.col("near")), "behind")) >= F.col("need")))

    def run_from(s: Column) -> Column:
        stop = F.least(s["at"] + F.col("run"), F.array_min(F.filter("barred", lambda b: b > s["at"])))
        found = tokens(F.filter("near", lambda c: (c["at"] >= s["at"]) & (c["at"] < stop)))
        return F.struct((marked(found) & (F.col("at") < stop)).alias("whole"), F.size(found).alias("shared"), s["at"].alias("at"), s["line"].alias("line"))

    runs = F.transform(F.filter("near", lambda c: c["at"] <= F.col("at")), run_from)
    return (once(near, best=F.array_max(runs)).filter(F.col("best.whole") & (F.col("best.shared") >= F.col("need")))
            .select("row", "text_hash", F.col("best.line").alias("line"), "template", "label", (F.col("best.shared") / F.col("size")).alias("containment")).distinct())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES,
         templates: tuple[tuple[str, str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates, n_lines.

    n_base, first_word, last_word: number and smallest and largest start of the phrases'
    places.  labels: those of the phrases and of the templates that some run matches.
    score: the best containment of a template, 1 if a phrase stands in the text.
    n_templates: how many templates match.  n_lines: in how many lines such a run starts.
    """
    # every text is split once, for its number of words, phrases and template words
    can = F.col("text").rlike("(?i)" + "|".join(GAP.join(p.split()) for p, _ in phrases))
    table = template_table(templates)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = split_texts(docs, doc_id, text).select(
        "row", "text_hash", (F.size("split") - F.coalesce(breaks, F.lit(0))).cast("long").alias("n"),
        F.when(can, F.filter("split", lambda c: c != "\n")).alias("w"), template_cells(template_words(table)).alias("cells"))
    none = F.array().cast("array<int>")
    found = [F.coalesce(F.when(F.col("w").isNotNull(), places(F.col("w"), p)), none) for p, _ in phrases]
    rows = materialize(rows.select("row", "text_hash", "n", "cells", *(c.alias(f"p{k}") for k, c in enumerate(found))))
    starts = F.concat(*(F.col(f"p{k}") for k in range(len(phrases))))
    labels = F.array_sort(F.array_distinct(F.filter(
        F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    base = rows.select(F.col("row").alias("doc_id"), F.col("text_hash").alias("own_hash"), F.col("n").alias("n_words"), starts.alias("starts"), labels.alias("base"))
    per_row = matched(with_words(rows.select("row", "text_hash", "cells")), table, threshold).groupBy("row", "text_hash").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.collect_set("template").alias("met"),
        F.size(F.collect_set("line")).alias("n_lines"))
    joined = base.join(per_row, F.col("doc_id").eqNullSafe(F.col("row")) & (F.col("own_hash") == F.col("text_hash")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce(F.size("met"), F.lit(0)).cast("long").alias("n_templates"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
