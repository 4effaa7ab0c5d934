"""License scans: template markup compiled to token automata.

A template is a license's wording with two kinds of marked regions: ``[[...]]``
is optional, and ``{{...}}`` is replaceable by any run of tokens up to a number
(``{{name:5}}``; 1 to 8 tokens by default).  All other wording is mandatory.
Text and template are cut into the same tokens (lower-cased words), and each
template becomes an automaton over them: a regular expression whose steps are
whole tokens, so it accepts a passage only if the mandatory tokens stand there
exactly, in order, with nothing between them but its marked regions.

Phrases are found the same way, at every place where their words stand
consecutively, overlapping places included.

Everything is columns over the tokens joined by blanks, one pass to normalise
and a quick test per template before any closer look.

Defined results: null text is empty, without words, places and labels; score is
the share of the words inside accepted passages (1 for a text that is all
license, 0 for none); repeated rows give repeated rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import ascii_lower, text_of

# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License wordings with their optional and replaceable regions.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "Licensed under [[the terms of]] the Apache License, Version 2.0 [[(the \"License\")]]; you may not use this {{file:3}} except in compliance with the License"),
    "gpl-2.0": ("[[This {{work:3}} is]] licensed under [[the terms of]] the GNU General Public License, version 2",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or [[(at your option)]] any later version"),
    "gpl-3.0": ("[[This {{work:3}} is]] licensed under [[the terms of]] the GNU General Public License, version 3",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or [[(at your option)]] any later version"),
    "cc-by-4.0": ("[[This {{work:3}} is]] licensed under [[a]] CC BY 4.0", "Creative Commons Attribution 4.0 [[International]] [[Public]] License"),
    "cc-by-nc-4.0": ("[[This {{work:3}} is]] licensed under [[a]] CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 [[International]] [[Public]] License"),
    "cc-by-sa-4.0": ("[[This {{work:3}} is]] licensed under [[a]] CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 [[International]] [[Public]] License"),
    "mit": ("[[The]] MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this {{software and associated documentation files (the \"Software\"):10}}, to deal in the {{Software}} without restriction",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that",),
    "proprietary": ("[[Copyright]] [[(c)]] [[{{year and holder:8}}]] All rights reserved",),
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = re.compile(r"\[\[|\]\]|\{\{[^{}]*\}\}")


def tokens_of(text: str) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.split(NOT_WORD, low) if w]


def compile_template(template: str, lead: str = "") -> str:
    """The automaton of a template, over tokens that each end with a blank
    (and begin with ``lead``)."""
    out, at, depth = [], 0, 0
    for m in [*_MARK.finditer(template), None]:
        out += [lead + re.escape(t) + " " for t in tokens_of(template[at:m.start() if m else len(template)])]
        if m is None:
            break
        at = m.end()
        if m[0] == "[[":
            depth += 1
            out.append("(?:")
        elif m[0] == "]]":
            depth -= 1
            if depth < 0:
                raise ValueError(f"optional region ends before it begins: {template}")
            out.append(")?")
        else:
            _, _, most = m[0][2:-2].rpartition(":")
            out.append(f"(?:{lead}[^ ]+ ){{1,{int(most) if most.isdigit() else 8}}}?")
    if depth:
        raise ValueError(f"optional region without end: {template}")
    return "".join(out)


def mandatory_runs(template: str) -> list[str]:
    """The wording outside all marked regions, run by run, longest first."""
    runs, at, depth = [], 0, 0
    for m in [*_MARK.finditer(template), None]:
        if not depth:
            runs.append(" ".join(tokens_of(template[at:m.start() if m else len(template)])))
        if m:
            at, depth = m.end(), depth + {"[[": 1, "]]": -1}.get(m[0], 0)
    return sorted((r for r in runs if r), key=len, reverse=True)


def accepts(norm: Column, template: str) -> Column:
    """Whether the automaton accepts a passage; it is only run on texts that
    hold all mandatory wording, as any such text must."""
    holds = F.lit(True)
    for run in mandatory_runs(template):
        holds = holds & F.contains(norm, F.lit(f" {run} "))
    return F.when(holds, norm.rlike(f"(?<= )(?:{compile_template(template)})")).otherwise(F.lit(False))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """`` word word word `` with a blank at either end; one blank if there are none."""
    inner = F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def places(norm: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of the phrase, its first and its last start (null if none)."""
    pieces = F.split(norm, f"(?<= )(?={re.escape(' '.join(tokens_of(phrase)))} )", -1)
    here = F.contains(norm, F.lit(f" {' '.join(tokens_of(phrase))} "))
    n = F.when(here, F.size(pieces) - 1).otherwise(F.lit(0)).cast("long")
    first = F.when(here, _spaces(F.get(pieces, F.lit(0))) - 1).cast("long")
    last = F.when(here, _spaces(norm) - 1 - _spaces(F.element_at(pieces, -1))).cast("long")
    return n, first, last


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=None) -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``; the labels as sorted arrays."""
    templates = TEMPLATES if templates is None else templates
    d = docs.select(docs[id_col].alias("id"), normalised(text_of(docs[text_col])).alias("norm"))
    found = [(label, *places(F.col("norm"), p)) for p, label in phrases]
    null = F.lit(None).cast("long")
    d = d.select(
        "id", "norm", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
        sum((n for _, n, _, _ in found), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.array(*[f for _, _, f, _ in found], null)).alias("first_word"),
        F.array_max(F.array(*[x for _, _, _, x in found], null)).alias("last_word"),
        F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, n, _, _ in found], F.lit(None).cast("string"))).alias("base"),
    )
    automata = {label: "|".join(f"(?<= )(?:{compile_template(t)})" for t in ts) for label, ts in templates.items()}
    norm = F.col("norm")
    hit = F.array_compact(F.array(*[F.when(functools.reduce(Column.__or__, [accepts(norm, t) for t in ts]), F.lit(label))
                                    for label, ts in templates.items()], F.lit(None).cast("string")))
    # Words that stay when the accepted passages are taken out.
    rest = F.regexp_replace("norm", "|".join(automata.values()) or "(?!)", "")
    d = d.withColumn("hit", hit).withColumn("left", F.when(F.size("hit") > 0, _spaces(rest) - 1).otherwise(F.col("n_words")))
    return d.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_sort(F.array_distinct("base")).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat("base", "hit"))).alias("labels"),
        F.when(F.col("n_words") > 0, (F.col("n_words") - F.col("left")) / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
    )
