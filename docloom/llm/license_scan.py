"""License scan by a positional rare-token index. DataFrame functions only.

Each template is a word sequence with a mandatory key phrase. The index posts a template's words of the highest
inverse template frequency, as few as leave the others less than ``min_coverage`` of its weight, so that every
match has a posted word in place. A file is looked up by the posted words it holds: a posting at offset o
and a word at position p vote for the alignment p - o, postings of one template that agree give one alignment,
and it counts when the key phrase stands in it word for word and the idf-weighted share of the template's words
found in place reaches ``min_coverage``.

Everything is computed within a row, so the scan has no shuffle, and no row can meet a hot key. The work on a text
grows with its words and its alignments.

Defined results: a null or empty text has no words and no match; repeated rows are each scanned;
an empty table gives an empty result; columns of the input that are not named are left out.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base result and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, mandatory key phrase, notice). Public notices in use today, the last ones first sentences of licence texts.
NOTICES = (
    ("gpl-notice", "gnu general public license", "licensed under the gnu general public license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("mit-notice", "under the mit license", "released under the mit license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license"),
    ("bsd", "bsd license", "distributed under the terms of the bsd license"),
    ("epl", "eclipse public license", "under the terms of the eclipse public license"),
    ("cc0", "cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"),
    ("isc", "isc license", "released under the isc license"),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
    ("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd-text", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-text", "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-text", "you can redistribute it and or modify it", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc-text", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def catalogue() -> list[Template]:
    base = [Template(label, tuple(p.split()), tuple(p.split()), True) for p, label in BASE]
    return base + [Template(label, tuple(text.split()), tuple(key.split()), False) for label, key, text in NOTICES]


def idf(templates: list[Template]) -> dict[str, float]:
    """Inverse frequency over the catalogue, base phrases apart (each repeats a notice)."""
    own = [t for t in templates if not t.base] or templates
    words = {w for t in templates for w in t.words}
    return {w: math.log((1 + len(own)) / (1 + sum(w in t.words for t in own))) + 0.1 for w in words}


def posted(t: Template, weight: dict[str, float], min_coverage: float) -> list[int]:
    """Positions of the template's words of highest weight: the others together cannot reach the coverage."""
    rest, out = sum(weight[w] for w in t.words), []
    least = min_coverage * rest
    for i in sorted(range(len(t.words)), key=lambda i: (-weight[t.words[i]], i)):
        if out and rest < least - 1e-9:
            break
        out.append(i)
        rest -= weight[t.words[i]]
    return sorted(out)


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: list[Template] | None = None, min_coverage: float = 0.6) -> DataFrame:
    """keep columns, n_words, and matches array<struct<label, base, start, at, coverage>>, where start
    is the alignment, at the word at which the key phrase starts."""
    templates = templates or catalogue()
    weight = idf(templates)
    postings = [posted(t, weight, min_coverage) for t in templates]
    rare = sorted({t.words[i] for t, at in zip(templates, postings, strict=True) for i in at})
    # Lossless: every match has a posted word, so a file without any of them has none.
    some = r"(?i)(?<![0-9a-z])(?:" + "|".join(re.escape(w) for w in rare) + r")(?![0-9a-z])"
    kind = "array<struct<label:string,base:boolean,start:int,at:int,coverage:double>>"
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lower = F.translate("_text", string.ascii_uppercase, string.ascii_lowercase)
    rows = rows.select(*keep, F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("_words"), F.col("_text").rlike(some).alias("_some"))
    words = F.col("_words")
    # the index of the text: for each posted word its places
    place = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.select(*keep, "_words", F.when(F.col("_some"), place).alias("_found"))

    def votes(word: str, offset: int) -> Column:
        return F.transform(F.filter("_found", lambda x: x["w"] == word), lambda x: x["i"] - F.lit(offset))

    def matches(t: Template, at: list[int]) -> Column:
        starts = F.array_distinct(F.concat(*[votes(t.words[i], i) for i in at]))
        total = float(sum(weight[w] for w in t.words))

        def judged(s: Column) -> Column:
            there = [F.coalesce(F.get(words, s + j) == w, F.lit(False)) for j, w in enumerate(t.words)]
            key = reduce(lambda a, b: a & b, there[t.key_at : t.key_at + len(t.key)])
            share = reduce(lambda a, b: a + b, [F.when(c, F.lit(weight[w])).otherwise(F.lit(0.0)) for c, w in zip(there, t.words, strict=True)])
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"), (s + t.key_at).alias("at"), F.when(key, F.least(share / total, F.lit(1.0))).otherwise(F.lit(0.0)).alias("coverage"))

        return F.filter(F.transform(starts, judged), lambda m: m["coverage"] >= min_coverage)

    found = F.concat(*[matches(t, at) for t, at in zip(templates, postings, strict=True)]).cast(kind)
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.when(F.size("_found") > 0, found).otherwise(F.array().cast(kind)).alias("matches"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    at = F.transform(base, lambda m: m["start"].cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )
