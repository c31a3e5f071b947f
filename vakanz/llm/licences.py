"""Licence scans by a positional index of rare words. Spark expressions only, nothing shuffled.

Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z. Each
template has mandatory key phrases; of the words of a key phrase the two that are rarest over all
documents (highest IDF) are its postings, with their places. A text's words that have postings are
looked up; a template is a candidate where both postings agree on where it would begin. It is found
if its key phrases stand there word by word and the words that agree hold enough of its IDF. Every
place of a key phrase has both its rare words, so no place is missed. A template may begin before
the text does: its words before the text agree with nothing, as if other words stood there.

A null text is an empty one; texts without licences have empty labels, null places and score 0;
repeated rows give repeated rows; an empty table gives an empty result. Texts are read whole, and
what is done in a row grows with its length. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import once, words_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The base phrases and their labels (fixed values).
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of further licences: label, words, mandatory key phrase (fixed values, public texts).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)
#: Share of a notice's IDF whose words must agree.
AGREE = 0.6
#: Begins of templates are packed as template * PLACE + BEFORE + place; a place is no less than -BEFORE.
PLACE, BEFORE = 1 << 40, 1 << 10


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        size = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + size] == self.key)


def templates() -> list[Template]:
    base = [Template(label, tuple(p.split()), tuple(p.split()), True) for label, p in BASE]
    return base + [Template(label, tuple(w.split()), tuple(k.split()), False) for label, w, k in NOTICES]


def text_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.translate(words_of(text), UPPER, UPPER.lower()), F.lit(WORDS), F.lit(0))


def idf(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, float]:
    """IDF of the licence words over all documents: one row a word reaches the driver."""
    own = F.array_intersect(text_words(text_col), F.array(*map(F.lit, vocabulary)))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in seen.collect()}
    total = counts.get("", 0)
    return {w: math.log(1 + (total - (n := counts.get(w, 0)) + 0.5) / (n + 0.5)) for w in vocabulary}


def _strings(words) -> Column:
    return F.array(*map(F.lit, words))


def with_licences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, places`` with places of ``template, place, label, base, score``."""
    known = templates()
    vocabulary = sorted({w for t in known for w in t.words})
    weight = idf(docs, vocabulary, text_col)
    rarest: list[list[tuple[str, int, int, int]]] = [[], []]
    for number, t in enumerate(known):
        places = sorted(range(len(t.key)), key=lambda i: (-weight[t.key[i]], i))
        for postings, place in zip(rarest, places[:2], strict=True):
            postings.append((t.key[place], number, t.key_at + place, place))
    index = [
        F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("template"), F.lit(p).alias("place"), F.lit(k).alias("in_key")) for w, n, p, k in postings])
        for postings in rarest
    ]
    forms = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(t.words).alias("words"),
            F.array(*[F.lit(weight[w]) for w in t.words]).alias("weights"),
            F.lit(sum(weight[w] for w in t.words) or 1.0).alias("total"),
            F.lit(t.key_at).alias("key_at"), _strings(t.key).alias("key"),
        )
        for t in known
    ])
    rare = sorted({w for postings in rarest for w, *_ in postings})
    rows = once(docs.select(docs[id_col].alias("doc_id"), text_words(docs[text_col]).alias("words")))
    looked_up = F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.alias("at"))))
    hits = rows.select("doc_id", "words", F.filter(looked_up, lambda h: h.isNotNull()).alias("hits"))

    def begins(postings: Column) -> Column:
        of_hit = lambda h: F.transform(
            F.filter(postings, lambda p: (p["word"] == h["word"]) & (h["at"] >= p["in_key"])),
            lambda p: p["template"] * F.lit(PLACE) + F.lit(BEFORE) + h["at"] - p["place"],
        )
        return F.flatten(F.transform("hits", of_hit))

    agreed = F.array_intersect(begins(index[0]), begins(index[1]))
    found = hits.select("doc_id", "words", agreed.alias("agreed")).select(
        "doc_id", "words",
        F.transform("agreed", lambda b: F.struct(
            F.floor(b / F.lit(PLACE)).cast("int").alias("template"), (b % F.lit(PLACE) - F.lit(BEFORE)).cast("int").alias("place")
        )).alias("candidates"),
    )
    words = F.col("words")

    def judged(c: Column) -> Column:
        form, place = F.element_at(forms, c["template"] + 1), c["place"]
        before = F.greatest(-place, F.lit(0))
        here = F.size(form["words"]) - before
        agrees = F.zip_with(
            F.slice(words, place + before + 1, here), F.slice(F.arrays_zip(form["words"], form["weights"]), before + 1, here),
            lambda w, t: F.when(w == t["words"], t["weights"]).otherwise(F.lit(0.0)),
        )
        score = F.aggregate(agrees, F.lit(0.0), lambda a, x: a + x) / form["total"]
        key = F.slice(words, place + form["key_at"] + 1, F.size(form["key"])) == form["key"]
        return F.struct(
            c["template"].alias("template"), place.alias("place"), form["label"].alias("label"),
            form["base"].alias("base"), F.when(key, score).otherwise(F.lit(0.0)).alias("score"),
        )

    places = F.filter(
        F.transform("candidates", judged),
        lambda p: F.when(p["base"], p["score"] > 0).otherwise(p["score"] >= AGREE),
    )
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))


def licence_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document: ``n_words``, base places and labels, all labels, and a score.

    The score is 1 with a base place, else the best agreement of a notice, else 0.
    """
    found = once(with_licences(docs, text_col, id_col))
    base = F.filter("places", lambda p: p["base"])
    found = found.select("doc_id", "n_words", "places", base.alias("base"))
    starts = F.transform("base", lambda p: p["place"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: p["score"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels("base").alias("base_labels"), labels("places").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
