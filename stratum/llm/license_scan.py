"""Licence scan with a positional index of rare licence words.

The index holds, for every indexed word, its places in the licence templates. Of each
template, those of its words that the text has and that have the highest inverse document frequency
are looked up, and their places are turned into offsets of the whole template. A template of which
several words agree in offset is a candidate; it counts if its mandatory phrase stands in the text.
Everything is a DataFrame expression on the row; only document frequencies of the bounded
licence vocabulary are gathered.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange

# Notices by which public licences are declared, and a phrase that each must hold.
TEMPLATES = [
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "hereby granted free"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", "apache license version 2"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "binary forms"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("lgpl", "licensed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("agpl", "licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty; altered source versions must be plainly marked as such", "plainly marked as such"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    ("artistic", "You may distribute this package under the terms of the Artistic License 2.0", "artistic license"),
]
#: Phrases that name a licence outright.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words too common to be indexed.
FUNCTION_WORDS = {"the", "is", "of", "to", "any", "a", "this", "and", "you", "may", "not", "in", "it", "or", "as", "with", "are", "that", "can", "under", "use", "v"}

_SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


OWN = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits", "_words", "_j", "_base", "_keys", "_rank", "_votes", "_found", "_there"}


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def _phrase_at(words: list[str]) -> str:
    """SQL: the hits at j, j + 1, ... are these words in a row."""
    return " and ".join(f"coalesce(get(hits, j + {k}).w = '{w}' and get(hits, j + {k}).i = hits[j].i + {k}, false)" for k, w in enumerate(words))


def scan(docs: DataFrame, text: str = "text", rare: int = 6, agree: int = 2) -> DataFrame:
    """Append n_words, n_base, first_word, last_word, base_labels, labels, score; ``text`` itself goes.

    A null text is empty: no words, no labels, score 0. Labels are sorted and joined by commas.
    score is 1 with a base label, else the share of the best verified template's looked-up words
    that agree on its offset. Words of equal frequency rank by their spelling; rows are independent,
    so repeated rows get equal results, and an empty table stays empty. Other columns pass through,
    but for those that clash with the appended ones, which are replaced.
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        indexed = [(p, w) for p, w in enumerate(_words(notice)) if w not in FUNCTION_WORDS]
        sizes.append(len(indexed))
        for p, w in indexed:
            postings.setdefault(w, []).append((t, p))
    vocabulary = set(postings) | {w for x in [*PHRASES, *(k for _, _, k in TEMPLATES)] for w in x.split()}
    listed = ", ".join(f"'{w}'" for w in sorted(vocabulary))
    have = [F.col(c) for c in docs.columns if c != text and c.lower() not in OWN]
    words = docs.select(*have, F.expr(f"filter(split(coalesce(`{text}`, ''), '{_SEPARATORS}'), w -> w <> '')").alias("_words"))
    lowered = f"filter(transform(_words, (w, i) -> struct(if(octet_length(w) <= 16, lower(w), '') as w, i as i, octet_length(w) as n)), x -> x.w in ({listed}) and octet_length(x.w) = x.n)"
    narrow = words.select(*have, F.expr("cast(size(_words) as bigint)").alias("n_words"), F.expr(f"transform({lowered}, x -> struct(x.w as w, x.i as i))").alias("hits"))
    narrow = exchange.cut(narrow)  # few hits a text: small beside the texts, which are not read again
    df = narrow.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    n = narrow.count()
    freq = {r["w"]: r["count"] for r in df.collect()}  # one row for each word of the vocabulary at most
    idf = {w: math.log((n + 1) / (freq.get(w, 0) + 1)) for w in sorted(vocabulary)}
    ordered = ["array(" + ", ".join(repr(w) for w in sorted({w for w in _words(notice) if w in postings}, key=lambda w: (-idf[w], w))) + ")" for _, notice, _ in TEMPLATES]
    struct = lambda tp: f"struct({tp[0]} as t, {tp[1]} as p)"
    post_map = "map(" + ", ".join(f"'{w}', array({', '.join(map(struct, x))})" for w, x in sorted(postings.items())) + ")"
    base = "concat(" + ", ".join(f"transform(filter(_j, j -> {_phrase_at(p.split())}), j -> struct(hits[j].i as i, '{label}' as label))" for p, label in PHRASES.items()) + ")"
    keys = "array_distinct(flatten(transform(_j, j -> filter(array(" + ", ".join(f"if({_phrase_at(k.split())}, {t}, -1)" for t, (_, _, k) in enumerate(TEMPLATES)) + "), t -> t >= 0))))"
    places = narrow.withColumn("_j", F.expr("if(size(hits) = 0, cast(array() as array<int>), sequence(0, size(hits) - 1))"))
    places = places.select(*have, "n_words", "hits", F.expr(base).alias("_base"), F.expr(keys).alias("_keys"))
    there = "array_distinct(hits.w)"
    looked_up = ", ".join(f"struct({t} as t, slice(array_intersect({ordered[t]}, _there), 1, {rare}) as words)" for t in range(len(TEMPLATES)))
    places = places.withColumn("_there", F.expr(there))
    ranked = places.withColumn("_rank", F.expr(f"if(size(_there) < {agree}, null, filter(array({looked_up}), r -> size(r.words) >= {agree}))"))
    of_template = f"transform(filter({post_map}[h.w], p -> p.t = r.t), p -> struct(p.t as t, h.i - p.p as o, h.i as i))"
    offsets = f"flatten(transform(_rank, r -> flatten(transform(filter(hits, h -> array_contains(r.words, h.w)), h -> {of_template}))))"
    voted = ranked.select(*have, "n_words", "_base", "_keys", F.expr(f"if(coalesce(size(_rank), 0) <= 0, null, array_sort({offsets}))").alias("_votes"))
    # runs of equal (template, offset): how many looked-up words agree
    least = "map(" + ", ".join(f"{t}, {min(rare, s)}" for t, s in enumerate(sizes)) + ")"
    start = "struct(-1 as t, 0 as o, 0 as n, cast(array() as array<struct<t: int, n: int>>) as found)"
    step = "struct(v.t as t, v.o as o, if(v.t = a.t and v.o = a.o, a.n + 1, 1) as n, if(a.n >= {m}, concat(a.found, array(struct(a.t as t, a.n as n))), a.found) as found)"
    step = f"if(v.t = a.t and v.o = a.o, struct(v.t as t, v.o as o, a.n + 1 as n, a.found as found), {step.format(m=agree)})"
    last = f"if(a.n >= {agree}, concat(a.found, array(struct(a.t as t, a.n as n))), a.found)"
    found = voted.withColumn("_found", F.expr(f"if(_votes is null, cast(array() as array<struct<t: int, n: int>>), filter(aggregate(_votes, {start}, (a, v) -> {step}, a -> {last}), x -> array_contains(_keys, x.t)))"))
    names = "map(" + ", ".join(f"{t}, '{label}'" for t, (label, _, _) in enumerate(TEMPLATES)) + ")"
    return found.select(
        *have, "n_words",
        F.expr("cast(size(_base) as bigint)").alias("n_base"),
        F.expr("cast(array_min(_base.i) as bigint)").alias("first_word"),
        F.expr("cast(array_max(_base.i) as bigint)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(_base.label)), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_distinct(concat(_base.label, transform(_found, x -> {names}[x.t])))), ',')").alias("labels"),
        F.expr(f"if(size(_base) > 0, 1D, coalesce(array_max(transform(_found, x -> least(1D, x.n / {least}[x.t]))), 0D))").alias("score"),
    )
