"""Licence scan with a positional index of rare words, in DataFrame functions only.

The words of licence notices are looked up in all documents and counted, so each notice knows its rarest words; these and
the words of its key phrases, with their places in the notice, are the index. Documents that hold all key words of some
notice (no other can get a label) are looked up at every place where an indexed word stands; a place minus the place in the
notice tells where the notice would begin, and places of the index whose beginnings lie within SLACK words of each other add
up, each once, so words put in or left out do no harm. A span of beginnings that gathers SHARE of a notice's weight is a
candidate, and becomes a label when all key phrases of the notice stand in the words from there on.

Fixed phrases are searched beside this and always count. Nothing is capped: every occurrence of the looked-up words is
one row, and rows are put together per document, notice and span before the shuffle.

Edge cases: a null text counts as empty; a null doc_id is kept; equal rows are scanned each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import settle, whole

#: What a word is after lower-casing, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Terms of the Creative Commons licences after `by`, and how they are written in full.
CC = {
    "": [""], "sa": ["sharealike", "share alike"], "nd": ["noderivatives", "noderivs"], "nc": ["noncommercial", "non commercial"],
    "nc sa": ["noncommercial sharealike", "non commercial share alike"], "nc nd": ["noncommercial noderivatives", "noncommercial noderivs"],
}
#: Words that behind a Creative Commons name make it another one.
FURTHER = "nc|sa|nd|noncommercial|non|sharealike|share|noderivatives|noderivs"

#: Notices: label, text, key phrases that must stand in it.
NOTICES = [
    ("mit", "under the mit license", ["mit license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
            "whom the software is furnished to do so subject to the following conditions",
     ["hereby granted free of charge", "without restriction"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction", ["hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                   "with the license", ["apache license", "in compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["with or without fee"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     ["affero general public license"]),
    ("epl", "under the terms of the eclipse public license", ["eclipse public license"]),
    ("bsd", "under the bsd license", ["bsd license"]),
    *[("bsd", f"{name} license", [name]) for k in "0234" for name in (f"bsd {k} clause", f"{k} clause bsd")],
    ("zlib", "under the zlib license", ["zlib license"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
             "and redistribute it freely subject to the following restrictions",
     ["granted to anyone to use this software", "alter it and redistribute it freely"]),
    ("cc0", "under cc0", ["under cc0"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work",
     ["waived all copyright and related or neighboring rights"]),
    *[("cc-by" + "".join(f"-{t}" for t in terms.split()), text, [text]) for terms, names in CC.items()
      for text in [f"cc by {terms}".strip(), *[f"creative commons attribution {n}".strip() for n in names]]],
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]

#: Words of a notice in the index beside its key words: this share of them, and so many at most; weight that makes a
#: candidate; words by which beginnings may differ.
INDEXED, RARE, SHARE, SLACK = 0.6, 8, 0.6, 6


def words_of(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(WORD), F.lit(0))


def notice_words() -> list[str]:
    return sorted({w for _, text, _ in NOTICES for w in text.split()})


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each word of a notice stands, and the number of documents."""
    vocabulary = F.array(*[F.lit(w) for w in notice_words()])
    found = docs.select(F.explode_outer(F.array_intersect(words_of(), vocabulary)).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the notices' words
    return {r.word: r.n for r in counts if r.word is not None}, docs.count()


def index_rows(known: dict[str, int], documents: int) -> tuple[dict[str, float], list[tuple[int, str, int]]]:
    """Weights of the indexed words, and postings (notice, word, place): each notice's rarest words and key words."""
    idf = {w: math.log((documents + 1) / (known.get(w, 0) + 1)) + 1e-3 for w in notice_words()}
    postings = []
    for k, (_, text, keys) in enumerate(NOTICES):
        words = text.split()
        rarest = sorted(set(words), key=lambda w: (-idf[w], w))
        rarest = set(rarest[: min(RARE, max(2, math.ceil(INDEXED * len(rarest))))]) | set(" ".join(keys).split())
        postings += [(k, w, place) for place, w in enumerate(words) if w in rarest]
    return {w: idf[w] for _, w, _ in postings}, postings


def _places(phrase: str) -> Column:
    """Places where the words of a phrase stand one after the other in the column `words`."""
    parts = phrase.split()
    last = F.size("words") - len(parts)

    def here(i: Column) -> Column:
        same = F.col("words")[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.col("words")[i + k] == part)
        return same

    found = F.filter(F.sequence(F.lit(0), last), here)
    return F.when(last >= 0, found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known, documents = frequencies(docs)
    idf, postings = index_rows(known, documents)
    by_weight = F.array(*[F.lit(w) for w in sorted(idf, key=lambda w: (-idf[w], w))])

    likely = "|".join(SEPARATOR.join(p.split()) for p in PHRASES)
    none = F.array().cast("array<int>")
    may_hold = F.lower(whole()).rlike(likely)
    read = docs.select("doc_id", words_of().alias("words"), may_hold.alias("may_hold"))
    read = read.select(
        "*",
        # array_intersect keeps the order of its first argument: rarest words first
        F.array_intersect(by_weight, "words").alias("rarest"),
        *[F.when(F.col("may_hold"), _places(p)).otherwise(none).alias(f"at_{label}") for p, label in PHRASES.items()],
    )
    every = F.concat(*[F.col(f"at_{label}") for label in PHRASES.values()])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, label) for label in PHRASES.values()]))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("rarest", F.col("words")[i]))
    hits = F.transform(places, lambda i: F.struct(i.alias("place"), F.col("words")[i].alias("word")))
    # every key phrase must stand in a document, so all of its words must
    candidate = F.lit(False)
    for words in sorted({" ".join(sorted(set(" ".join(keys).split()))) for _, _, keys in NOTICES}):
        all_held = F.lit(True)
        for w in sorted(words.split(), key=lambda w: (-idf[w], w)):
            all_held = all_held & F.array_contains("rarest", w)
        candidate = candidate | all_held
    rows = settle(
        read.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"), base.alias("base"),
            F.when(candidate, F.col("words")).alias("words"), F.when(candidate, hits).alias("hits"),
        ),
        "license-rows",
    )
    found = _notices(rows, idf, postings)
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return rows.drop("words", "hits").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("score"),
    )


def _notices(rows: DataFrame, idf: dict[str, float], postings: list[tuple[int, str, int]]) -> DataFrame:
    """row, found (labels of notices), weight (the best share of a notice's weight)."""
    spark = rows.sparkSession
    total: dict[int, float] = {}
    bits: dict[int, list[float]] = {}
    rows_of_index = []
    for k, word, _ in postings:
        total[k] = total.get(k, 0.0) + idf[word]
    for k, word, place in postings:
        parts = bits.setdefault(k, [])
        rows_of_index.append((k, word, place, len(parts) // 63, 1 << len(parts) % 63))
        parts.append(idf[word] / total[k])
    index = spark.createDataFrame(rows_of_index, "notice INT, word STRING, at INT, mask INT, bit BIGINT")
    hits = rows.where(F.col("hits").isNotNull()).select("row", F.explode("hits").alias("hit"))
    aligned = hits.select("row", F.col("hit.word").alias("word"), F.col("hit.place").alias("place"))
    aligned = aligned.join(F.broadcast(index), "word")  # the index is the fixed notices' words
    aligned = aligned.withColumn("begin", F.col("place") - F.col("at"))
    # spans overlap by half: beginnings up to SLACK apart share one
    span = F.floor(F.col("begin") / SLACK)
    aligned = aligned.withColumn("span", F.explode(F.array(span - 1, span)))
    masks = range(1 + max(r[3] for r in rows_of_index))
    gathered = aligned.groupBy("row", "notice", "span").agg(
        F.min("begin").alias("begin"), F.max("begin").alias("last_begin"),
        *[F.coalesce(F.bit_or(F.when(F.col("mask") == m, F.col("bit"))), F.lit(0)).alias(f"mask{m}") for m in masks],
    )
    parts_of = F.create_map(*[x for k, parts in bits.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in parts]))])
    seen = lambda i: F.element_at(F.array(*[F.col(f"mask{m}") for m in masks]), (F.floor(i / 63) + 1).cast("int"))
    held_part = lambda p, i: F.when(F.getbit(seen(i), i % 63) == 1, p).otherwise(0.0)
    weight = F.aggregate(F.transform(F.element_at(parts_of, F.col("notice")), held_part), F.lit(0.0), lambda x, y: x + y)
    likely = gathered.withColumn("weight", weight).where(F.col("weight") >= SHARE - 1e-9)

    held = rows.where(F.col("words").isNotNull()).select("row", "words").join(likely, "row")
    label, verified = F.lit(None).cast("string"), F.lit(False)
    for k, (name, text, keys) in enumerate(NOTICES):
        first = F.greatest(F.col("begin"), F.lit(0))
        until = F.greatest(F.col("last_begin") + len(text.split()) + SLACK, first)
        window = F.slice("words", first + 1, until - first)
        held_text = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        here = F.col("notice") == k
        label = F.when(here, name).otherwise(label)
        for key in keys:
            held_key = held_text.rlike(f" {key} (?!({FURTHER}) )") if name.startswith("cc-by") else held_text.contains(f" {key} ")
            here = here & held_key
        verified = F.when(F.col("notice") == k, here).otherwise(verified)
    told = held.where(verified).select("row", label.alias("label"), "weight").distinct()
    return told.groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("found"), F.least(F.max("weight"), F.lit(1.0)).alias("weight")
    )
