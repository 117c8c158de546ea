"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are word sequences. The index maps each template's words of the highest inverse document frequency to
their places in the templates. A file looks up every index word that it holds, so that no template is crowded
out by another's words; each place of such a word, less its place in a template, votes for where that template
would start; where enough different words agree, the words that follow must hold every key phrase of the template. Plain phrases (the base) are found wherever their words
stand consecutively.

Rows: a null text is an empty text with no words, null first_word and last_word, empty labels and score 0; a
repeated row is scanned each time; ties in frequency go by word; very long texts are scanned whole; a null
doc_id is carried; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, text_or_empty

#: A word, and what parts words, in texts with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word where A-Z are not yet lower-cased; as many matches.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


#: Licence notices and the phrases each of them must hold.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
#: So many of a template's words, rarest first, are in the index, and so many of them must agree.
KEYS, VOTES = 4, 2
#: Words the region may be longer than the template.
SLACK = 2


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def _split(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def frequencies(docs: DataFrame, words: list[str]) -> list[str]:
    """words, those of the fewest documents first. Every document counts; the driver gets a row for each word."""
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, words)), _split(ascii_lower(text_or_empty())))).alias("word"))
    df = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (df.get(w, 0), w))


def _string_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively in the array."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    ranked = frequencies(docs, vocabulary(templates))
    # Each template answers for its rarest words; they are the index's keys.
    keys = {k: [w for w in ranked if w in t.text.split()][:KEYS] for k, t in enumerate(templates)}
    index: dict[str, list[Column]] = {}
    for k, t in enumerate(templates):
        for place, word in enumerate(t.text.split()):
            if word in keys[k]:
                index.setdefault(word, []).append(F.struct(F.lit(k).alias("template"), F.lit(place).alias("place")))
    rare = [w for w in ranked if w in index]

    # Texts without a licence word or a base phrase's first word, most of all, are only counted.
    heads = sorted({*rare, *(p.split()[0] for p in base)})
    bounded = rf"(?i)(^|{GAP})({'|'.join(heads)})($|{GAP})"
    raw = docs.select("doc_id", text_or_empty().alias("raw"))
    rows = raw.select(
        "doc_id",
        F.regexp_count("raw", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(F.col("raw").rlike(bounded), _split(ascii_lower(F.col("raw")))).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    for k, phrase in enumerate(base):
        rows = rows.withColumn(f"base{k}", _starts(F.col("words"), phrase))
    places = F.concat(*[F.col(f"base{k}") for k in range(len(base))])
    rows = rows.withColumn("places", places).withColumn(
        "base_found", F.filter(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(base.values())]), lambda x: x.isNotNull())
    )

    # The file's index words, their places, and a vote of each for (template, start).
    rows = rows.withColumn("anchors", F.array_intersect(F.array(*map(F.lit, rare)), F.col("words")))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(F.col("anchors"), x["word"]))
    rows = rows.withColumn("hits", F.when(F.size("anchors") > 0, hits))
    postings = _string_map({w: F.array(*index[w]) for w in rare})
    votes = F.flatten(
        F.transform("hits", lambda h: F.transform(postings[h["word"]], lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["place"]).alias("start"))))
    )
    rows = rows.withColumn("votes", F.array_sort(votes))
    needed = F.array(*[F.lit(min(VOTES, len(keys[k]))) for k in range(len(templates))])
    # Sorted votes: a run of n equal ones ends n - 1 places on.
    def agreed(i: Column) -> Column:
        v = F.get(F.col("votes"), i)
        return F.get(F.col("votes"), i + F.get(needed, v["template"]) - 1) == v

    starts = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("votes") - 1, F.lit(0))), agreed), lambda i: F.get(F.col("votes"), i)))
    rows = rows.withColumn("starts", F.when(F.size("votes") > 0, starts))

    lengths = F.array(*[F.lit(len(t.text.split()) + SLACK) for t in templates])
    phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in t.phrases]) for t in templates])

    def region(s: Column) -> Column:
        low = F.greatest(s["start"] - SLACK, F.lit(0))
        return F.concat(F.lit(" "), F.array_join(F.slice(F.col("words"), low + 1, F.get(lengths, s["template"]) + SLACK), " "), F.lit(" "))

    def holds(s: Column) -> Column:
        return F.forall(F.get(phrases, s["template"]), lambda p: region(s).contains(p))

    verified = F.filter("starts", holds)
    names = F.array(*[F.lit(t.label) for t in templates])
    rows = rows.withColumn("found", F.array_distinct(F.transform(F.coalesce(verified, F.array().cast("array<struct<template:int,start:int>>")), lambda s: F.get(names, s["template"]))))
    agreed_share = F.lit(0.5) + F.lit(0.5) * F.least(F.lit(1.0), F.size("anchors") / F.lit(float(KEYS)))
    score = F.when(F.size("found") > 0, agreed_share).when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_found", "found")), ",").alias("labels"),
        score.alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
