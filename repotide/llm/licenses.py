"""License scans: an exact set-similarity join of text blocks with license templates.

A template is held by a block if enough of its words are among the block's. Tokens are put in one global order,
the rarest first, by the number of documents that hold them. Then a block that holds a template shares a token of
the template's short prefix with its own prefix, and only such pairs are looked at further.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repotide.session import cut

#: A block is BLOCK words in a row, a new one starts every STEP words; any span of BLOCK - STEP + 1 words lies in one.
BLOCK, STEP = 64, 32
#: Share of a template's words that a block must hold, in hundredths; a template of fewer than SHORT words is held whole.
PERCENT, SHORT = 80, 10
#: Templates that go through the texts together; a larger library takes more passes.
PASS = 2000


@dataclass(frozen=True)
class Template:
    """A license text. ``phrase``: its words must also stand in a row (an exact check after the join)."""

    label: str
    text: str
    phrase: bool = False


# Wording of public license notices and of the three base phrases.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("agpl", "gnu affero general public license", True),
    Template("apache-2.0", "apache license", True),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "licensed under a creative commons attribution international license"),
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-nd", "cc by nd", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "gnu lesser general public license", True),
    Template("mit", "mit license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
BASE = ("cc by", "general public license", "all rights reserved")

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HITS = "array<struct<template:int,start:long,stop:long,overlap:int,places:array<long>>>"


def words_of(text: str | None) -> list[str]:
    """Words of a text, A-Z in lower case; none for null."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


def needed(size: int, percent: int = PERCENT, short: int = SHORT) -> int:
    """Words of a template of ``size`` different words that a block must hold."""
    return size if size < short else -(-size * percent // 100)


class TemplateIndex:
    """Templates by the tokens of their prefixes, under a global order of tokens."""

    def __init__(self, templates: list[tuple[int, Template]], frequency: dict[str, int], percent: int, short: int):
        sets = {i: set(words_of(t.text)) for i, t in templates}
        vocabulary = {w for s in sets.values() for w in s}
        order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.ranks, self.least, self.phrases = {}, {}, {}
        postings = defaultdict(list)
        for i, t in templates:
            own = sorted(self.rank[w] for w in sets[i])
            if not own:
                continue
            self.ranks[i], self.least[i] = frozenset(own), needed(len(own), percent, short)
            if t.phrase:
                self.phrases[i] = [self.rank[w] for w in words_of(t.text)]
            for at in range(len(own) - self.least[i] + 1):
                postings[own[at]].append((i, len(own) - at, self.least[i]))
        self.postings = dict(postings)

    def search(self, words: list[str], block: int, step: int) -> list[tuple[int, int, int, int, list[int]]]:
        """(template, start, stop, overlap, places of a phrase) of every block of ``words`` that holds a template."""
        codes = list(map(self.rank.get, words))
        postings, last = self.postings, max(0, -(-(len(words) - block) // step))
        blocks = {k for i, c in enumerate(codes) if c in postings
                  for k in range(max(0, (i - block) // step + 1), min(i // step, last) + 1)}
        out = []
        for k in sorted(blocks):
            start, stop = k * step, min(k * step + block, len(words))
            own = set(codes[start:stop])
            own.discard(None)
            ordered, size, seen = sorted(own), len(own), set()
            for at, token in enumerate(ordered):
                left = size - at
                for template, rest, least in postings.get(token, ()):
                    # A first common token: neither side has more than ``rest`` and ``left`` tokens from here on.
                    if template in seen or size < least or left < least or rest < least:
                        continue
                    seen.add(template)
                    overlap = len(self.ranks[template] & own)
                    if overlap < least:
                        continue
                    places = []
                    if phrase := self.phrases.get(template):
                        places = [i for i in range(start, stop - len(phrase) + 1)
                                  if codes[i] == phrase[0] and codes[i:i + len(phrase)] == phrase]
                        if not places:
                            continue
                    out.append((template, start, stop, overlap, places))
        return out


def token_frequencies(docs: DataFrame, vocabulary: set[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each of the templates' tokens; one count a token and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = defaultdict(int)
        for batch in batches:
            for value in batch.column(0):
                for w in vocabulary.intersection(words_of(value.as_py())):
                    found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "w string, n long")
    return {r["w"]: r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(
    spark: SparkSession, docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text",
    percent: int = PERCENT, short: int = SHORT, block: int = BLOCK, step: int = STEP, per_pass: int = PASS,
) -> DataFrame:
    """(``key``, n_words long, hits): the blocks of each whole text that hold a template.

    A hit has the template's number in ``templates``, the block's words from ``start`` up to ``stop`` (from 0), the
    number of the template's words in it and, for a phrase, the places where its words stand in a row (blocks
    without such a place are no hits). Blocks overlap, so one place can be in several hits. Every row of ``docs``
    gives one row, also repeated ones and those with a null key; a null or empty text has no words and no hits.
    Columns other than the two named are not read.

    One scan counts the tokens of the templates, whose number the library bounds; another one looks up each block.
    Texts are never shuffled, so a very long text or one found many times is only work for its own task. At most
    ``per_pass`` templates are with a task at a time; more of them take more scans.
    """
    longest = max((len(words_of(t.text)) for t in templates if t.phrase), default=0)
    if not 1 <= step <= block - max(longest, 1) + 1:
        raise ValueError("blocks must overlap by the longest phrase less a word")
    frequency = token_frequencies(docs, {w for t in templates for w in words_of(t.text)}, text)
    whole = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def one(first: int) -> DataFrame:
        index = TemplateIndex(list(enumerate(templates))[first:first + per_pass], frequency, percent, short)
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, names = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
                                              ("overlap", pa.int32()), ("places", pa.list_(pa.int64()))])), ("template", "start", "stop", "overlap", "places")
            for batch in batches:
                sizes, hits = [], []
                for value in batch.column("text"):
                    words = words_of(value.as_py())
                    sizes.append(len(words))
                    hits.append([dict(zip(names, h, strict=True)) for h in sent.value.search(words, block, step)])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(hits, kind)], names=["key", "n_words", "hits"])

        return whole.mapInArrow(scan, f"key {whole.schema['key'].dataType.simpleString()}, n_words long, hits {_HITS}")

    starts = range(0, max(1, len(templates)), per_pass)
    if len(starts) == 1:
        return one(0).withColumnRenamed("key", key)
    whole = cut(whole.withColumn("uid", F.monotonically_increasing_id())).select(F.struct("uid", "key").alias("key"), "text")
    parts = reduce(DataFrame.unionByName, [one(s) for s in starts])
    merged = parts.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    return merged.select(F.col("key.key").alias(key), "n_words", "hits")


def license_report(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[str, ...] = BASE, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) from ``scan_licenses``.

    ``score`` is the largest share of a template's words that a block holds among the hits, 0 without any.
    """
    number = {i for i, t in enumerate(templates) if t.text in base and t.phrase}
    labels = F.array(*[F.lit(t.label) for t in templates])
    sizes = F.array(*[F.lit(len(set(words_of(t.text)))) for t in templates])
    ours = F.filter("hits", lambda h: h["template"].isin(*number))
    # Phrases start at different words or differ, so (template, place) tells places apart.
    places = F.array_distinct(F.flatten(F.transform(ours, lambda h: F.transform(
        h["places"], lambda p: F.struct(p.alias("place"), h["template"].alias("template"))))))
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda h: F.get(labels, h["template"])))), ",")
    share = F.array_max(F.transform("hits", lambda h: h["overlap"].cast("double") / F.get(sizes, h["template"]).cast("double")))
    out = found.withColumns({"__places": places, "__ours": ours})
    return out.select(
        key, "n_words", F.size("__places").cast("long").alias("n_base"), F.array_min("__places")["place"].alias("first_word"),
        F.array_max("__places")["place"].alias("last_word"), named(F.col("__ours")).alias("base_labels"),
        named(F.col("hits")).alias("labels"), F.coalesce(share, F.lit(0.0)).alias("score"))
