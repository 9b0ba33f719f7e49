"""License scans by an exact set-similarity join of templates with text blocks.

A template is a notice's words as a set, its tokens in the global order of rarity (occurrences
counted over all documents, rarest first). A text's blocks for a template of m words are the runs
of 2 m words that start at every m-th word, so any m consecutive words lie in one block. The join
finds every block that contains at least ``threshold`` of a template's tokens:

* prefix: of |T| tokens of which o are needed, such a block has one of the |T| - o + 1 rarest;
* length: a block of fewer than o words can't have o of them;
* position: with the block's first match being token i of the template and token j of the
  block's own template words in the same order, no more than 1 + min(|T| - i, |B| - j) - 1
  can match;
* what remains is verified by counting.

The *base* phrases are templates of threshold 1 whose blocks are their own number of consecutive
words; their prefix is their rarest token, whose place in the phrase fixes where it would start,
and the words are compared one by one.

Result: n_words, n_base (all places of base phrases), first_word and last_word (least and greatest
start of these), base_labels and labels (distinct, sorted, comma-joined; labels has the templates'
too) and score (the largest containment found; 1 with a base phrase, 0 without a finding).

Defined results: null, empty and wordless texts have no words and no labels (empty strings);
repeated rows get equal results; an empty table gives no row. Columns named like a result column
are replaced, others stay. Templates are a parameter and few; their index is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from callgauge.llm import common
from callgauge.llm.textbytes import HashSet, Words, flat

RESULTS = {"n_words": LongType(), "n_base": LongType(), "first_word": LongType(), "last_word": LongType(),
           "base_labels": StringType(), "labels": StringType(), "score": DoubleType()}

# Phrases and labels of the base rule.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of common license notices, a label and the share of their distinct words that counts.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice", 0.8),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", 0.8),
    ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "apache-notice", 0.8),
    ("licensed under the apache license version 2.0", "apache-2.0", 0.9),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice", 0.8),
    ("released under the mit license", "mit-release", 0.9),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice", 0.8),
    ("licensed under cc by nc 4.0", "cc-by-nc", 0.9),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by-notice", 0.8),
    ("all rights reserved", "all-rights-reserved", 1.0),
)


@dataclass
class _Template:
    label: str
    words: np.ndarray  # the words in order, as places in the vocabulary
    tokens: np.ndarray  # the distinct words, rarest first
    need: int

    @property
    def prefix(self) -> np.ndarray:
        return self.tokens[: len(self.tokens) - self.need + 1]


class LicenseIndex:
    """The vocabulary of phrases and templates; ``order`` sets the global order of its tokens."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        said = [(*p, 1.0) for p in phrases] + list(templates)
        w = Words(*flat(pa.array([t for t, _, _ in said], pa.large_string())))
        self.vocabulary, self.n_phrases = HashSet(w.hashes), len(phrases)
        place = np.searchsorted(self.vocabulary.sorted, w.hashes)
        self.said = [(label, place[a:b], share) for (_, label, share), a, b in zip(said, w.first[:-1], w.first[1:])]
        self.spelt = [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:])]

    def order(self, counts: np.ndarray) -> LicenseIndex:
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.rank, made = rank, []
        for label, words, share in self.said:
            tokens = np.unique(words)
            tokens = tokens[np.argsort(rank[tokens])]
            made.append(_Template(label, words, tokens, int(np.ceil(share * len(tokens) - 1e-9))))
        self.phrases, self.templates = made[: self.n_phrases], made[self.n_phrases:]
        return self

    def find_phrases(self, w: Words, at: np.ndarray, token: np.ndarray) -> list[tuple[int, int, str]]:
        """Text, first word and label of every place of a phrase. ``at``, ``token``: words in the vocabulary."""
        out = []
        for k, t in enumerate(self.phrases):
            rarest = t.tokens[0]
            for offset in np.flatnonzero(t.words == rarest)[:1].tolist():  # one place of it in the phrase is enough
                start = at[token == rarest] - offset
                text = np.searchsorted(w.first, start + offset, "right") - 1
                fits = (start >= w.first[text]) & (start + len(t.words) <= w.first[text + 1])
                for s, d in zip(start[fits].tolist(), text[fits].tolist()):
                    if w.text(s, s + len(t.words)) == self.spelt[k]:
                        out.append((d, s, t.label))
        return out

    def find_templates(self, w: Words, at: np.ndarray, token: np.ndarray) -> list[tuple[int, int, int, str, float]]:
        """Text, first and end word, label and containment of every block that has enough of a template."""
        out = []
        text = np.searchsorted(w.first, at, "right") - 1
        for t in self.templates:
            m = len(t.words)
            in_prefix = np.isin(token, t.prefix)
            d, place = text[in_prefix], at[in_prefix] - w.first[text[in_prefix]]
            last = place // m  # the blocks with this word: that which starts in its stretch of m words, and the one before
            blocks = np.unique(np.concatenate([np.stack([d, last]), np.stack([d[last > 0], last[last > 0] - 1])], axis=1), axis=1)
            start = w.first[blocks[0]] + blocks[1] * m
            end = np.minimum(start + 2 * m, w.first[blocks[0] + 1])
            long_enough = end - start >= t.need
            position = np.full(len(self.rank), -1)
            position[t.tokens] = np.arange(len(t.tokens))
            for d, s, e in zip(blocks[0][long_enough].tolist(), start[long_enough].tolist(), end[long_enough].tolist()):
                own = np.unique(token[np.searchsorted(at, s): np.searchsorted(at, e)])
                own = own[np.argsort(self.rank[own])]
                i = position[own]
                j = int(np.argmax(i >= 0))
                if 1 + min(len(t.tokens) - int(i[j]), len(own) - j) - 1 < t.need:
                    continue
                n = int((i >= 0).sum())
                if n >= t.need:
                    out.append((d, s, e, t.label, n / len(t.tokens)))
        return out


def _counted(docs: DataFrame, index: LicenseIndex) -> np.ndarray:
    """How often each vocabulary token occurs in all documents."""
    vocabulary = index.vocabulary

    def run(batches):
        total = np.zeros(len(vocabulary.sorted), dtype=np.int64)
        for batch in batches:
            w = Words(*flat(batch.column("text")))
            total += np.bincount(vocabulary.find(w.hashes)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    counts = np.zeros(len(vocabulary.sorted), dtype=np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with the result columns."""
    spark = docs.sparkSession
    common.prepare(spark)
    index = LicenseIndex(phrases, templates)
    shared = spark.sparkContext.broadcast(index.order(_counted(docs, index)))
    own = [c for c in docs.columns if c not in RESULTS]

    def run(batches):
        index = shared.value
        for batch in batches:
            w = Words(*flat(batch.column("__text")))
            at, token = index.vocabulary.find(w.hashes)
            n = batch.num_rows
            base, all_, starts, score = ([set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)], [0.0] * n)
            for d, s, label in index.find_phrases(w, at, token):
                base[d].add(label)
                all_[d].add(label)
                starts[d].append(s - int(w.first[d]))
                score[d] = 1.0
            for d, _, _, label, share in index.find_templates(w, at, token):
                all_[d].add(label)
                score[d] = max(score[d], share)
            joined = [pa.array([",".join(sorted(x)) for x in y]) for y in (base, all_)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(own)], pa.array(w.counts(), pa.int64()), pa.array([len(x) for x in starts], pa.int64()),
                 pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()), *joined, pa.array(score, pa.float64())],
                names=[*own, *RESULTS])

    given = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = StructType(list(docs.select(*own).schema.fields))
    for name, kind in RESULTS.items():
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS)
