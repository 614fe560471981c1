"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words and the least share of them that a text block
must contain.  Blocks are ``BLOCK`` words long and start every ``STEP`` words,
so any unbroken copy of a template (at most ``BLOCK - STEP + 1`` words) lies
inside one block.  Template words are ordered by how many documents of the
corpus hold them, rarest first, and the join runs on few of them:

* prefix filter: a block that contains ``need`` of a template's ``size`` words
  holds one of its ``size - need + 1`` rarest, among the block's own
  ``|block| - need + 1`` rarest template words;
* length filter: a block with fewer than ``need`` template words is out;
* positional filter: from the first common word on, both sides must have
  ``need`` words left.

What passes is verified on the whole word sets, so no block is missed and none
is found in error.  Phrases are templates of which every word is needed; an
exact check for the consecutive words follows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import id_text, per_batch, stored, term_lists

BLOCK, STEP = 128, 64
#: Room for the code of a word beside its place in one long.
CODES = 1 << 16


@dataclass(frozen=True)
class Template:
    """Words of ``text``, of which a block must contain the share ``least``; a ``phrase`` also consecutively."""

    label: str
    text: str
    least: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return [w for ws in term_lists(self.text.encode()) for w in ws]

    @property
    def need(self) -> int:
        return math.ceil(self.least * len(set(self.words)) - 1e-9)


# The phrases of the contract.
PHRASES = [
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
]
# Opening words of public license notices.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0),
    Template("apache-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
             "You may obtain a copy of the License at"),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
             "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
             "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
             "distribute, sublicense, and/or sell copies of the Software"),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
]
TEMPLATES = PHRASES + NOTICES


def word_order(texts: DataFrame, templates: list[Template]) -> list[bytes]:
    """The templates' words by the number of texts that hold them, rarest first (ties: by the word)."""
    wanted = {w for t in templates for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                seen.update(set().union(*(wanted.intersection(ws) for ws in term_lists(text.as_py()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = per_batch(texts.select("text"), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    held = {bytes(r.word): r.n for r in counted.collect()}  # words of the templates alone
    return sorted(wanted, key=lambda w: (held.get(w, 0), w))


def _template_rows(templates: list[Template], code: dict[bytes, int]) -> list[tuple]:
    """One row for each word of each template's prefix."""
    rows = []
    for k, t in enumerate(templates):
        seq = [code[w] for w in t.words]
        if not seq or len(seq) > BLOCK - STEP + 1 or not 0 < t.least <= 1:
            raise ValueError(f"template {t.label}: 1 to {BLOCK - STEP + 1} words and a share in (0, 1] are needed")
        words = sorted(set(seq))
        rows += [(c, place, k, t.label, t.phrase, seq, words, len(words), t.need) for place, c in enumerate(words[: len(words) - t.need + 1])]
    return rows


def _measure(code: dict[bytes, int], prefix: set[int], least: int):
    """``doc_id, n_words`` and the blocks that hold a word of some prefix and at least ``least`` template words."""
    in_prefix = np.zeros(len(code) + 1, bool)
    in_prefix[list(prefix)] = True
    block = pa.struct([("block", pa.int64()), ("words", pa.list_(pa.int32())), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").cast(pa.binary()):
                parts = [np.array([code.get(w, 0) for w in ws], np.int32) for ws in term_lists(text.as_py())]
                codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
                counts.append(len(codes))
                near = np.flatnonzero(in_prefix[codes]) // STEP
                out = []
                for k in np.unique(np.concatenate([near, near[near > 0] - 1])).tolist():
                    part = codes[k * STEP : k * STEP + BLOCK]
                    at = np.flatnonzero(part)
                    words = np.unique(part[at])
                    if len(words) >= least:
                        out.append({"block": k, "words": words.tolist(), "places": ((at + k * STEP) * CODES + part[at]).tolist()})
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(block))], names=["doc_id", "n_words", "blocks"])

    return run


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, found`` of every document; repeated rows repeat, null and empty texts have no words.

    ``found`` has an element for every block and template that meet: ``label,
    phrase, block, starts`` (word places of a phrase that begin in the block's
    first ``STEP`` words, so each is listed once) and ``contained``, the share
    of the template's words in the block.  A phrase is found only where it has
    starts.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    code = {w: k + 1 for k, w in enumerate(word_order(texts, templates))}
    if len(code) >= CODES:
        raise ValueError(f"more than {CODES - 1} different template words")
    rows = _template_rows(templates, code)
    prefix, least = {r[0] for r in rows}, min(r[8] for r in rows)
    measured = per_batch(texts, _measure(code, prefix, least), "doc_id bigint, n_words bigint, blocks array<struct<block: bigint, words: array<int>, places: array<bigint>>>")
    # numbered when written: what is read back has fixed numbers
    measured = stored(measured.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    wanted = spark.createDataFrame(rows, "word int, place int, template int, label string, phrase boolean, seq array<int>, all array<int>, size int, need int")
    blocks = measured.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    each = blocks.select("*", F.size("words").alias("held"), F.posexplode("words").alias("at", "word"))
    # prefix, length and positional filters; then the whole sets, once for each pair: at its first common word
    near = each.join(wanted, "word").where("held >= need AND at <= held - need AND 1 + least(size - place - 1, held - at - 1) >= need")
    common = near.withColumn("common", F.array_intersect("words", "all")).where("size(common) >= need AND common[0] = word")
    whole = F.expr(f"transform(filter(places, c -> size(array_except(transform(seq, (w, i) -> (c div {CODES} + i) * {CODES} + w), places)) = 0), c -> c div {CODES})")
    met = (common.withColumn("starts", F.when(F.col("phrase"), F.filter(whole, lambda s: F.floor(s / STEP) == F.col("block"))).otherwise(F.array().cast("array<bigint>")))
           .where("NOT phrase OR size(starts) > 0")
           .select("row", F.struct("label", "phrase", "block", "starts", (F.size("common") / F.col("size")).alias("contained")).alias("one")))
    found = met.groupBy("row").agg(F.collect_list("one").alias("found"))  # at most a text's own blocks
    return measured.select("row", "doc_id", "n_words").join(found, "row", "left").select("doc_id", "n_words", F.coalesce("found", F.array()).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score of every document of ``scan``."""
    starts = F.flatten(F.transform("found", lambda x: x["starts"]))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.filter("found", lambda x: x["phrase"])).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["contained"])), F.lit(0.0)).alias("score"))
