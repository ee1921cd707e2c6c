"""License scan: TF-IDF cosine to license templates, then inheritance from the nearest directory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slopeweave.llm.shards import in_batches, shards, words
from slopeweave.session import cut

LEAST_COSINE = 0.6
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"
# Notices in use, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
]


@dataclass
class Templates:
    """Unit TF-IDF rows over the sorted hashes of the templates' words, and the words one of
    which every text with at least the least cosine must have."""

    names: list[str]
    hashes: np.ndarray
    rows: np.ndarray
    idf: np.ndarray
    other: float
    needed: np.ndarray


def _codes(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word's hash among ``hashes``; -1 for others."""
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return np.where(hashes[at] == found, at, -1)


def fit(files: DataFrame, templates: list[tuple[str, str]], least: float) -> Templates:
    """Weights from the number of documents, of all of ``files``, that have each word of the templates. Any other
    word weighs as much as the median of these."""
    w = words([t.encode() for _, t in templates])
    hashes = np.unique(w.hash)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(hashes), np.int64), 0
        for _, texts in shards(batches):
            n += len(texts)
            own = words(texts)
            code = _codes(own.hash, hashes)
            seen = np.unique(own.doc[code >= 0] * len(hashes) + code[code >= 0])
            df += np.bincount(seen % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(hashes)), -1], pa.int32()), pa.array([*df, n], pa.int64())], ["word", "n"])

    got = dict(in_batches(files.select("text"), count, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    total = got.pop(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([got.get(i, 0) for i in range(len(hashes))]))) + 1
    rows = np.zeros((len(templates), len(hashes)))
    np.add.at(rows, (w.doc, _codes(w.hash, hashes)), 1)
    rows *= idf
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    needed = np.zeros(len(hashes), bool)
    for row in rows:
        order = np.argsort(-row, kind="stable")
        rest = np.sqrt(np.append(np.cumsum(row[order][::-1] ** 2)[::-1], 0))
        needed[order[:int(np.argmax(rest < least))]] = True
    return Templates([n for n, _ in templates], hashes, rows, idf, float(np.median(idf)), needed)


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of each word, and where lines and paragraphs (sets of lines without a blank one between) begin."""
    w = words(texts)
    ends = np.flatnonzero(np.frombuffer(w.data, np.uint8) == 0x0A)
    line = np.searchsorted(ends, w.start)
    step = np.diff(line, prepend=-2)
    fresh = np.append(True, w.doc[1:] != w.doc[:-1])[:len(w.doc)]
    return w.hash, w.doc, np.flatnonzero(fresh | (step > 0)), np.flatnonzero(fresh | (step > 1))


def headers(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """``doc_id, path, license, score`` of every row of ``files (doc_id, path, text)``.

    Every line and every paragraph of the whole text is a vector of TF-IDF weights; the template with the highest
    cosine to any of them, if at least ``least``, names the license (ties: the first template). Otherwise, and for null texts, both are null.
    """
    model = files.sparkSession.sparkContext.broadcast(fit(files, templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in shards(batches):
            hashes, doc, *starts = _units(texts)
            code = _codes(hashes, m.hashes)
            marks = np.append(0, np.cumsum((code >= 0) & m.needed[code]))
            name, score = [None] * len(texts), [None] * len(texts)
            for first in starts:
                last = np.append(first[1:], len(code))
                for s, e in zip(*(x[marks[last] > marks[first]] for x in (first, last))):
                    kinds, times = np.unique(hashes[s:e], return_counts=True)
                    known = _codes(kinds, m.hashes)
                    weight = times * np.where(known >= 0, m.idf[known], m.other)
                    cosines = m.rows[:, known[known >= 0]] @ weight[known >= 0] / np.linalg.norm(weight)
                    best, d = int(cosines.argmax()), doc[s]
                    if cosines[best] >= least and (score[d] is None or cosines[best] > score[d]):
                        name[d], score[d] = m.names[best], float(cosines[best])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "path", "license", "score"])

    narrow = files.select("doc_id", F.col("path").cast("string").alias("path"), "text")
    return in_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, path string, license string, score double")


def inherit(found: DataFrame, license_file: str = LICENSE_FILE) -> DataFrame:
    """``doc_id, path, license, score, inherited_from`` of every row of ``found``, the rows of ``headers``.

    A file keeps the license of its own. Else it takes that of the nearest directory, its own first and the root
    (an empty path) last, that has a license file with a license; of several there the one with the highest score (then the first by
    license name). A null path inherits nothing. Directories are resolved once each, whatever number of files they have.
    """
    rows = cut(found.withColumn("dir", F.regexp_replace(F.regexp_replace("path", r"(?s)[^/]*$", ""), "/+$", ""))
               .withColumn("name", F.regexp_extract("path", r"(?s)([^/]*)$", 1)), "headers")
    licensed = (rows.filter(F.col("name").rlike(license_file) & F.col("license").isNotNull())
                .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("best"))
                .select(F.col("dir").alias("up"), F.col("best.l").alias("given")))
    dirs = rows.filter("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("depth", "up"))
    nearest = cut(above.join(licensed, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("n"))
                  .select("dir", F.col("n.up").alias("inherited_from"), F.col("n.given").alias("given")), "directories")
    need = rows.filter("license IS NULL").join(nearest, "dir", "left")
    own = rows.filter("license IS NOT NULL").select("doc_id", "path", "license", "score", F.lit(None).cast("string").alias("inherited_from"))
    return own.unionByName(need.select("doc_id", "path", F.col("given").alias("license"), "score", "inherited_from"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """License of every file, by its own text or its directories."""
    return inherit(headers(files, templates, least))
