"""Licence scans: TF-IDF cosine of notices and licence files to templates, then inheritance down directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

# Notices by licence (fixed values: the publicly known wording).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
)
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
UNIT = re.compile(r"\n+|(?<=[.!?])\s+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


# Comment marks that are words; the others aren't tokens.
MARKS = frozenset(("dnl", "rem"))
VOCABULARY = frozenset(t for _, x in TEMPLATES for t in tokens(x))


def units(text: str) -> Iterator[tuple[int, int]]:
    """Lines and sentences of a text, as spans."""
    at = 0
    for m in UNIT.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


class Matcher:
    def __init__(self, documents: int, df: dict[str, int], threshold: float = 0.75):
        self.threshold = threshold
        self.idf = {t: math.log((1 + documents) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = max(self.idf.values(), default=1.0)
        self.templates = [(name, self.vector(Counter(tokens(x)))) for name, x in TEMPLATES]
        # No cosine of a unit is over the root of its words' sum of these, whichever template it is held against.
        self.most = {t: max(v.get(t, 0.0) ** 2 for _, v in self.templates) for t in VOCABULARY}

        self.sizes = [len(tokens(x)) for _, x in TEMPLATES]
        self.ids = {t: i for i, t in enumerate(sorted(VOCABULARY))}
        self.squares = np.zeros((len(TEMPLATES), len(self.ids) + 1))
        for k, (_, v) in enumerate(self.templates):
            for t, x in v.items():
                self.squares[k, self.ids[t]] = x * x

    def vector(self, count: Counter) -> dict[str, float]:
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str) -> tuple[str | None, float, int, int]:
        """(licence, cosine, start, end) of the unit or window nearest to any template; units first, the earliest of equals."""
        out: tuple = (None, 0.0, -1, -1)
        for s, e in units(text):
            words = tokens(text[s:e])
            known = VOCABULARY.intersection(words)
            if not known or sum(self.most[t] for t in known) <= out[1] ** 2:
                continue
            count = Counter(words)
            v = self.vector(count)
            for name, template in self.templates:
                cosine = sum(x * template[t] for t, x in v.items() if t in template)
                if cosine > out[1] + 1e-12:
                    out = (name, cosine, s, e)
        return self.windows(text, out)

    def windows(self, text: str, out: tuple) -> tuple:
        """out, or what is nearer to a template than it: a stretch of as many words as the template has, over line ends
        and comment marks. A window is passed over only if the bound of its cosine isn't over the best so far, or doesn't
        reach the threshold."""
        low = text.replace("\u0130", "i").lower()
        words = [t for t in TOKEN.findall(low) if t not in MARKS]
        unknown = len(self.ids)
        ids = np.fromiter((self.ids.get(t, unknown) for t in words), np.intp, len(words))
        present = np.zeros(unknown + 1)
        present[ids] = 1
        spans = None
        first = len(text)
        least = lambda: max(out[1], self.threshold) ** 2 - 1e-9
        for k in np.flatnonzero(self.squares @ present > least()):
            (name, template), size = self.templates[k], min(self.sizes[k], len(words))
            total = np.concatenate(([0.0], np.cumsum(self.squares[k][ids])))
            bound = total[size:] - total[:-size]
            at = np.flatnonzero(bound > least())
            for i in at[np.argsort(-bound[at], kind="stable")]:
                if bound[i] < least():
                    break
                v = self.vector(Counter(words[i : i + size]))
                cosine = sum(x * template[t] for t, x in v.items() if t in template)
                if cosine > out[1] + 1e-12 or (first < len(text) and cosine > out[1] - 1e-12 and spans[i][0] < first):
                    spans = spans or [m.span() for m in TOKEN.finditer(low) if m[0] not in MARKS]
                    first = spans[i][0]
                    out = (name, cosine, first, spans[i + size - 1][1])
        return out


def corpus_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and in how many of them each word of the templates stands."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            count: Counter = Counter()
            for t in batch.column(0):
                count.update(VOCABULARY.intersection(TOKEN.findall((t.as_py() or "").lower())))
            count[""] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["t", "n"])

    found = {r["t"]: r["n"] for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


SCHEMA = "doc_id long, path string, is_file boolean, license string, cosine double, start int, end int"


def scan_licenses(files: DataFrame, threshold: float = 0.75) -> DataFrame:
    """files: doc_id, path, text, is_license_file. Returns doc_id, path, own_license, cosine, start, end, license,
    inherited_from.

    A file's own licence is the template nearest to any of its lines, sentences or windows of a template's length, if
    their TF-IDF cosine reaches threshold (cosine is that of the nearest line or sentence where none does); document frequencies come from all files. A directory has the licence of its licence file with the
    highest cosine (then the first path). A file without one of its own takes that of its nearest directory upwards;
    inherited_from names the directory ('' is the root), null for an own licence or none. A null path is the root's;
    null texts have no licence of their own; equal rows give equal results; empty input gives no rows; very long texts are
    read to their end; other columns are dropped. Of a directory's licence files with one cosine the first path counts."""
    base = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.coalesce(F.col("is_license_file"), F.lit(False)).alias("is_file"), F.col("text").cast("string").alias("text"))
    documents, df = corpus_counts(base)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(documents, df, threshold)
        for batch in batches:
            found = [matcher.best(t.as_py() or "") for t in batch.column(3)]
            found = [f if f[1] >= threshold else (None, round(f[1], 6), -1, -1) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.string()), pa.array([round(f[1], 6) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    own = materialize(base.mapInArrow(run, SCHEMA).withColumn("dir", F.regexp_replace("path", "(^|/)[^/]*$", "")), "lic-own")
    licensed = own.where("is_file and license is not null").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("path"), F.col("license"))).alias("dir_license")).withColumnRenamed("dir", "up")
    # Every directory with each one above it; directories are few beside files, and deep ones cost a row a level.
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))
    dirs = own.select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = dirs.join(licensed, "up").groupBy("dir").agg(F.max_by(F.struct("up", "dir_license"), "depth").alias("x")).select("dir", "x.up", "x.dir_license")
    out = own.join(materialize(nearest, "lic-dirs"), "dir", "left")
    return out.select("doc_id", "path", F.col("license").alias("own_license"), "cosine", "start", "end", F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNull(), F.col("up")).alias("inherited_from"))


def as_files(documents: DataFrame) -> DataFrame:
    """documents as a tree of files: short texts (under 600 characters) lie in their source's directory and count as its
    licence files if they name one; longer texts lie one level down, by language."""
    short = F.coalesce(F.length("text"), F.lit(0)) < 600
    return documents.select("doc_id", F.concat_ws("/", "source", F.when(~short, F.col("lang")), F.col("doc_id").cast("string")).alias("path"), "text", short.alias("is_license_file"))
