"""License scans: sparse TF-IDF cosine of license notices to templates, and inheritance from the nearest ancestor directory.

The notices of a text are its lines, its sentences and its stretches of template words that hold a cue, each alone and
the lines together. Their terms and those of the templates are weighted by tf * idf, idf over the lines of each text and
the templates; the best template of at least THRESHOLD is the text's license. A whole text is compared with full license
texts in the same way, from FULL_THRESHOLD on. A text that is little more than a notice, or that is a full license text,
is a license file: its license holds for its directory. Files without a license take that of the nearest ancestor
directory that has one. Only DataFrame expressions are used."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

THRESHOLD = 0.5
#: Long texts of one language share their common words; license texts of one license share nearly all terms.
FULL_THRESHOLD = 0.85
#: Words beside the notice up to which a text is a license file.
FILE_WORDS = 80
CUE = r"(?i)licen[sc]e|copyright|spdx-|permission is hereby|warrant(y|ies)|redistribut"
#: Phrases by which well-known licenses name themselves. A license has several templates; the best counts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The software is provided as is, without warranty of any kind."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License. Distributed on an as is basis, without warranties or conditions of any kind."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License. Distributed in the hope that it will be useful, but without any warranty."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution license."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


#: Full license texts: one file each, named by the license.
FULL: list[tuple[str, str]] = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
_VOCABULARY = sorted({w for _, t in TEMPLATES for w in re.split("[^0-9a-z]+", t.lower()) if w})
#: A term that is neither in a template nor a cue; two in a row end a stretch.
_FOREIGN = rf"(?<![0-9a-z])((?!(?:{'|'.join(_VOCABULARY)})(?![0-9a-z]))(?![0-9a-z]*(?:licen[sc]e|copyright|spdx|warrant|redistribut))[0-9a-z]+)"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^0-9a-z]+"), lambda x: x != "")


def _plain(text: Column) -> Column:
    return F.array_join(_terms(text), " ")


def _cued(files: DataFrame) -> DataFrame:
    """path, text, text_key of the files whose text (null: empty) has a cue."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return files.where(text.rlike(CUE)).select("path", text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))


def notices(files: DataFrame) -> DataFrame:
    """path, text_key, notice (its terms), words (beside the notice), lines: the different notices of each file with a cue.

    lines is 1 for the lines together, which alone count for idf, and 0 for other notices."""
    held = lambda parts: F.filter(parts, lambda x: x.rlike(CUE))
    lines, sentences = held(F.split("text", "\n")), held(F.split("text", r"\n|(?<=[.!?])\s+"))
    marked = F.regexp_replace("plain", _FOREIGN, "~$1")
    stretches = held(F.transform(F.split(marked, "~[0-9a-z]+ ~[0-9a-z]+"), lambda x: F.regexp_replace(x, r"^ ?~[0-9a-z]+|~[0-9a-z]+ ?$", "")))
    parts = F.concat(F.array(F.array_join(lines, "\n")), lines, sentences, stretches)
    cued = _cued(files).withColumn("plain", _plain(F.col("text")))
    each = cued.select("path", "text_key", F.size(_terms(F.col("text"))).alias("size"), F.posexplode(F.array_distinct(F.transform(parts, _plain))).alias("at", "notice"))
    return each.where("notice != ''").select("path", "text_key", "notice", (F.col("size") - F.size(F.split("notice", " "))).alias("words"), (F.col("at") == 0).cast("int").alias("lines"))


def full_texts(files: DataFrame) -> DataFrame:
    """As notices, with each whole text as the notice."""
    return _cued(files).select("path", "text_key", _plain(F.col("text")).alias("notice"), F.lit(0).alias("words"), F.lit(1).alias("lines")).where("notice != ''")


def licenses(found: DataFrame, known: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, text_key, license, score, words: the best template of each notice, where the cosine is threshold or more."""
    spark = found.sparkSession
    templates = spark.createDataFrame([(k, *t) for k, t in enumerate(known)], "template int, license string, text string")
    found = found.withColumn("notice_key", F.md5(F.col("notice").cast("binary")))
    texts = cut(found.groupBy("notice_key").agg(F.first("notice").alias("notice"), F.sum("lines").alias("n")))  # equal notices are scored once
    terms = cut(texts.select("notice_key", "n", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("notice_key", "n", "term").agg(F.count("*").alias("tf")))
    of = templates.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.sum("n").alias("df")).union(of.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    total = (texts.agg(F.sum("n")).first()[0] or 0) + len(known)
    idf = cut(df.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    weigh = lambda t: t.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    texts_w, templates_w = cut(weigh(terms)), cut(weigh(of))
    norm = texts_w.groupBy("notice_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    norms = F.broadcast(templates_w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm")))
    small = F.broadcast(templates_w.select("template", "license", "term", F.col("w").alias("v")))  # TEMPLATES is fixed and small
    dot = texts_w.join(small, "term").groupBy("notice_key", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dot.join(norms, "template").join(norm, "notice_key").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6))
    best = scored.groupBy("notice_key").agg(F.max_by(F.struct("license", "score"), F.struct("score", -F.col("template"))).alias("best"))
    best = cut(best.select("notice_key", "best.*").where(F.col("score") >= threshold))
    return found.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS // 10 else best, "notice_key").select("path", "text_key", "license", "score", "words")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(files: DataFrame) -> DataFrame:
    """path, license, score, via of every row of files (path, text); via: own, directory of the license, or null.

    Rows that repeat a path share the better license. A null path has no license; a path without "/" has no ancestor.
    Ties between license files of a directory go to the higher score, then to the lesser path."""
    named = files.where("path is not null")
    scored = licenses(notices(named)).union(licenses(full_texts(named), FULL, FULL_THRESHOLD))
    best = F.max_by(F.struct("license", "score", "words"), F.struct("score", "license", -F.col("words"))).alias("best")
    own = cut(scored.groupBy("path", "text_key").agg(best).select("path", "best.*"))
    mine = own.groupBy("path").agg(F.max_by(F.struct("license", "score"), F.struct("score", "license")).alias("own"))
    kept = own.where((F.col("words") <= FILE_WORDS) & F.col("path").contains("/")).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    held = cut(kept.groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("path"))).alias("up")))
    paths = files.select("path")
    known = cut(paths.join(mine, "path", "left"))
    need = known.where("own is null and path is not null").select("path").distinct()
    above = need.select("path", F.posexplode(F.when(F.col("path").contains("/"), ancestors(F.col("path"))).otherwise(F.array())).alias("depth", "dir"))
    above = above.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS // 10 else held, "dir")
    nearest = above.groupBy("path").agg(F.max_by(F.struct("up", "dir"), "depth").alias("above"))
    out = known.join(nearest, "path", "left")
    return out.select("path", F.coalesce("own.license", "above.up.license").alias("license"), F.coalesce("own.score", "above.up.score").alias("score"), F.when(F.col("own").isNotNull(), "own").otherwise(F.col("above.dir")).alias("via"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Files of the documents: one in 50 lies in its source's directory, one in 10 in that of its language, the others below."""
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    deep = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(F.col("doc_id") % 50 == 0, F.concat_ws("/", source, name)).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", source, lang, name)).otherwise(F.concat_ws("/", source, lang, deep, name))
    return docs.select(F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
