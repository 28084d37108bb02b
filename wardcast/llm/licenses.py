"""License scan by sparse TF-IDF, with inheritance along paths.

Runs of consecutive lines with licensing words are blocks.  Blocks and
templates become sparse TF-IDF vectors (term weights from the counts of all
blocks), and a block takes the template with the highest cosine, if it is at
least ``LEAST_COSINE``.  Equal blocks are scored once: the vectors are joined
term by term on distinct block texts and the templates, whose number is fixed.

A file whose whole text has a high cosine with a full licence text, or that
is (almost) all scored notices, is the licence file of its directory.  A file without a licence of its own inherits from the nearest
ancestor directory that has one: directories, not files, are joined to their
ancestors, and the files to their directory.  An SPDX tag names the licence
by itself.  A file whose notice says that it is licensed, but matches no
template, is ``unknown`` (null license) and inherits nothing.

Defined results: null or empty text has no block; a null path has no
ancestors; between templates or licences of equal standing the first in
alphabetical order is taken; repeated rows each get a row; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage

LEAST_COSINE = 0.55
FILE_SHARE = (8, 10)   # a licence file: licence words are at least 8/10 of its words,
LEAST_FILE_COSINE = 0.9  # or the whole document has this cosine with a full licence text
FILE_WORDS = 50        # words of a document that can be a full licence text
#: how a text is titled that is nearly another's: it has no text here, and is not that other licence
OTHER_TITLES = {"GPL-3.0": r"(?i)\bgnu[\x20\t]+affero[\x20\t]+general[\x20\t]+public[\x20\t]+license\b",
                "CC-BY-SA-4.0": r"(?i)\battribution(?!-sharealike[\x20\t])[a-z-]*[\x20\t]+4\.0[\x20\t]+international\b"}
TITLE_CHARS = 1000     # a title stands in the first characters of a text
FULL_TEXTS = Path(__file__).parent / "license_texts"

#: lines that can belong to a licence notice
CUES = (r"(?i)\b(licen[sc]e[ds]?|licensing|copyright|warrant(y|ies)|redistribut\w*|sublicense|spdx|"
        r"public domain|free software|permission is hereby|gnu|apache|mozilla|creative commons|as is)\b")
#: a line that names the licence by its SPDX identifier, and the identifier or expression
SPDX = r"(?i)\bSPDX-License-Identifier:[\x20\t]*([a-z0-9.+():-]+(?:[\x20\t]+(?:and|or|with)[\x20\t]+[a-z0-9.+():-]+)*)"
#: cue lines that say there is a licence, whether or not a template tells which
EXPLICIT = (r"(?i)(spdx-license-identifier|\b(licen[sc]ed|released|distributed|published|available|provided)\s+under\b|"
            r"\b(covered|governed)\s+by\b|\blicen[sc]e\s*:|\b(subject to|terms of)\b.*\blicen[sc]e\b|"
            r"\bcreative commons\b|\bpermission is hereby\b|\bpublic domain\b)")
TERM_BREAK = r"[^a-z0-9.+-]+|[.+-]+(?=[^a-z0-9]|$)"

#: the Creative Commons licences; each notice exists with and without a version
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
                    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
                    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _creative_commons():
    for short, long in CREATIVE_COMMONS.items():
        for version in ("", " 4.0", " 3.0", " 2.5", " 2.0", " 1.0"):
            scope = {" 4.0": " International", "": ""}.get(version, " Unported")
            name = f"CC-{short}{version.replace(' ', '-')}"
            yield name, f"Licensed under CC {short}{version}."
            yield name, f"Licensed under CC-{short}{version.replace(' ', '-')}."
            yield name, f"This work is licensed under a Creative Commons {long}{version}{scope} License."


#: (licence, notice or opening of the licence file)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and "
                   "distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License, version 2, as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; you can redistribute it under the terms of the GNU Lesser General "
                 "Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met. Neither the name of the copyright holder nor "
                     "the names of its contributors may be used to endorse or promote products."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal. The person who associated a work with this deed has dedicated "
                "the work to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *_creative_commons(),
)


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TERM_BREAK, -1), "")


def blocks(files: DataFrame) -> DataFrame:
    """(doc, n_words, first_line, block) of every run of cue lines."""
    cue = F.col("text").rlike(CUES)
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
                     lambda y: y["line"].rlike(CUES))
    rows = (files.filter(cue).select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc"),
                                     F.size(_terms(F.col("text"))).alias("n_words"), F.explode(lines).alias("l"))
            .select("doc", "n_words", "l.i", "l.line").distinct())
    w = Window.partitionBy("doc").orderBy("i")
    runs = rows.select("*", (F.col("i") - F.row_number().over(w)).alias("run"))
    return runs.groupBy("doc", "n_words", "run").agg(
        F.min("i").alias("first_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
        .alias("block")).select("doc", "n_words", "first_line", "block")


def full_texts() -> list[tuple[str, str]]:
    """(licence, whole text) of ``license_texts``, read on the driver."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(FULL_TEXTS.glob("*.txt"))]


def _idf(tf: DataFrame, tt: DataFrame, total: DataFrame) -> DataFrame:
    """(term, idf) of all terms of the counted texts and of the templates."""
    df = tf.groupBy("term").agg(F.sum("copies").alias("df"))
    vocabulary = tt.select("term").distinct().join(df, "term", "left").unionByName(
        df.join(F.broadcast(tt.select("term").distinct()), "term", "left_anti"))
    return stage(vocabulary.crossJoin(F.broadcast(total)).select(  # total is one row
        "term", (F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "license-idf")


def _best(bv: DataFrame, bn: DataFrame, tt: DataFrame, idf: DataFrame, least: float) -> DataFrame:
    """(b, license, score): the template with the highest cosine, if ``least``."""
    tv = tt.join(idf, "term").select("t", "license", "term", (F.col("tf") * F.col("idf")).alias("w"))
    tn = tv.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"))
    tv = F.broadcast(tv.join(tn, "t").select("t", "license", "term", (F.col("w") / F.col("tn")).alias("tw")))
    cosine = (bv.join(tv, "term").groupBy("b", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
              .join(bn, "b").select("b", "license", F.round(F.col("dot") / F.col("bn"), 6).alias("score")))
    return (cosine.groupBy("b").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
            .filter(-F.col("m.s") >= least).select("b", "m.license", (-F.col("m.s")).alias("score")))


def _template_terms(spark: SparkSession, templates) -> DataFrame:
    rows = spark.createDataFrame([(i, lic, t) for i, (lic, t) in enumerate(templates)], "t int, license string, text string")
    return (rows.select("t", "license", F.explode(_terms(F.col("text"))).alias("term"))
            .groupBy("t", "license", "term").agg(F.count("*").alias("tf")))


def score_blocks(found: DataFrame) -> DataFrame:
    """(block, license, score): the best template of each distinct block text."""
    texts = stage(found.groupBy("block").agg(F.count("*").alias("copies"))
                  .select(F.monotonically_increasing_id().alias("b"), "block", "copies"), "license-texts")
    tf = (texts.select("b", "copies", F.explode(_terms(F.col("block"))).alias("term"))
          .groupBy("b", "copies", "term").agg(F.count("*").alias("tf")))
    tt = _template_terms(found.sparkSession, TEMPLATES)
    idf = _idf(tf, tt, texts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total")))
    bv = tf.join(idf, "term").select("b", "term", (F.col("tf") * F.col("idf")).alias("w"))
    bn = bv.groupBy("b").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("bn"))
    return stage(texts.join(_best(bv, bn, tt, idf, LEAST_COSINE), "b").select("block", "license", "score"), "license-scores")


def score_files(files: DataFrame) -> DataFrame:
    """(doc, license, score): the full licence text that a whole document
    with a cue repeats; license is null where the document's title names
    another licence, whose text is not here.  A document whose weight on terms of the licence texts
    cannot reach the least cosine is left out before templates are compared."""
    docs = files.filter(F.col("text").rlike(CUES)).select(
        F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("b"), _terms(F.col("text")).alias("terms"))
    tf = stage(docs.filter(F.size("terms") >= FILE_WORDS).distinct().select("b", F.explode("terms").alias("term"))
               .groupBy("b", "term").agg(F.count("*").alias("tf")), "license-file-terms")
    tt = stage(_template_terms(files.sparkSession, full_texts()), "license-full-texts")
    idf = _idf(tf.withColumn("copies", F.lit(1)), tt, tf.agg(F.countDistinct("b").alias("total")))
    known = F.broadcast(tt.select("term", F.lit(True).alias("known")).distinct())
    bv = stage(tf.join(idf, "term").join(known, "term", "left").select(
        "b", "term", (F.col("tf") * F.col("idf")).alias("w"), F.coalesce("known", F.lit(False)).alias("known")), "license-file-weights")
    square = F.col("w") * F.col("w")
    bn = stage(bv.groupBy("b").agg(F.sqrt(F.sum(square)).alias("bn"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("kn"))
               .filter(F.col("kn") >= (LEAST_FILE_COSINE - 1e-5) * F.col("bn")).select("b", "bn"), "license-file-norms")
    near = bv.filter("known").join(broadcast_if_small(bn.select("b")), "b", "left_semi").select("b", "term", "w")
    best = _best(near, bn, tt, idf, LEAST_FILE_COSINE)
    head = F.substring("text", 1, TITLE_CHARS)
    titled = F.array_compact(F.array(*[F.when(head.rlike(p), F.lit(lic)) for lic, p in OTHER_TITLES.items()]))
    other = files.filter(F.col("text").rlike(CUES)).select(
        F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("b"), titled.alias("not")).filter(F.size("not") > 0).distinct()
    named = F.when(~F.coalesce(F.array_contains("not", F.col("license")), F.lit(False)), F.col("license"))
    return stage(best.join(other, "b", "left").select(F.col("b").alias("doc"), named.alias("license"), "score"), "license-files")


def own_licenses(files: DataFrame) -> DataFrame:
    """(doc, license, score, n_notices, is_file) of files with a notice."""
    found = stage(blocks(files), "license-blocks")
    tag = F.regexp_extract("block", SPDX, 1)
    named = F.col("tag") != ""
    scored = found.join(broadcast_if_small(score_blocks(found), 20_000), "block", "left").withColumn("tag", tag).select(
        "doc", "n_words", F.when(named, F.col("tag")).otherwise(F.col("license")).alias("license"),
        F.when(named, F.lit(1.0)).otherwise(F.col("score")).alias("score"),
        F.size(_terms(F.col("block"))).alias("size"), F.col("block").rlike(EXPLICIT).alias("explicit"))
    share, whole = FILE_SHARE
    known = F.col("license").isNotNull()
    whole_text = broadcast_if_small(score_files(files).select(
        "doc", F.struct((-F.col("score")).alias("s"), "license").alias("f")))
    notices = scored.groupBy("doc", "n_words").agg(
        F.min(F.when(known, F.struct((-F.col("score")).alias("s"), "license"))).alias("m"),
        F.count("license").alias("n_notices"), F.sum(F.when(known, F.col("size"))).alias("size"),
        F.max("explicit").alias("explicit"))
    best = notices.join(whole_text, "doc", "left").withColumn("m", F.coalesce("f", "m"))
    return best.filter("m is not null or explicit").select(
        "doc", "m.license", F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("score"), "n_notices",
        (F.col("f.license").isNotNull() | F.coalesce(whole * F.col("size") >= share * F.col("n_words"), F.lit(False)) & F.col("f").isNull()).alias("is_file"),
        F.col("m.license").isNull().alias("unknown"))


def directory(path: Column) -> Column:
    """The path up to its last slash ('' at the root)."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, down to the root ''."""
    parts = F.split(folder, "/", -1)
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
        F.array(F.lit(""))))


def inherited(files: DataFrame) -> DataFrame:
    """(dir, from_dir, license) of every directory that has a licence file or
    lies below one; ``files`` has path, license, is_file."""
    folders = files.filter(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir"), "license", "is_file")
    licensed = (folders.filter("is_file").groupBy("dir", "license").agg(F.count("*").alias("n"))
                .groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("m"))
                .select(F.col("dir").alias("from_dir"), "m.license"))
    above = folders.select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors(F.col("dir")))).alias("from_dir"))
    return (above.join(licensed, "from_dir").groupBy("dir")
            .agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "license")).alias("m"))
            .select("dir", "m.from_dir", "m.license"))


def scan(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` (doc_id, path, text): doc_id, path,
    license, origin (notice, file, inherited, unknown or none), from_dir,
    score, n_notices."""
    files = files.select("doc_id", "path", "text")
    own = stage(own_licenses(files), "license-own")
    suspect = F.coalesce(F.col("text").rlike(CUES), F.lit(False))
    bare = files.filter(~suspect).select(
        "doc_id", "path", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"),
        F.lit(0).cast("long").alias("n_notices"), F.lit(False).alias("is_file"), F.lit(False).alias("unknown"))
    noticed = files.filter(suspect).select(
        "path", F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc")).join(own, "doc", "left").select(
        "doc.doc_id", "path", "license", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("is_file", F.lit(False)).alias("is_file"),
        F.coalesce("unknown", F.lit(False)).alias("unknown"))
    rows = stage(bare.unionByName(noticed), "license-rows")
    above = stage(inherited(rows), "license-dirs").select(
        F.col("dir").alias("own_dir"), "from_dir", F.col("license").alias("from_license"))
    joined = rows.join(broadcast_if_small(above), directory(F.col("path")) == F.col("own_dir"), "left")
    took = F.col("license").isNull() & ~F.col("unknown") & F.col("from_license").isNotNull()
    return joined.select(
        "doc_id", "path", F.when(took, F.col("from_license")).otherwise(F.col("license")).alias("license"),
        F.when(took, F.lit("inherited")).when(F.col("unknown"), F.lit("unknown")).when(F.col("license").isNull(), F.lit("none"))
        .when(F.col("is_file"), F.lit("file")).otherwise(F.lit("notice")).alias("origin"),
        F.when(took, F.col("from_dir")).alias("from_dir"), "score", "n_notices")
