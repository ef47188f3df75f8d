"""License scans with DataFrame functions only.

Units of text are compared with licence templates by the cosine of their TF-IDF vectors, whose inverse frequencies come
from the templates (a term in no template weighs most).

Notices: the units are spans of a text's words, across its lines, so that neither the words around a notice nor line ends and
comment marks count. A template is compared with every span that begins and ends with one of its terms (trimming others
only raises the cosine), has its words of ``NAMES`` and at most 1 / least^2 times its words. Spans are built around anchors only: if a template's
other terms carry less than least^2 of its squared length, a span without an anchor stays below least (Cauchy and Schwarz).
SPDX tags are read as they stand.

Licence files: the units are whole texts, compared with the same templates and, with logarithmic term counts and inverse
frequencies of their own, with full licence texts (folder license_texts). Texts that hold a word of ``GATE`` or an anchor that is not in ``EVERYDAY``, and files named like a licence file, are compared. A
file whose text reaches ``file_least`` is a licence file and speaks for its directory (several: best score, then smallest path).

A file's own licence is that of the full text it is, else its SPDX tag, else its best notice (a grant before
"all rights reserved", then the best score, then the first). Files without their own inherit from the nearest ancestor
directory that has one: the distinct directories are joined with it by their ancestors' paths, then the files by theirs.

Very long texts are split into words as a whole. Null text has no licence, a null path no directory; rows that repeat path and text have one result each; without files
there are no rows. Other columns pass through and this operator's replace columns of the same names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.rows import tag_of
from stratapoint.runtime import Scratch

#: Licence notices in their usual words (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Under the terms of the MIT License."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License."),
    ("GPL-3.0", "Under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "Under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License."),
    ("LGPL-3.0", "Under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-2.1", "Under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License."),
    ("AGPL-3.0", "Under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright, all rights reserved."),
    ("Proprietary", "All rights reserved."),
)
TEXTS = Path(__file__).parent / "license_texts"
#: Words one of which is in every template and licence text.
GATE = ("license", "licensed", "licence", "licenced", "copyright", "redistribution", "permission", "released", "reserved", "terms")
#: Names that are everyday words of some language: alone they make no text a candidate for a licence file.
EVERYDAY = frozenset(["mit"])
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|copyright|notice)[^/]*$"
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?\)*"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_ID})*)"
#: Template terms that any text may have.
COMMON = frozenset("this is the a of to and or in by all are use form forms with without under work v 0 1 2 3 4 any as be can copy either except file files found free may not person you".split())
#: Terms that tell a licence from the others in the same words: a notice has all of these that its template has.
NAMES = frozenset("affero apache associated bsd cc gnu granted lesser mit mozilla nc redistribution reserved sa".split())
ADDED = ("own_license", "own_score", "license", "inherited_from")


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


class Vectors:
    """The templates' TF-IDF vectors."""

    def __init__(self, templates=TEMPLATES, log: bool = False):
        self.log = log
        self.licenses = [name for name, _ in templates]
        counts = [Counter(terms(text)) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(df.items())}
        self.unknown = math.log(1 + len(counts)) + 1
        self.weights = [{t: (1 + math.log(n) if log else n) * self.idf[t] for t, n in c.items()} for c in counts]
        self.norms = [math.sqrt(sum(w * w for w in v.values())) for v in self.weights]

    def names(self) -> list[list[str]]:
        """Of each template, the terms that its notices must have."""
        return [sorted(NAMES & v.keys()) for v in self.weights]

    def anchors(self, least: float) -> list[list[str]]:
        """Of each template, terms one of which is in every text whose cosine with it can reach least."""
        out = []
        for v, norm in zip(self.weights, self.norms, strict=True):
            rest, found = sum(w * w for w in v.values()), []
            for t in sorted(v, key=lambda t: (t in COMMON or t.isdigit(), -v[t], t)):  # rare words first
                if rest < (least * norm) ** 2 * (1 - 1e-9):
                    break
                found.append(t)
                rest -= v[t] ** 2
            out.append(found)
        return out

    def notice_anchors(self, least: float) -> list[list[str]]:
        """Of each template, terms one of which is in every notice: one of its names, if it has any."""
        return [own[:1] or found for own, found in zip(self.names(), self.anchors(least), strict=True)]

    def cues(self, least: float) -> str:
        """A pattern for lower-cased text that is in every text whose cosine can reach least."""
        return _any({t for found in self.anchors(least) for t in found})


def _any(words) -> str:
    return r"(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(words)) + r")(?![a-z0-9])"


def full_texts() -> tuple[tuple[str, str], ...]:
    return tuple((f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt")))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _texts(items) -> str:
    return "array(" + ", ".join(f"'{t}'" for t in items) + ")"


def _map(weights: dict[str, float]) -> str:
    return f"map_from_arrays({_texts(weights)}, array({', '.join(f'{w!r}D' for w in weights.values())}))"


def _notices(texts: DataFrame, key: list[str], templates, v: Vectors, least: float) -> DataFrame:
    """key, score, start, template: the spans that reach least."""
    span = [int(sum(Counter(terms(t)).values()) / least**2) + 1 for _, t in templates]
    names, anchors = v.names(), v.notice_anchors(least)
    rows = ", ".join(f"({i}, {n}, {_texts(a)}, cast({_texts(own)} as array<string>), {_map(w)}, {norm!r}D)" for i, (n, a, own, w, norm) in enumerate(zip(span, anchors, names, v.weights, v.norms, strict=True)))
    model = texts.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS m(template, most, anchors, names, w, norm)")
    by = model.select("*", F.explode("anchors").alias("anchor"))
    far = max(span)
    every = _texts(sorted({t for found in anchors for t in found}))
    words = texts.select(*key, _words("text").alias("words"))
    at = words.select(*key, "words", F.explode(F.expr(f"filter(sequence(0, greatest(size(words) - 1, 0)), i -> array_contains({every}, get(words, i)))")).alias("at"))
    around = at.select(*key, "at", F.expr("words[at]").alias("anchor"), F.expr(f"slice(words, greatest(at - {far}, 0) + 1, least(at, {far}) + {far})").alias("near"), F.expr(f"least(at, {far})").alias("c"))
    found = around.join(F.broadcast(by), "anchor")
    # Each span belongs to its first anchor.
    found = found.withColumn("places", F.expr("filter(sequence(greatest(c - most, 0), least(c + most, size(near) - 1)), k -> w[near[k]] is not null)"))
    found = found.withColumn("prev", F.expr("coalesce(array_max(filter(places, k -> k < c and array_contains(anchors, near[k]))), -1)"))
    found = found.withColumn("a", F.explode(F.expr("filter(places, k -> k <= c and k > prev)")))
    found = found.withColumn("b", F.explode(F.expr("filter(places, k -> k >= c and k - a < most)")))
    found = found.withColumn("unit", F.expr("slice(near, a + 1, b - a + 1)"))
    found = found.where("forall(names, t -> array_contains(unit, t))")
    # The terms' weights against the template bound the score from above: only spans that can reach least are counted term by term.
    found = found.where(f"aggregate(array_distinct(unit), 0D, (s, t) -> s + power(coalesce(w[t], 0D), 2)) >= power({least!r}D * norm, 2) * (1 - 1e-9)")
    tf = f"(cast(size(filter(unit, u -> u = t)) as double) * coalesce({_map(v.idf)}[t], {v.unknown!r}D))"
    sums = F.expr(f"aggregate(transform(array_distinct(unit), t -> struct({tf} as own, coalesce(w[t], 0D) as w)), struct(0D as n, 0D as d), (s, x) -> struct(s.n + x.own * x.own as n, s.d + x.own * x.w as d))")
    scored = found.withColumn("s", sums).select(*key, F.round(F.col("s.d") / (F.sqrt("s.n") * F.col("norm")), 6).alias("score"), F.expr("at - c + a").alias("start"), "template")
    return scored.where(F.col("score") >= least)


def _scores(units: DataFrame, key: list[str], text: str, v: Vectors) -> DataFrame:
    """key, best: struct(score, order, license) of each unit."""
    words = units.select(*key, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("term")).where("term <> ''").groupBy(*key, "term").agg(F.count("*").alias("tf"))
    rows = ", ".join(f"('{t}', {idf!r}D, array({', '.join(f'{w.get(t, 0.0)!r}D' for w in v.weights)}))" for t, idf in v.idf.items())
    model = units.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS m(term, idf, w)")
    own = (F.log("tf") + 1 if v.log else F.col("tf")) * F.coalesce("idf", F.lit(v.unknown))
    sums = [F.sum(own * F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(v.norms))]
    got = words.join(F.broadcast(model), "term", "left").groupBy(*key).agg(F.sum(own * own).alias("n"), *sums)
    score = lambda i, norm: F.round(F.col(f"d{i}") / (F.sqrt("n") * norm), 6)
    best = F.array_max(F.array(*[F.struct(score(i, norm).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("license")) for i, (norm, name) in enumerate(zip(v.norms, v.licenses, strict=True))]))
    return got.select(*key, best.alias("best"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _spdx_name(tag: Column) -> Column:
    """The tag as it stands, without -only and -or-later, which the templates' names do not have either."""
    plain = F.regexp_replace(F.regexp_replace(tag, r"(?i)-(?:only|or-later)(?![A-Za-z0-9.+-])", ""), r"\+(?![A-Za-z0-9.+-])", "")
    known = {name.lower(): name for name, _ in (*TEMPLATES, *full_texts())}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(plain)), plain)


def license_scan(files: DataFrame, templates=TEMPLATES, least: float = 0.8, file_least: float = 0.6) -> DataFrame:
    """files(path, text, ...) with own_license, own_score, license and inherited_from."""
    scratch, v = Scratch(files.sparkSession), Vectors(templates)
    own = {x.lower() for x in ADDED}
    names = [c for c in files.columns if c.lower() not in own]
    # The caller's columns stay in one struct, so that none of them meets a name of this function.
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    base = rows.select("__row", F.col("__row.path").alias("path"), F.col("__row.text").alias("text")).withColumn("__text", tag_of(F.col("text")))
    key = ["path", "__text"]
    license_of = lambda i: F.element_at(F.array(*[F.lit(name) for name, _ in templates]), i + 1)
    anchors = {t for found in v.notice_anchors(least) for t in found}
    lower, named = F.lower("text"), F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    stating = base.select(*key, "text").where(lower.rlike(_any(anchors)))
    tagged = base.select(*key, "text").where(F.col("text").rlike(SPDX))
    candidates = base.select(*key, "text").where(lower.rlike(_any((anchors - EVERYDAY) | set(GATE))) | named)
    candidates = scratch.table(candidates.where("text is not null").dropDuplicates(key), "candidates")
    full_at = scratch.table(_scores(candidates, key, "text", Vectors(full_texts(), log=True)).where(F.col("best.score") >= file_least), "full")
    short_at = _scores(candidates, key, "text", v).where(F.col("best.score") >= file_least)
    files_at = full_at.unionByName(short_at)
    grant = ~F.col("license").eqNullSafe("Proprietary")
    spans = _notices(stating, key, templates, v, least).withColumn("license", license_of(F.col("template")))
    rank = lambda kind, score, at, order, name: F.struct(kind.alias("kind"), score.alias("score"), at.alias("first"), order.alias("order"), name.alias("license")).alias("own")
    spans = spans.select(*key, rank(grant.cast("int"), F.col("score"), -F.col("start"), -F.col("template"), F.col("license")))
    ids = F.regexp_extract("text", SPDX, 1)
    tags = tagged.select(*key, rank(F.lit(2), F.lit(1.0), F.lit(0), F.lit(0), _spdx_name(ids)))
    full = full_at.select(*key, rank(F.lit(3), F.col("best.score"), F.lit(0), F.col("best.order"), F.col("best.license")))
    notices = spans.unionByName(tags).unionByName(full).groupBy(*key).agg(F.max("own").alias("own"))
    notices = scratch.table(notices.select(*key, F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score")), "notices")
    speaking = files_at.where("path is not null").groupBy(_directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("best.score")).alias("s"), "path", F.col("best.license").alias("license"))).alias("file"))
    speaking = scratch.table(speaking.select("dir", "file.license"), "speaking")
    dirs = scratch.table(base.where("path is not null").select(_directory(F.col("path")).alias("dir")).distinct(), "dirs")
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("ancestor", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/")).where("depth = 0 or ancestor <> '' ")
    near = up.distinct().join(speaking.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "license")).alias("near"))
    near = scratch.table(near.select(F.col("dir").alias("__dir"), F.col("near.license").alias("__license"), F.col("near.ancestor").alias("__from")), "near")
    notices = notices.withColumnsRenamed({"path": "__path", "__text": "__hash"})
    out = base.join(notices, F.col("path").eqNullSafe(F.col("__path")) & (F.col("__text") == F.col("__hash")), "left").join(near, _directory(F.col("path")) == F.col("__dir"), "left")
    inherited = F.col("own_license").isNull()
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in names], "own_license", "own_score", F.coalesce("own_license", "__license").alias("license"), F.when(inherited, F.col("__from")).alias("inherited_from"))
