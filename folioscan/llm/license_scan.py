"""Scan of texts for license templates by MinHash bands over overlapping windows; native columns only.

A template of n words is looked for in windows of n + n/4 words (rounded up) that start every n/4 words (1 at least). A window's distinct word shingles that
are a template's, as a share of the template's, are its containment; a match holds `percent` of them or more.

MinHash: a window that holds a template so has a similarity of at least some J to it, by the sizes of both. Bands of one minimum each, as many as make
(1 - J)**bands at most `miss`, retrieve templates by an equi-join; retrieved templates are verified on their shingles. Windows without any anchor word
are passed over first: anchors are words of which every match must hold one, as they lie in more shingles than a match may lack. Long texts are cut in segments that
overlap by a window, so only a segment's windows are held at once. Templates' keys and shingles are broadcast in two tables of checked size.

Words are runs of letters and digits, lower-cased. Null and empty texts match nothing; rows that share an id are reported together; a null id is an id
of its own. Of a template's windows in a text, the one of greatest containment counts, then the first. Empty table: no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}]+"


#: Bytes of templates' shingles and keys that one reading of the texts broadcasts, and lengths of templates that one plan holds.
PASS_BYTES, PASS_LENGTHS = 16 << 20, 16
#: Words of a text whose windows are cut at once.
SEGMENT = 8192


class LicenseTemplate(NamedTuple):
    name: str
    text: str


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def window(n: int) -> tuple[int, int]:
    """Words of a window and between window starts, for a template of n words."""
    return n + -(-n // 4), max(1, n // 4)


def band_count(n: int, shingles: int, k: int, percent: int, miss: float) -> int:
    """Bands that retrieve a matching window of a template with n words and so many distinct shingles, but for a chance of miss."""
    size = window(n)[0] - k + 1
    held = -(-percent * shingles // 100)
    j = held / (size + shingles - held)
    return max(1, math.ceil(math.log(miss) / math.log(1 - j))) if j < 1 else 1


def anchors(words: list[str], k: int, percent: int) -> set[str]:
    """Words, longest first, that lie in more distinct shingles than a match may lack."""
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    lacking = len(set(grams)) - -(-percent * len(set(grams)) // 100)
    found: set[str] = set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len({g for g in grams if found & set(g)}) > lacking:
            break
        found.add(w)
    return found


def _minima(shingles: Column, bands: int) -> Column:
    """The band keys of a set of shingles: for each seed, its least hash, mixed with the seed."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def least(seed: int) -> Column:
        return F.xxhash64(F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed)))), F.lit(seed))

    return F.array(*map(least, range(bands)))


def _shingles(words: Column, k: int) -> Column:
    """Distinct k-word shingles; none for fewer words."""
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def passes(words: dict[str, list[str]], k: int, percent: int, miss: float, most: int, most_lengths: int) -> Iterator[list[str]]:
    """Names of templates, by length, in runs whose tables hold at most about `most` bytes (or one template) and `most_lengths` lengths."""
    run: list[str] = []
    size = 0
    for name in sorted(words, key=lambda t: (len(words[t]), t)):
        shingles = {" ".join(words[name][i : i + k]) for i in range(len(words[name]) - k + 1)}
        own = sum(len(x.encode()) + 24 for x in shingles) + 64 * band_count(len(words[name]), len(shingles), k, percent, miss)
        if run and (size + own > most or len({len(words[t]) for t in [*run, name]}) > most_lengths):
            yield run
            run, size = [], 0
        run.append(name)
        size += own
    if run:
        yield run


def scan_licenses(docs: DataFrame, templates: Sequence[LicenseTemplate], k: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", most: int = PASS_BYTES, segment: int = SEGMENT) -> DataFrame:
    """(id_col, template, start_word, n_shared, n_shingles) for each template found in each text.

    templates: any number of distinct names, k words each at least. Their tables are broadcast in runs of `most` bytes and PASS_LENGTHS lengths, each with a
    reading of the texts of its own.
    """
    spark = docs.sparkSession
    words = {t.name: template_words(t.text) for t in templates}
    if len(words) != len(templates) or any(len(w) < k for w in words.values()):
        raise ValueError(f"templates need distinct names and {k} words each")
    found = None
    for names in passes(words, k, percent, miss, most, PASS_LENGTHS):
        part = _pass(docs, {t: words[t] for t in names}, k, percent, miss, id_col, text_col, segment)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{id_col} long, template string, start_word long, n_shared long, n_shingles long")
    best = found.groupBy("id", "template").agg(F.max(F.struct("n_shared", (-F.col("start")).alias("back"), "n_shingles")).alias("b"))
    return best.select(F.col("id").alias(id_col), "template", (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.n_shingles").cast("long").alias("n_shingles"))


def _pass(docs: DataFrame, words: dict[str, list[str]], k: int, percent: int, miss: float, id_col: str, text_col: str, segment: int) -> DataFrame:
    """(id, template, start, n_shared, n_shingles) of the windows that hold these templates, from one reading of the texts."""
    spark = docs.sparkSession
    # Templates of one length form a group.
    cuts, keys_of, any_key, shingles, keyed_by = [], None, set(), None, None
    for n in sorted({len(w) for w in words.values()}):
        names = sorted(t for t, w in words.items() if len(w) == n)
        size, step = window(n)
        keys = sorted(set().union(*(anchors(words[t], k, percent) for t in names)))
        any_key |= set(keys)
        counts = {t: len({tuple(words[t][i : i + k]) for i in range(n - k + 1)}) for t in names}
        bands = max(band_count(n, counts[t], k, percent, miss) for t in names)
        part = spark.createDataFrame([(n, t, words[t]) for t in names], "length int, template string, words array<string>").withColumn("shingles", _shingles(F.col("words"), k))
        held, by = part.select("template", "shingles"), part.select("length", "template", F.explode(F.array_distinct(_minima(F.col("shingles"), bands))).alias("key"))
        shingles, keyed_by = (held, by) if shingles is None else (shingles.unionByName(held), keyed_by.unionByName(by))
        keys_of = (F if keys_of is None else keys_of).when(F.col("length") == n, _minima(F.col("own"), bands))
        # A segment's windows are those that start in it.
        first, last = F.pmod(-F.col("offset"), F.lit(step)), F.least(F.lit(segment - 1), F.size("words") - k)
        starts = F.when(F.arrays_overlap("words", F.array(*map(F.lit, keys))) & (first <= last), F.sequence(first, F.greatest(first, last), F.lit(step))).otherwise(F.array().cast("array<int>"))
        cut = F.transform(starts, lambda s: F.struct(F.lit(n).alias("length"), (s + F.col("offset")).alias("start"), F.slice("words", s + 1, size).alias("part")))
        cuts.append(F.filter(cut, lambda w: F.arrays_overlap(w["part"], F.array(*map(F.lit, keys)))))
    widest = max(window(len(w))[0] for w in words.values())
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where(F.col("text").rlike("|".join(sorted(any_key))))
    held = rows.select("id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words")).where(F.size("words") >= k)
    segments = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(segment)), lambda o: F.struct(o.alias("offset"), F.slice("words", o + 1, segment + widest).alias("words")))
    parts = held.select("id", F.explode(segments).alias("s")).select("id", "s.offset", "s.words")
    windows = parts.select("id", F.explode(F.flatten(F.array(*cuts))).alias("w")).select("id", F.col("w.length").alias("length"), F.col("w.start").alias("start"), _shingles(F.col("w.part"), k).alias("own"))
    keyed = windows.select("id", "length", "start", "own", F.explode(F.array_distinct(keys_of)).alias("key"))
    hits = keyed.join(F.broadcast(keyed_by), ["length", "key"]).join(F.broadcast(shingles), "template")
    return hits.select("id", "template", "start", F.size(F.array_intersect("own", "shingles")).alias("n_shared"), F.size("shingles").alias("n_shingles")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)


#: Short license notices, as public licenses word them (fixed values).
NOTICES = [
    LicenseTemplate("MIT", "Released under the MIT License."),
    LicenseTemplate("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    LicenseTemplate("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    LicenseTemplate("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    LicenseTemplate("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    LicenseTemplate("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    LicenseTemplate("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    LicenseTemplate("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
