"""Licence scan: canonical text digests joined with the digests of known licences."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.llm.session import digest, free_name

# Usual notices and short licence texts, with their SPDX identifiers.
_MIT = """MIT License

Copyright (c) 2000 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
)
#: Usual first lines of texts that are also given without one.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license"),
    "Unlicense": ("The Unlicense",),
}
_ITEM = re.compile(r"^[ \t]*(?:[1-9][.)]|[*-])[ \t]+", re.M)


def _texts() -> list[tuple[str, str]]:
    """Whole licences of ``license_texts`` (one file each, named by SPDX identifier) in their usual forms."""
    bodies = [("MIT", _MIT.split("\n", 1)[1]), ("ISC", _ISC)]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        bodies.append((path.stem.removesuffix("-regents"), path.read_text()))
    out = []
    for name, body in bodies:
        forms = [body]
        if name in ("BSD-2-Clause", "BSD-3-Clause", "Zlib"):  # points with and without their numbers
            numbers = iter(range(1, 10))
            forms = [_ITEM.sub("", body), _ITEM.sub(lambda _: f"{next(numbers)}. ", body)]
        if name == "Apache-2.0":  # with and without the appendix
            forms.append(body.split("APPENDIX:")[0])
        out += [(name, f"{title}\n\n{form}") for form in forms for title in ("", *_TITLES.get(name, ()))]
        out.append((name, f"SPDX-License-Identifier: {name}"))
    return out


KNOWN = tuple(dict.fromkeys((*_NOTICES, *_texts())))
SPELLINGS = (
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
)
#: ASCII but letters, digits and line ends; Latin-1, general and ideographic punctuation.
NOT_WORD = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{80}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+"
#: The rule of the SQL check, on canonical lines: it knows no names and drops every line that begins with a year.
COPYRIGHT_LINE = r"^(copyright )?(c )?(by )?[12][0-9][0-9][0-9]( |$)|^copyright c |^all rights reserved$"
_SIGN, _YEAR = r"(?i:\(c\)|©)", r"[12][0-9]{3}(?![\p{L}0-9])"
#: "Copyright" before these words is running text, mostly of a licence.
_PROSE = "holders?|owners?|notices?|laws?|licen[cs]\\w*|and|or|in|on|of|to|for|is|infring\\w*|protect\\w*|statements?|interests?|disclaimers?|treat\\w+|acts?|status"
#: "(c)" before these words is a point of a list.
_POINT = "you|if|the|a|an|any|all|each|in|to|for|or|and|by|no|this|that|such|when|where|under|is|must|use|as|it|its"
#: A line, as written, that only says who holds the copyright: the word or a sign, then a year or a name.
OWNER_LINE = (
    rf"^[^\p{{L}}0-9(©]*(?:(?i:copyright)[ \t:,-]*(?:{_SIGN}|(?i:by )?{_YEAR}|[<\[{{]|(?i:by )?(?!(?i:{_PROSE})\b)\p{{Lu}})"
    rf"|{_SIGN}[ \t:,-]*(?:(?i:copyright\b)|(?i:by )?{_YEAR}|(?!(?i:{_POINT})\b)\p{{Lu}}))"
)
#: A line that names a year and, if it directly follows such a line, belongs to it.
YEAR_LINE = rf"^[^\p{{L}}0-9]*{_YEAR}"
RIGHTS_LINE = r"^[^\p{L}0-9]*(?i:all rights reserved)[^\p{L}0-9]*$"


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` loops over it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def canonical_lines(text: Column) -> Column:
    """Lines in lower case without punctuation, with one spelling; no empty or copyright lines."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit("c")), NOT_WORD, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    lines = F.transform(F.split(out, "\n"), lambda line: F.trim(line))
    written = F.filter(F.arrays_zip(lines.alias("line"), F.split(text, "\n").alias("raw")), lambda x: x["line"] != "")

    def kind(row: Column) -> Column:
        raw = row["raw"]
        return F.when(raw.rlike(OWNER_LINE), "c").when(raw.rlike(YEAR_LINE), "y").when(raw.rlike(RIGHTS_LINE), "r").otherwise("t")

    def clean(rows: Column) -> Column:
        # One letter a line; year lines behind an owner line (\\G: where the last match ended) are marked with it.
        kinds = F.concat(F.lit("t"), F.array_join(F.transform(rows, kind), ""))
        marks = F.split(F.regexp_replace(kinds, r"c|r|(?<=[cy])\Gy", "-"), "")

        def stay(m: Column) -> Column:
            marked = F.transform(rows, lambda x, i: F.struct(x["line"].alias("line"), F.get(m, i + 1).alias("mark")))
            return F.filter(marked, lambda x: x["mark"] != "-")["line"]

        return _let(marks, stay)

    return _let(written, clean)


def text_digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(known_digest, license): texts that agree in canonical form give the smallest name."""
    digests = known.where("license IS NOT NULL AND text IS NOT NULL").select(
        text_digest(canonical_lines(F.col("text"))).alias("known_digest"), "license"
    )
    return digests.groupBy("known_digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``license`` and ``notices``.

    ``license`` names the known licence that the entire text is (null if none); ``notices``
    lists, in order and joined by commas, the licences that single lines of the text are
    (empty if none). Copyright lines do not count: "copyright" or a (c) sign with a year or a
    name, year lines directly behind one, and "all rights reserved". Null and empty texts, and texts of copyright lines only, match nothing.
    Rows that agree in id and text get the same result; repeated known texts count once.
    Columns of ``docs`` with these two names are replaced.

    Each text is made canonical once; its digest and those of its lines meet the digests of
    ``known`` in one equi-join, which Spark broadcasts only if ``known`` is measured small.
    """
    digests = known_digests(known)
    units = docs.select(
        F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("digest"), canonical_lines(F.col(f"`{text_col}`").cast("string")).alias("lines")
    ).where(F.size("lines") > 0)
    whole = F.array(F.struct(F.lit(True).alias("entire"), text_digest(F.col("lines")).alias("unit")))
    single = F.transform(F.array_distinct("lines"), lambda line: F.struct(F.lit(False).alias("entire"), F.sha2(line, 256).alias("unit")))
    units = units.select("id", "digest", F.explode(F.concat(whole, single)).alias("u")).select("id", "digest", "u.entire", "u.unit")
    hits = units.join(digests, units.unit == digests.known_digest).groupBy("id", "digest").agg(
        F.max(F.when(F.col("entire"), F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("license")))), ",").alias("notices"),
    )
    kept = [c for c in docs.columns if c.lower() not in {"license", "notices"}]
    mark = free_name(docs, "text_digest")
    rows = docs.withColumn(mark, digest(text_col)).select(*[F.col(f"`{c}`") for c in kept], F.col(mark)).alias("d")
    joined = rows.join(hits.alias("h"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("h.id")) & (F.col(f"d.{mark}") == F.col("h.digest")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in kept], F.col("h.license").alias("license"), F.coalesce("h.notices", F.lit("")).alias("notices"))
