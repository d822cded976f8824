"""Known licences by the digest of their canonical text.

Whole texts are brought into one form (case, punctuation, white space, copyright lines, equivalent
spellings) and joined by digest to the known ones; so is every line, for notices such as "Released under
the MIT License." that stand alone in a text. Nothing is searched for inside other words: a match is a whole
text or a whole line.

Defined results: null counts as the empty text, which is no licence; lines are counted once however often
they repeat; ids that repeat with different texts are told apart by their digest; texts of any length
are read whole; columns beside id and text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Public licence texts and notices, each under the identifier of its licence.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
]
# A line that begins with "copyright" or "(c)" is a copyright line only if a year or the other sign follows: clauses begin so too.
COPYRIGHT_LINE = (
    r"(?m)^[ \t]*(?:(?:copyright|\(c\)|©)[ \t:,]*[<\[]?(?:\d{4}|year|yyyy)[^\n]*|(?:copyright|©)[ \t]*(?:\(c\)|©)[^\n]*"
    r"|\(c\)[ \t]*copyright[^\n]*|all rights reserved\.?[ \t\r]*)$"
)
#: Headings that whole texts have or lack.
HEADINGS = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"]}
#: Where the terms of a text end; what follows tells how to apply them, and copies often leave it out.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
TEXTS = Path(__file__).parent / "licence_texts"  # whole public texts, each in a file named by its licence
#: Spellings that mean the same.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("https", "http"), ("merchantibility", "merchantability"),
]
NOT_A_LETTER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines and punctuation, in one spelling."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    text = F.trim(F.regexp_replace(text, NOT_A_LETTER, " "))
    for spelling, common in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(common))
    return text


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """``KNOWN`` and the files of ``TEXTS``, with their usual headings and with and without what follows the terms."""
    texts = list(KNOWN)
    for name, text in KNOWN:
        if len(text) > 200:
            texts += [(name, f"{heading}\n\n{text}") for heading in HEADINGS.get(name, [])]
    for file in sorted(TEXTS.glob("*.txt")):
        whole = file.read_text(encoding="utf-8")
        terms, end, _ = whole.partition(END_OF_TERMS)
        texts += [(file.stem, whole)] + ([(file.stem, terms), (file.stem, terms + end)] if end else [])
    return texts


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``licence, digest``, one row per digest; ``known`` is ``known_texts()`` if not given."""
    table = spark.createDataFrame(known if known is not None else known_texts(), "licence string, text string")
    return table.select("licence", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, canonical_sha256, licence`` of the whole text (or null), ``notices`` (licences of its lines, in order of name)."""
    known = known if known is not None else known_digests(docs.sparkSession)
    whole = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("canonical_sha256"))
    lines = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("whole", digest(F.col("text")))
    lines = lines.select("id", "whole", F.explode(F.split(F.col("text"), "\n")).alias("line")).filter(F.trim("line") != "")
    found = lines.select("id", "whole", digest(F.col("line")).alias("digest")).join(known, "digest").select("id", "whole", "licence").distinct()
    notices = found.groupBy("id", "whole").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    joined = whole.join(known.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("canonical_sha256") == F.col("whole"))
    return joined.join(notices, same, "left").select("doc_id", "canonical_sha256", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
