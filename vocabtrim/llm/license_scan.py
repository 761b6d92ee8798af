"""License scan by canonical digest lookup.

A text (the whole document, and each of its lines as a notice of its own) is brought
into canonical form: lower case, copyright lines dropped, punctuation and hyphens
removed, white space squeezed, equivalent spellings replaced.  The SHA-256 of the
whole canonical text is looked up by an equi-join on the digests of known texts, so
the cost does not grow with the number of licences and nothing is compared in pairs.

Edge cases: null, empty and wordless texts match nothing; repeated rows come back
repeated; two known texts with equal canonical form both match; extra columns are
ignored; an empty known table gives an empty result.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

# Equivalent spellings, word for word.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog", "centre": "center",
    "defence": "defense", "favour": "favor", "fulfil": "fulfill", "honour": "honor", "initialise": "initialize",
    "judgement": "judgment", "labour": "labor", "merchantibility": "merchantability", "modelled": "modeled",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "practise": "practice",
    "programme": "program", "recognise": "recognize", "unauthorised": "unauthorized", "utilisation": "utilization",
    "whilst": "while", "https": "http", "owner": "holder", "owners": "holders",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD2, _BSD3 = _BSD + _BSD_AS_IS, _BSD + _BSD_NAME + _BSD_AS_IS
_REGENTS = (_BSD + _BSD_NAME + _BSD_AS_IS).replace("the copyright holder nor", "the University nor") \
    .replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")


def _bullets(text: str) -> str:
    return re.sub(r"(?m)^\d\. ", "* ", text)


# Known short licence texts and the usual one-line notices.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    *((k, t + x) for k, title, x in (("BSD-2-Clause", "BSD 2-Clause License\n", _BSD2),
                                     ("BSD-3-Clause", "BSD 3-Clause License\n", _BSD3),
                                     ("BSD-3-Clause", "", _REGENTS))
      for x in (x, _bullets(x)) for t in dict.fromkeys(("", title))),
)


def whole_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the long licences in ``licenses/``: as given and with one line a
    paragraph, each with and without what follows the end of the terms (how to apply them)."""
    out = {}
    for file in sorted((resources.files(__package__) / "licenses").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text = file.read_text(encoding="utf-8")
            end = re.search(r"END OF TERMS AND CONDITIONS", text)
            for t in (text, text[:end.end()] if end else text, text[:end.start()] if end else text):
                for x in (t, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t)):
                    out[file.name.removesuffix(".txt"), x] = None
    return list(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in ``(license_id, text)`` table; any table of that shape can take its place."""
    return spark.createDataFrame([*KNOWN, *whole_texts()], "license_id string, text string")


def plain(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation and repeated white space."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))),
                         r"(?md)^[ \t*#/]*(?:copyright |copyright$|\(c\)|©|all rights reserved).*$", "")
    t = F.translate(t, "-‐‑", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def spelled(words: Column) -> Column:
    """Equivalent spellings of a plain text's words."""
    table = F.create_map(*[F.lit(x) for kv in EQUIVALENT.items() for x in kv])
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, license_id, unit, n_found)``: licences found as the whole text
    (``unit`` document) or as a line (``unit`` line, with the number of such lines)."""
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else need(known, "license_id", "text")
    known = (known.select("license_id", plain(F.col("text")).alias("plain")).filter("plain <> ''")
                  .select("license_id", F.size(F.split("plain", " ")).alias("n_words"),
                          F.sha2(spelled(F.col("plain")), 256).alias("digest")).distinct())
    lengths = [r["n_words"] for r in known.select("n_words").distinct().limit(10_001).collect()]
    units = need(docs, "doc_id", "text").select("doc_id", F.explode(F.concat(
        F.array(F.struct(F.lit("document").alias("unit"), F.col("text").alias("part"))),
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n"),
                    lambda x: F.struct(F.lit("line").alias("unit"), x.alias("part"))))).alias("u"))
    units = units.select("doc_id", "u.unit", plain(F.col("u.part")).alias("plain"))
    n_words = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    if len(lengths) <= 10_000:  # equal digests have equal word counts: most units need no digest
        units = units.filter(n_words.isin(lengths))
    found = (units.filter("plain <> ''")
                  .select("doc_id", "unit", F.sha2(spelled(F.col("plain")), 256).alias("digest"))
                  .join(known.select("license_id", "digest").distinct(), "digest"))
    return found.groupBy("doc_id", "license_id", "unit").agg(F.count(F.lit(1)).alias("n_found"))
