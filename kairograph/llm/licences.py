"""Licence scans by canonical digests (operator 4), in DataFrame functions only.

A text's canonical form is its lower-case form without copyright lines, with
equivalent spellings made one, and without anything but letters and digits. Its
SHA-256 digest is hash-joined with the digests of known licence texts, which get
their canonical form from the same expression. Whole texts are compared, never
parts. The known texts are a small fixed table; a caller's larger one is joined
as the optimizer sees fit, on digests only.

Defined cases: a null text is an empty text; an empty canonical form matches no
licence (licence null); several known names with equal canonical forms give the
least name; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: A line that starts with a copyright mark, or only reserves rights (after lower-casing).
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: Equivalent spellings in licence texts, in the order in which they are replaced.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("calibre", "caliber"),
    ("cancell", "cancel"),
    ("capitalis", "capitaliz"),
    ("catalogue", "catalog"),
    ("categoris", "categoriz"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasis", "emphasiz"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labell", "label"),
    ("licence", "license"),
    ("maximis", "maximiz"),
    ("modell", "model"),
    ("non-commercial", "noncommercial"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realis", "realiz"),
    ("recognis", "recogniz"),
    ("sub-license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https://", "http://"),
)
NOT_WORDS = r"[^\p{L}\p{N}]+"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

#: Public licence texts and customary notices, by SPDX identifier where there is one.
KNOWN = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n\nCopyright (c) holders\n\n" + _MIT_GRANT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + "." + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    # Longer texts are files named by their identifier.
    *((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null gives the empty form."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.regexp_replace(out, NOT_WORDS, "")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``(canonical_sha256, license_id)``, one row per digest."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, canonical_sha256, license_id)``; the licence is null where no known text is equal."""
    form = canonical(F.col(text_col))
    digests = docs.select(F.col(id_col), F.sha2(form, 256).alias("canonical_sha256"))
    some = known.where(F.col("canonical_sha256") != F.sha2(F.lit(""), 256))
    return digests.join(some, "canonical_sha256", "left").select(id_col, "canonical_sha256", "license_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{one}')"
    return f"regexp_replace({out}, '{NOT_WORDS}', '', 'g')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP4_SQL = f"""
WITH known AS (
  SELECT sha256({_sql_form('text')}) AS canonical_sha256, min(license_id) AS license_id
  FROM (VALUES {', '.join(f'({_literal(a)}, {_literal(b)})' for a, b in KNOWN)}) AS v(license_id, text) GROUP BY 1
), digests AS (
  SELECT doc_id, sha256({_sql_form('text')}) AS canonical_sha256 FROM documents
)
SELECT d.doc_id, d.canonical_sha256, k.license_id FROM digests d LEFT JOIN known k ON k.canonical_sha256 = d.canonical_sha256 AND d.canonical_sha256 <> sha256('')
"""
