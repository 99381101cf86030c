"""License scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines, spellings), and the
digest of the entire form is joined with the digests of known licences. Lines of a document are
looked up the same way, which finds licence notices. Only DataFrame functions are used.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording of public licences and of their usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted"""
ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ISC = f"""{ISC_GRANT}, provided that the above copyright notice and this permission notice appear
in all copies.

{ISC_TAIL}"""
ZERO_BSD = f"{ISC_GRANT}.\n\n{ISC_TAIL}"
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Long licences lie beside this module, a file for each, headings included.
FILES = (
    ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"),
    ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"),
    ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"),
)
LONG = tuple(
    (key, (Path(__file__).parent / "licences" / f"{name}.txt").read_text(encoding="utf-8"))
    for key, name in FILES
)
#: Long licences end here; how to apply them comes behind, and many copies go without it.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
SHORT_LONG = tuple(
    (key, text[: text.index(END_OF_TERMS) + tail])
    for key, text in LONG
    if END_OF_TERMS in text
    for tail in (0, len(END_OF_TERMS))
)
GNU_NAMES = {"GPL": "General", "LGPL": "Lesser General", "GFDL": "Free Documentation"}
GNU_NOTICES = tuple(
    (key, f"This work is licensed under the GNU {GNU_NAMES[family]}{' Public' * (family != 'GFDL')} License, version {v}.")
    for key, _ in FILES
    for family, _, version in [key.partition("-")]
    if family in GNU_NAMES and key not in ("GPL-3.0", "LGPL-2.0")
    for v in sorted({version, version.removesuffix(".0")})
)
SPDX_NOTICES = tuple(
    (key, f"SPDX-License-Identifier: {key}{suffix}")
    for key in (*[key for key, _ in FILES], "ISC", "0BSD", "BSD-2-Clause", "Zlib", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
    for suffix in (("", "-only", "-or-later") if key.partition("-")[0] in GNU_NAMES else ("",))
    if key + suffix not in ("Apache-2.0", "GPL-3.0")  # listed below
)
LICENSES = (
    ("MIT", MIT),
    ("MIT", f"MIT License\n\n{MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{MIT}"),
    ("ISC", ISC),
    ("ISC", f"ISC License\n\n{ISC}"),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", f"{BSD_GRANT}\n\n{BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_GRANT}\n\n{BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_GRANT}\n\n{BSD_NAMES}\n\n{BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_GRANT}\n\n{BSD_NAMES}\n\n{BSD_TAIL}"),
    ("Zlib", ZLIB),
    ("Zlib", f"zlib License\n\n{ZLIB}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    *LONG,
    *SHORT_LONG,
    *GNU_NOTICES,
    *SPDX_NOTICES,
)
#: Spellings that mean the same, replaced in this order; part of words, too.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("http www", "https www"),
)
#: Words after "copyright" that make it part of the wording, which may be wrapped before it.
WORDING = (
    r"(?:notice|holder|owner|law|license|licence|interest|statement|treat(?:y|ie)|act|permission"
    r"|disclaimer|protection|doctrine|status|information|ownership|right)s?"
    r"|and|or|in|on|of|for|to|is|are|as|that|which|under|above|applies|resulting"
)
#: What opens a line that states a copyright: a sign, a year, a placeholder or a name behind the word.
STATEMENT = (
    r"[ \t*#/;-]*(?:copyright:?[ \t]*(?:\(c\)|©|[0-9\[<{])"
    rf"|copyright:?[ \t]+(?!(?:{WORDING})\b)[^\W_]"
    r"|\(c\)[ \t]*(?:copyright|[0-9\[<{])|©|all rights reserved)[^\n]*"
)
#: Two readings of a text: without all such lines, and without those that open a block only, since a
#: line of wrapped wording may begin like a statement.
COPYRIGHT_LINE = rf"(^|\n){STATEMENT}"
BLANK_LINES = r"\n(?:[ \t*#/;-]*\n)+"
OPENING_LINES = rf"(?:\A\n*|\n\n)(?:{STATEMENT}\n?)+"
#: Runs of these become one space: ASCII but for letters, digits and the line feed, and the
#: typographic signs that licence texts are set with.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}‐-―‘-‟•]+"


def lowered(text: Column) -> Column:
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds, without lines that state a copyright; null is empty."""
    return F.regexp_replace(F.regexp_replace(lowered(text), COPYRIGHT_LINE, "\n"), PUNCTUATION, " ")


def canonical_blocks(text: Column) -> Column:
    """The same, but statements go only where they open a block."""
    blocks = F.regexp_replace(lowered(text), BLANK_LINES, "\n\n\n")
    return F.regexp_replace(F.regexp_replace(blocks, OPENING_LINES, "\n\n"), PUNCTUATION, " ")


def one_line(text: Column) -> Column:
    """Canonical text without line feeds: single spaces, one spelling."""
    out = F.trim(F.regexp_replace(text, "[ \n]+", " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.sha2(F.encode(one_line(text), "UTF-8"), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """digest, license_id: a row for each known text."""
    texts = spark.createDataFrame(list(known), "license_id string, known string")
    readings = F.array(*[digest(f(F.col("known"))) for f in (canonical_lines, canonical_blocks)])
    return (
        texts.select(F.explode(readings).alias("digest"), "license_id")
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )


def scan_licenses(
    documents: DataFrame, known: tuple[tuple[str, str], ...] = LICENSES
) -> DataFrame:
    """Look up every entire text, and every line of it, among the known licences.

    Returns doc_id, digest (of the canonical text), license_id (null if the text is none), n_notices
    (lines that are a known notice) and notice_ids (their distinct ids, sorted, with commas; empty
    if none). A text is a licence if either reading of it has the digest of either reading of the
    known one.

    Args:
        documents: doc_id, text; other columns are ignored.
        known: pairs of licence id and wording. They are broadcast, so their number should stay
            in the thousands.

    A null text counts as empty, and an empty canonical form matches nothing. Each repeated row has
    a row of its own. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    notices = [(key, text) for key, text in known if "\n" not in text]
    ids = F.map_from_arrays(  # constants, so it is computed once
        F.array(*[digest(canonical_lines(F.lit(text))) for _, text in notices]),
        F.array(*[F.lit(key) for key, _ in notices]),
    )
    # A line twice as long as any notice is none, as spellings shorten no text by half.
    longest = max((len(text) for _, text in notices), default=0) * 2
    short = F.filter(F.split("lines", "\n"), lambda x: F.length(F.trim(x)) <= longest)
    found = F.filter(
        F.transform(short, lambda x: F.try_element_at(ids, digest(x))), lambda x: x.isNotNull()
    )
    digests = known_digests(spark, known)
    by_blocks = digests.select(F.col("digest").alias("opened"), F.col("license_id").alias("other"))
    return (
        documents.select(
            "doc_id",
            canonical_lines(F.col("text")).alias("lines"),
            digest(canonical_blocks(F.col("text"))).alias("opened"),
        )
        .select("doc_id", digest(F.col("lines")).alias("digest"), "opened", found.alias("found"))
        .join(F.broadcast(digests), "digest", "left")
        .join(F.broadcast(by_blocks), "opened", "left")
        .select(
            "doc_id",
            "digest",
            F.coalesce("license_id", "other").alias("license_id"),
            F.size("found").cast("long").alias("n_notices"),
            F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_ids"),
        )
    )
