"""License scans by canonical digest, in DataFrame functions only.

A text is brought to canonical form (case, copyright lines, punctuation and equivalent spellings do not count),
and its digest is looked up among those of known license texts by a hash join. Beside the entire text, each of
its blocks (between blank lines) and each of its lines is a text of its own, so that a notice at the end of a document is found too.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, after the SPDX matching guidelines.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
)

#: Groups of words that count as equal, over line breaks too; looked for once the words above are replaced.
EQUIVALENT_GROUPS = (("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"))

#: Short public license texts and the notices that name a license.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    ),
    (
        "BSL-1.0",
        """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
)

MOST_KNOWN = 10_000  # known texts whose digests are broadcast; more are joined by shuffle
_TERMS_END = "END OF TERMS AND CONDITIONS"


def full_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the files beside this module, each named after its license. What follows the line that ends the
    terms (how to apply them) may be missing from a copy, so the terms alone count too."""
    found = []
    for file in sorted(resources.files("logloom.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(_TERMS_END)
        found += [(name, text), *([(name, terms), (name, terms + end)] if end else [])]
    return tuple(found)


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """(license, text) from the files of a folder, each named after its license: more texts for ``digests``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


# A line that names a year or holder, not one that merely begins with the word: "copyright holders be liable" is part of a text.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright[:,]?[ \t]*(?:\(c\)|©|[0-9]{4}|by\b)|\(c\)[ \t]*(?:copyright|[0-9]{4})|©|all rights reserved)[^\n]*"
_JOINERS = r"[^\p{L}\p{N}\n]+"


def _steps() -> list[tuple[str, str, str]]:
    """(kind, pattern, replacement), in order; every word comes to stand between two spaces of its own."""
    steps = [("regex", _COPYRIGHT, ""), ("text", "&", " and "), ("regex", _JOINERS, "  "), ("regex", r"[ ]*\n[ ]*", "  \n  ")]
    return steps + [("text", f" {a} ", f" {b} ") for a, b in EQUIVALENT]


_GROUPS = [(f" {a} ", f" {b} ") for a, b in EQUIVALENT_GROUPS] * 2  # twice: two groups in a row share a space


def _regrouped(flat: Column) -> Column:
    out = F.concat(F.lit(" "), flat, F.lit(" "))
    for a, b in _GROUPS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def _has_groups(flat: Column) -> Column:
    return F.concat(F.lit(" "), flat, F.lit(" ")).rlike(f" (?:{'|'.join(a for a, _ in EQUIVALENT_GROUPS)}) ")


def _respelled(text: Column, pairs) -> Column:
    """One pass finds which spellings occur; only these are replaced."""
    firsts = "".join(sorted({a[0] for a, _ in pairs}))
    any_of = F.lit(f" (?=[{firsts}])({'|'.join(a for a, _ in pairs)}) ")
    new = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    replaced = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, any_of, F.lit(1))), t, lambda out, x: F.replace(out, padded(x), padded(F.element_at(new, x))))
    # The text stands in an array of one, so that it is made once, not wherever it is named.
    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def canonical(text: Column) -> Column:
    """Lower-case words with two spaces between them, lines kept; a word at either end of a line has spaces there too."""
    # A copyright line may begin the text, so lines are matched before the spaces are added.
    out = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), _COPYRIGHT, ""), F.lit("  "))
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), _JOINERS, "  ")
    out = F.replace(out, F.lit("\n"), F.lit("  \n  "))
    return _respelled(out, EQUIVALENT)


def _flat(canon: Column) -> Column:
    return _regrouped(F.trim(F.regexp_replace(canon, r"[ \n]+", " ")))


def digests(spark: SparkSession, known: DataFrame | tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(digest, length, license): one row for each known text (license, text; by default ``KNOWN`` and ``full_texts``), in canonical
    form; the first license of equal texts. Null texts, and texts of which nothing is left, are no known texts."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame([*((*KNOWN, *full_texts()) if known is None else known)], "license string, text string")
    canon = _flat(canonical(F.col("text")))
    rows = rows.select(canon.alias("canon"), "license").where("canon <> ''")
    return rows.groupBy(F.sha2("canon", 256).alias("digest")).agg(F.min(F.char_length("canon")).alias("length"), F.min("license").alias("license"))


def match(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, text_digest, text_license (of the entire text), licenses (of blocks and lines,
    sorted, comma-joined), n_matches (blocks and lines that are a known text).

    A text that is one block or one line counts in each of these too. Null and empty texts, and texts that are all
    punctuation and copyright lines, have the digest of the empty text and match nothing. Null ids are kept. Repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.

    Of ``known`` (``digests``), at most ``MOST_KNOWN`` rows are broadcast; only texts as long as one of them are hashed beside the
    entire one, and nothing but the result's keys and matches is shuffled. More rows are joined by shuffle.
    """
    spark = docs.sparkSession
    known = digests(spark) if known is None else known
    table = known.limit(MOST_KNOWN + 1).collect()
    few, lengths = len(table) <= MOST_KNOWN, sorted({r.length for r in table})
    known = F.broadcast(spark.createDataFrame([(r.digest, r.license) for r in table], "digest string, license string")) if few else known.select("digest", "license")
    canon = docs.select(F.col(id_col).alias("doc_id"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("canon"))
    lines = canon.select("doc_id", F.transform(F.split("canon", "\n"), lambda x: F.replace(F.trim(x), F.lit("  "), F.lit(" "))).alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    # Blocks are what blank lines set apart.
    blocks = F.transform(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda x: F.replace(F.btrim(x, F.lit("\n")), F.lit("\n"), F.lit(" ")))
    found = lines.select("doc_id", whole.alias("whole"), F.concat("lines", blocks).alias("parts"))
    found = found.withColumn("grouped", _has_groups(F.col("whole")))
    fits = lambda x: F.char_length(x).isin(lengths) if few else x != ""
    parts = found.select(
        "doc_id", F.sha2(F.when(F.col("grouped"), _regrouped(F.col("whole"))).otherwise(F.col("whole")), 256).alias("text_digest"),
        F.filter(F.when(F.col("grouped"), F.transform("parts", _regrouped)).otherwise(F.col("parts")), fits).alias("parts"),
    )
    units = parts.select("doc_id", "text_digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), "parts")).alias("part"))
    units = units.withColumn("digest", F.coalesce(F.sha2("part", 256), F.col("text_digest")))
    found = units.join(known, "digest", "left")
    # A row of docs has one unit without a part; equal rows are counted here and dealt out again below.
    grouped = found.groupBy("doc_id", "text_digest").agg(
        F.count(F.when(F.col("part").isNull(), 1)).alias("rows"),
        F.max(F.when(F.col("part").isNull(), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("part").isNotNull(), F.col("license")))), ",").alias("licenses"),
        F.count(F.when(F.col("part").isNotNull(), F.col("license"))).alias("matches"),
    )
    again = grouped.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return again.select("doc_id", "text_digest", "text_license", "licenses", F.expr("matches div rows").alias("n_matches"))


def oracle_sql() -> str:
    """DuckDB SQL for the registered query: the same canonical form, without the lengths."""
    quote = lambda x: x.replace("'", "''")

    def canon(text: str) -> str:
        out = f"concat('  ', regexp_replace(lower({text}), '{quote(_COPYRIGHT)}', '', 'g'), '  ')"
        for kind, pattern, new in _steps()[1:]:
            out = f"regexp_replace({out}, '{quote(pattern)}', '{quote(new)}', 'g')" if kind == "regex" else f"replace({out}, '{quote(pattern)}', '{quote(new)}')"
        return out

    def flat(x: str) -> str:
        out = f"concat(' ', trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')), ' ')"
        for a, b in _GROUPS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim({out})"

    rows = ", ".join(f"('{quote(a)}', '{quote(b)}')" for a, b in (*KNOWN, *full_texts()))
    return f"""WITH known AS (SELECT sha256({flat(canon("t"))}) AS digest, min(license) AS license FROM (VALUES {rows}) AS v(license, t) GROUP BY 1),
      canons AS (SELECT doc_id, {canon("coalesce(text, '')")} AS c FROM documents),
      units AS (SELECT doc_id, sha256({flat("c")}) AS text_digest,
        unnest(list_concat(list_transform(string_split(c, chr(10)), lambda x: {flat("x")}), list_transform(regexp_split_to_array(c, '\\n[ ]*\\n[ \\n]*'), lambda x: {flat("x")}))) AS part FROM canons),
      hits AS (SELECT doc_id, text_digest, count(license) AS n, array_to_string(list_sort(array_agg(DISTINCT license) FILTER (license IS NOT NULL)), ',') AS licenses
        FROM units LEFT JOIN known ON digest = sha256(part) AND part <> '' GROUP BY doc_id, text_digest)
    SELECT doc_id, text_digest, license AS text_license, coalesce(licenses, '') AS licenses, n AS n_matches FROM hits LEFT JOIN known ON digest = text_digest"""
