"""Licence scans by canonical digests: whole normalised texts are hash-joined.

Texts that differ only in case, punctuation, white space, copyright lines or equivalent
spellings have one canonical form. The digest of a document's canonical form, and of each
of its lines', is joined with the digests of known licence texts and notices. The main
path has SQL functions only, and the order of the steps is fixed, so any SQL engine
repeats it.

Defined results: a null text counts as empty, and an empty canonical form matches
nothing; rows that share an id, or have none, are scanned each and give one result, as in the
SQL: every one of them shows the first licence by name and all notices found in any of them;
an empty table gives an empty table; other columns of a document are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, British first, on canonical words.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("honour", "honor"),
    ("favour", "favor"),
    ("programme", "program"),
    ("noninfringement", "non infringement"),
    ("https", "http"),
)
# Copyright lines go whole, behind comment signs too; letters are lower case by then. The word alone makes none:
# a sign, year, placeholder, colon or "by" has to follow, so lines of a licence's body stay, however it is wrapped.
COPYRIGHT_LINE = "(^|\n)[ \t#*;%/-]*(copyright[ \t]*(\\(c\\)|©|[0-9]{4}|[<{:]|\\[|by )|\\(c\\)[ \t]*(copyright[ \t]*)?[0-9]{4}|©)[^\n]*"
NOT_WORD = "[^a-z0-9\n]+"

# Texts and notices of public licences.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more
information, please refer to <https://unlicense.org>""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "Reserved": "All rights reserved.",
}


# Titles that may stand above a text.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}
# Digests of the canonical forms of long texts, as their owners publish them.
DIGESTS = {
    "Apache-2.0": "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def variants(known: dict[str, str] = KNOWN) -> list[tuple[str, str]]:
    """(license, text): every known text by itself, under its titles, and with rights reserved above it."""
    out = []
    for name, text in sorted(known.items()):
        for title in ("", *HEADINGS.get(name, ())):
            out.append((name, f"{title}\n{text}"))
            if name in HEADINGS:
                out.append((name, f"{title}\nAll rights reserved.\n{text}"))
    return out


def canonical(text: Column) -> Column:
    """Lower-case words in a row, one blank between, without copyright lines."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    # Only texts that have the words pay for the pattern.
    marked = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©")
    bare = F.when(marked, F.regexp_replace(lower, COPYRIGHT_LINE, "\n")).otherwise(lower)
    return F.regexp_replace(bare, NOT_WORD, " ")


def joined(lines: Column) -> Column:
    """The canonical form of a text from that of its lines."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, "[ \n]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(words)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(digest, license): one row per known text."""
    pairs = (F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in variants(known))
    rows = spark.range(1).select(F.inline(F.array(*pairs)))
    made = rows.select(F.sha2(joined(canonical(F.col("text"))), 256).alias("digest"), "license")
    if digests:
        fixed = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license")) for k, d in sorted(digests.items())))
        made = made.unionByName(spark.range(1).select(F.inline(fixed)))
    return made.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, notices) of every id: the licence whose entire text it is, and the sorted
    licences that entire lines of it are.
    """
    base = docs.select(F.col(id_col).alias("_id"), canonical(F.col(text_col)).alias("_lines"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("_lines").alias("text")))
    lines = F.transform(F.split("_lines", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    units = base.select("_id", F.explode(F.concat(whole, lines)).alias("u"))
    digests = units.select("_id", F.col("u.whole").alias("whole"), F.sha2(joined(F.col("u.text")), 256).alias("digest"))
    found = (
        digests.join(known, "digest")
        .groupBy("_id")
        .agg(
            F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
            F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ", ").alias("notices"),
        )
    )
    ids = docs.select(F.col(id_col).alias("_own"))
    return ids.join(found, F.col("_own").eqNullSafe(F.col("_id")), "left").select(
        F.col("_own").alias(id_col), "license", F.coalesce("notices", F.lit("")).alias("notices")
    )


def scan_sql(known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: the same steps."""

    def sql_text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canonical_sql(x: str) -> str:
        lower = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
        marked = f"(contains({lower}, 'copyright') OR contains({lower}, '(c)') OR contains({lower}, '©'))"
        bare = f"CASE WHEN {marked} THEN regexp_replace({lower}, {sql_text(COPYRIGHT_LINE)}, chr(10), 'g') ELSE {lower} END"
        return f"regexp_replace({bare}, '[^a-z0-9\n]+', ' ', 'g')"

    def joined_sql(x: str) -> str:
        words = f"' ' || trim(regexp_replace({x}, '[ \n]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS:
            words = f"replace({words}, ' {old} ', ' {new} ')"
        return f"trim({words})"

    rows = ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in variants(known))
    fixed = "".join(f" UNION ALL SELECT {sql_text(d)}, {sql_text(k)}" for k, d in sorted(digests.items()))
    return f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256({joined_sql("c")}) AS digest, license
    FROM (SELECT license, {canonical_sql("body")} AS c FROM (VALUES {rows}) AS t(license, body)){fixed}
  ) GROUP BY 1
), base AS (
  SELECT doc_id, {canonical_sql("text")} AS c FROM documents
), units AS (
  SELECT doc_id, TRUE AS whole, c AS u FROM base
  UNION ALL
  SELECT doc_id, FALSE AS whole, unnest(string_split(c, chr(10))) AS u FROM base
), found AS (
  SELECT doc_id, min(license) FILTER (WHERE whole) AS license,
         array_to_string(list_sort(list_distinct(coalesce(list(license) FILTER (WHERE NOT whole), []))), ', ') AS notices
  FROM (SELECT doc_id, whole, sha256({joined_sql("u")}) AS digest FROM units) JOIN known USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, f.license, coalesce(f.notices, '') AS notices
FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""
