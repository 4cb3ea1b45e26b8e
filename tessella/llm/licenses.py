"""Licence scan by canonical digests: normalise a whole text, hash it, join known digests.

Canonical form: lower case, copyright lines dropped, punctuation and white space folded to
single blanks, equivalent spellings made one. Units are the whole document, each of its lines
(a notice is an entire text of one line), its paragraphs and its comment blocks, so that the
header of a source file is found in it. Known are notices and short licences, kept as text,
and whole long licences, kept as digests of their canonical form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# The notices and short licences that are known, as their stewards publish them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"),
)
#: Lines that a text may carry above its body: KNOWN holds bodies, and with these as first line too.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "0BSD": "BSD Zero Clause License"}
#: From so many canonical characters on a text of KNOWN counts as a licence, which may have a title.
BODY = 300
# Id, first two words, length and SHA-256 of the canonical form of whole licences, as
# they are commonly distributed.
DIGESTS = (
    ("Apache-2.0", "apache license", 9860, "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d"),
    ("Artistic-1.0-Perl", "the artistic", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "creative commons", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "gnu free", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "gnu general", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "gnu general", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "gnu general", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "gnu library", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu lesser", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu lesser", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public", 22319, "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "mozilla public", 14283, "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
)
# Pattern and replacement of spellings held equal, applied to words and blanks.
EQUIVALENT = (
    (r"\b(sub ?)?licence(s|d|e|es)?\b", "\\1license\\2"),
    (r"\bsub license", "sublicense"),
    (r"\b(author|organ|recogn|merchandi)is(e|ed|ation)\b", "\\1iz\\2"),
    (r"\bfavour", "favor"),
    (r"\b(v|ver) ([0-9])", "version \\2"),
    (r"\bv([0-9])", "version \\1"),
    (r"\bhttps\b", "http"),
)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4})|©|\(c\)|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for pattern, to in EQUIVALENT:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, and its licences with their titles."""
    return [*KNOWN, *((i, f"{TITLES[i]} {t}") for i, t in KNOWN if i in TITLES and len(t) >= BODY)]


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, n_chars, digest): as many rows as the tables above have, so it may be broadcast."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known_texts()])
    rows = spark.range(1).select(F.explode(rows).alias("r")).select("r.license_id", canonical(F.col("r.text")).alias("c"))
    rows = rows.select("license_id", F.length("c").alias("n_chars"), F.sha2("c", 256).alias("digest"))
    long = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(n).alias("n_chars"), F.lit(d).alias("digest")) for i, _, n, d in DIGESTS])
    return rows.unionByName(spark.range(1).select(F.inline(long))).distinct()


def first_words() -> str:
    """Pattern of the two words that a known canonical form starts with, in their equal spellings.

    A text without a line that starts so can have no known form; the test reads the head of
    each line, the full normalisation then runs on what is left."""
    starts = {tuple(re.findall(r"\w+", t.lower())[:2]) for _, t in known_texts()} | {tuple(w.split()) for _, w, _, _ in DIGESTS}
    heads = sorted("[^\\p{L}\\p{N}]+".join(w.replace("licens", "licen[cs]") for w in pair) for pair in starts)
    return r"(?m)^[^\p{L}\p{N}\n]*+(?iu:" + "|".join(heads) + r")(?![\p{L}\p{N}])"


#: Lines without a letter or digit part paragraphs; runs of lines with a comment mark are blocks.
PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
COMMENTS = r"(?:^[ \t]*(?:#|//|/\*|\*|--|;|%)[^\n]*(?:\n|\z))+"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, n_lines, n_blocks, whole_text): the known texts each document holds.

    n_lines counts lines that are a known text, n_blocks paragraphs and comment blocks of
    several lines, whole_text says that the document as a whole is one. Null and empty texts
    match nothing; a long text is scanned whole; rows with equal doc_id are summed; an empty
    table gives no rows; columns other than doc_id and text are ignored."""
    known = known_digests(docs.sparkSession)
    most = max(max(len(t) for _, t in known_texts()), *(n for _, _, n, _ in DIGESTS)) + 200
    heads = first_words()
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(heads))

    text, none = F.col("text"), F.array().cast("array<struct<kind:string,unit:string>>")
    several, with_break = F.instr(text, "\n") > 0, text.rlike(PARAGRAPHS)

    def units(kind: str, found):
        return F.transform(found, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))

    paragraphs = F.filter(F.split(text, PARAGRAPHS), lambda u: F.instr(u, "\n") > 0)
    # A comment block of one paragraph is found as such; only others are made here.
    comments = F.filter(F.regexp_extract_all(text, F.lit("(?dm)" + COMMENTS), F.lit(0)), lambda u: F.trim(u, F.lit("\n")).rlike(PARAGRAPHS))
    whole = F.when(several, units("whole", F.array(text))).otherwise(none)
    blocks = F.when(with_break, F.concat(units("block", paragraphs), units("block", comments))).otherwise(none)
    every = F.concat(units("line", F.split(text, "\n")), whole, blocks)
    unit = texts.select("doc_id", F.inline(F.filter(every, lambda u: u["unit"].rlike(heads))))
    form = unit.select("doc_id", "kind", canonical(F.col("unit")).alias("c")).where(F.col("c") != "")
    form = form.withColumn("n_chars", F.length("c")).where(F.col("n_chars") <= most).withColumn("digest", F.sha2("c", 256))
    hits = form.join(F.broadcast(known), ["n_chars", "digest"])

    def count(kind: str):
        return F.sum((F.col("kind") == kind).cast("long"))

    return hits.groupBy("doc_id", "license_id").agg(count("line").alias("n_lines"), count("block").alias("n_blocks"), (count("whole") > 0).alias("whole_text"))


def oracle() -> str:
    def form(c: str) -> str:
        out = f"regexp_replace(lower({c}), '{COPYRIGHT_LINE}', ' ', 'g')"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for pattern, to in EQUIVALENT:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
    digests = ", ".join(f"('{i}', '{d}')" for i, _, _, d in DIGESTS)
    comments = COMMENTS.replace("'", "''")
    return f"""
WITH k AS (SELECT DISTINCT license_id, sha256({form('t')}) AS digest FROM (VALUES {values}) v(license_id, t) UNION SELECT * FROM (VALUES {digests}) w(license_id, digest)),
s AS (SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, 'line' AS kind FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, text, 'whole' FROM s
      UNION ALL SELECT * FROM (SELECT doc_id, unnest(string_split_regex(text, '{PARAGRAPHS}')) AS unit, 'block' AS kind FROM s WHERE regexp_matches(text, '{PARAGRAPHS}')) WHERE contains(unit, chr(10))
      UNION ALL SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m){comments}')) AS unit, 'block' AS kind FROM s WHERE regexp_matches(text, '{PARAGRAPHS}')) WHERE regexp_matches(trim(unit, chr(10)), '{PARAGRAPHS}')),
f AS (SELECT doc_id, kind, {form('unit')} AS c FROM u)
SELECT doc_id, license_id, CAST(count(*) FILTER (WHERE kind = 'line') AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE kind = 'block') AS BIGINT) AS n_blocks, count(*) FILTER (WHERE kind = 'whole') > 0 AS whole_text
FROM f JOIN k ON k.digest = sha256(f.c) WHERE c <> '' GROUP BY 1, 2
"""
