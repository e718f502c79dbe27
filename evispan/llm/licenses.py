"""License scan by canonical digest lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Public licence texts and the short notices in use for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: (licence, text): whole licences first, then notices of one line.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("0BSD", _ZERO_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Digests of the canonical form of longer public licence texts, as widely distributed with systems.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
#: Spellings held equal, (spelling, what stands for it), as lower-case words.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"),
    ("noninfringement", "non infringement"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
]
#: A line that is a copyright notice: the sign, or the word followed by a sign, a year or a holder. Words of a licence's body that a wrapped line may
#: begin with ("copyright notice", "copyright holder", "copyright" by itself) are none.
HOLDER_LINE = r"(^|\n)[ \t#*/;-]*(\(c\)|©|copyright(ed)?[ \t:,]*(\(c\)|©|\d)|copyright[ \t]*:|copyright[ \t]+(holder|owner)s?[ \t]*:|copyright[ \t]+(?!(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|disclaimers?|interests?|protection|status|and|or|in|is|to|on|as|for)\b)\S)[^\n]*"
#: The wider pattern of the registered SQL, which has no look-ahead; the two differ only on lines that begin with the word and name no holder.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"


def canonical(text: Column) -> Column:
    """Canonical form: lower case, no copyright lines, runs of other than letters and digits as one space, spellings made equal.

    The last line break stays until copyright lines are gone, so such a line never takes its neighbour along.
    Native string functions only. Null stays null; a text without letters or digits becomes empty.
    """
    out = F.regexp_replace(F.lower(text), HOLDER_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    out = F.regexp_replace(out, " +", "  ")  # each word has its own two spaces, so neighbours are both replaced
    for pair in SPELLINGS:
        out = F.replace(out, *(F.lit(f" {x.replace(' ', '  ')} ") for x in pair))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where that is empty, as nothing is left to identify."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Table (digest, licence), one row a digest, of texts and of digests. Its size is that of the given lists, so it may be broadcast."""
    df = spark.createDataFrame(known, "licence string, body string").select(digest(F.col("body")).alias("digest"), "licence").where("digest is not null")
    return _one_each(df.unionAll(spark.createDataFrame([(d, name) for name, d in digests], "digest string, licence string")))


def _one_each(known: DataFrame) -> DataFrame:
    """One row a digest: of several licences under it, the first by name."""
    return known.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Look up the digest of each whole text, and of each whole line of it, among known licence digests.

    One row per input row: ``doc_id``, ``digest`` (of the canonical whole text; null if that is empty),
    ``licence`` (of the whole text; null if unknown), ``n_notices`` (lines that are a known licence or
    notice by themselves), ``notices`` (their licences, sorted, no repeats). A null text has a null digest
    and no notices; repeated rows each give a row; an empty table gives none; columns other than the two
    named are not looked at. Of several licences under one digest the first by name counts. ``known`` (digest, licence) is broadcast: its size is that of a licence list
    and doesn't grow with the documents. No shuffle: both lookups are broadcast hash joins, the lines'
    as a lookup in a constant map, so rows are neither multiplied nor regrouped and no key can be hot.
    """
    spark = df.sparkSession
    known = known_digests(spark) if known is None else _one_each(known)
    found = sorted((r["digest"], r["licence"]) for r in known.collect())  # the licence list, not the documents
    table = F.create_map(*[F.lit(x) for pair in found for x in pair]) if found else F.create_map(F.lit(""), F.lit(None).cast("string"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(table, F.coalesce(digest(x), F.lit("")))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), hits.alias("hits"))
    return rows.join(F.broadcast(known.select("digest", "licence")), "digest", "left").select("doc_id", "digest", "licence", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))
