"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright and "all rights
reserved" lines dropped, equivalent spellings replaced by one, and everything
but letters and digits turned into single spaces. Two texts with one canonical
form differ in nothing that matters to a licence. The SHA-256 of the form is
joined with the digests of the known licences, so whole texts match whole
licences and nothing else does.

The known licences are a table of (license_id, text): the short texts and notices
here, the texts of the folder license_texts, and the usual forms of both
(``forms``): with a title line, without the appendix, with or without list marks.
Parts of texts, and texts with names filled in elsewhere than in a copyright line,
are not known. Their digests are made by
the same expression, grouped by digest, and broadcast only if their number, which
is counted, is below a bound. Otherwise the known digests are first cut down to
those that occur, which pre-aggregates the documents' digests, and then joined by a
plain shuffle join, whose hot digests Spark splits; rows without a digest are not
part of it.

Defined results: a null text has a null digest and no licence; so has a text
whose canonical form is empty. Licences of one canonical form give the ids of
all, sorted and joined by " OR ". Repeated rows and null keys give a row each.
Texts are digested whole. Extra columns pass through; one that is called
license_digest or license_id has _input appended to its name.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import runtime

BROADCAST_ROWS = 100_000

# Equivalent spellings, the second of each pair is canonical.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgment", "judgement"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Statements of licence that whole documents or their parts may consist of.
NOTICES = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
)

# Short licence texts.
TEXTS = (
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
)

# Title lines that stand above texts which have none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "BSD Zero-Clause License (0BSD)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
# Fixed values: (pattern, replacement) of the forms that texts are found in; each may apply or not.
FORMS = (
    (r"https?://(?:www\.)?unlicense\.org/?", "https://unlicense.org"),
    ("https://", "http://"),
    ("http://", "https://"),
    (r"(?s)(END OF TERMS AND CONDITIONS).*", r"\1"),
    (r"(?s)\s*END OF TERMS AND CONDITIONS\s*$", ""),
    (r"(?m)^\s*Copyright \[yyyy\].*$", ""),
    (r"51 Franklin Street, Fifth Floor,\s+Boston,\s+MA\s+02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307"),
    (r"(?m)^\s*(?:[1-4]\.|\*)\s+(?=Redistributions|Neither)", ""),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER AND CONTRIBUTORS"),
    ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    (r"and this permission notice shall", "and this permission notice (including the next paragraph) shall"),
    ("and/or distribute", "and distribute"),
)


def forms(license_id: str, text: str) -> list[str]:
    """A licence text in the forms that it is found in, with and without a title."""
    found = {text: None}
    for pattern, wanted in FORMS:
        found |= dict.fromkeys(re.sub(pattern, wanted, t) for t in list(found))
    return [*found, *(f"{title}\n\n{t}" for title in TITLES.get(license_id, ()) for t in found)]


def texts() -> list[tuple[str, str]]:
    """(license_id, text) of the folder license_texts: files are named by the id, and _ and a word where an id has several."""
    files = sorted((f for f in resources.files("pagemill.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt").partition("_")[0], f.read_text("utf-8")) for f in files]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(text)
    out = F.regexp_replace(out, r"(?m)^[\s*#/;%-]*+(?:copyright\s*(?:\(c\)|©|[0-9]{4})|\(c\)\s*[0-9]{4}|©|all rights reserved)[^\n]*+", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]++", "  ")
    # with two spaces between words, neighbours can both match with one on either side
    out = F.concat(F.lit("  "), out, F.lit("  "))
    for spelling, wanted in SPELLINGS:
        out = F.replace(out, F.lit(f" {'  '.join(spelling.split())} "), F.lit(f" {'  '.join(wanted.split())} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_sql(text: str) -> str:
    """The same form in DuckDB."""
    out = f"lower({text})"
    out = rf"regexp_replace({out}, '(?m)^[\s*#/;%-]*(?:copyright\s*(?:\(c\)|©|[0-9]{{4}})|\(c\)\s*[0-9]{{4}}|©|all rights reserved)[^\n]*', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g')"
    out = f"concat('  ', {out}, '  ')"
    for spelling, wanted in SPELLINGS:
        out = f"replace({out}, ' {'  '.join(spelling.split())} ', ' {'  '.join(wanted.split())} ')"
    return f"trim(replace({out}, '  ', ' '))"


def digest(text: Column) -> Column:
    """The hex SHA-256 of the canonical form, null for null texts and empty forms."""
    return F.when(canonical(text) != "", F.sha2(canonical(text), 256))


def known(spark: SparkSession, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """The licences that come with this module, and more of (license_id, text)."""
    whole = [(i, form) for i, t in (*TEXTS, *texts()) for form in forms(i, t)]
    return spark.createDataFrame([*whole, *NOTICES, *(extra or [])], "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with license_digest and license_id of the known licence that the whole text is, or null."""
    ids = licenses.select(digest(F.col("text")).alias("__known"), "license_id").where(F.col("__known").isNotNull())
    ids = ids.groupBy("__known").agg(F.array_join(F.array_sort(F.collect_set("license_id")), " OR ").alias("__license"))
    few = licenses.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = runtime.packed(docs, __canonical=canonical(F.col(f"`{text}`")))
    own = own.select("__row", F.when(F.col("__canonical") != "", F.sha2("__canonical", 256)).alias("__digest"))
    made = ("license_digest", "license_id")
    result = [*runtime.unpacked(docs.columns, made), F.col("__digest").alias(made[0]), F.col("__license").alias(made[1])]
    same = F.col("__digest") == F.col("__known")
    if few:
        return own.join(F.broadcast(ids), same, "left").select(*result)
    occurring = own.where("__digest is not null").select(F.col("__digest").alias("__known")).distinct()
    joined = own.where("__digest is not null").join(ids.join(occurring, "__known"), same, "left").select(*result)
    return joined.unionAll(own.where("__digest is null").withColumn("__license", F.lit(None).cast("string")).select(*result))
