"""License scan by canonical digests: whole texts and whole lines against known licence texts.

Normal form: lower case; copyright lines and "all
rights reserved" lines go, also behind comment marks; equivalent spellings (license/licence,
version/v, "gpl" and its long name, http/https) become one; everything but letters and
digits becomes one space. The SHA-256 of the normal form is joined with the digests of known
texts, which are normalised by the same expressions. The known texts are the statements in
this module and the full texts in ``licence_texts``, so their side of the join is bounded.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small

#: Known licence statements (fixed values): identifier, text.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

#: Titles that may stand above a licence's text, and how many of its file's first lines are its own title.
TITLES = {
    "MIT": (0, ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"]),
    "BSD-2-Clause": (0, ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"]),
    "BSD-3-Clause": (0, ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"]),
    "ISC": (0, ["ISC License", "The ISC License", "ISC License (ISC)"]),
    "Zlib": (0, ["zlib License", "The zlib License", "The zlib/libpng License"]),
    "Unlicense": (0, ["The Unlicense", "Unlicense"]),
    "Apache-2.0": (3, ["Apache License", "Apache License, Version 2.0"]),
    "GPL-2.0": (2, ["GNU General Public License, version 2"]),
    "GPL-3.0": (2, ["GNU General Public License, version 3"]),
    "LGPL-2.1": (2, ["GNU Lesser General Public License, version 2.1"]),
    "LGPL-3.0": (2, ["GNU Lesser General Public License, version 3"]),
    "MPL-2.0": (2, ["Mozilla Public License, version 2.0"]),
    "CC0-1.0": (2, ["CC0 1.0 Universal"]),
}
#: Other wordings of the same licence: pattern, replacement; each is taken or left.
WORDINGS = {
    "BSD-2-Clause": [(r"(?m)^\d\. ", "* "), ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")],
    "BSD-3-Clause": [(r"(?m)^\d\. ", "* "), ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), ("Neither the name of the copyright holder", "Neither the name of the University")],
    "ISC": [("and/or distribute", "and distribute")],
    "Unlicense": [("unlicense.org", "unlicense.org/")],
    "GPL-2.0": [(r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307")],
    "LGPL-2.1": [(r"51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307")],
}
#: The notice of the GNU licences: identifier, name, what it calls the work, version.
NOTICES = [("GPL-2.0", "GNU General Public License", "program", "2"), ("GPL-3.0", "GNU General Public License", "program", "3"), ("AGPL-3.0", "GNU Affero General Public License", "program", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "library", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "library", "3")]


def notices() -> list[tuple[str, str]]:
    """The notices that stand at the head of source files, by identifier."""
    out = [
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        (
            "Apache-2.0",
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
            "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
            "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ),
    ]
    for i, name, kind, number in NOTICES:
        for thing in dict.fromkeys((kind, "program")):
            for tail in ("if not, see <http://www.gnu.org/licenses/>.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."):
                out.append((
                    i,
                    f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {number} of the License, "
                    f"or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                    f"FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {thing}; {tail}",
                ))
    return out


def full_texts() -> list[tuple[str, str]]:
    """The full texts with and without titles, with and without what follows their terms, in all wordings."""
    bodies = [(f.stem, f.read_text(encoding="utf-8").strip()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    out = []
    for i, body in [("MIT", STATEMENTS[-1][1]), *bodies]:
        own, titles = TITLES[i]
        lines = [line for line in body.split("\n") if line.strip()]
        bare = "\n".join(lines[own:])
        wordings = [body, *(f"{t}\n\n{bare}" for t in ["", *titles])]
        wordings += [re.split("END OF TERMS AND CONDITIONS", w)[0] + end for w in wordings if "END OF TERMS AND CONDITIONS" in w for end in ("", "END OF TERMS AND CONDITIONS")]
        for old, new in WORDINGS.get(i, []):
            wordings += [re.sub(old, new, w) for w in wordings]
        out += [(i, w) for w in dict.fromkeys(wordings)]
    return out


KNOWN = [*STATEMENTS, *notices(), *full_texts()]

#: Copyright lines, also behind comment marks, but not where the wrapped text of a licence
#: begins a line with the word.
NOTICE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?![ \t]+(?:notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?)\b)|\(c\)(?![ \t]+you\b)|©|all rights reserved)[^\n]*$"
#: Equivalent spellings, applied after that to lower-case text in this order.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("https://", "http://"),
    ("creative commons attribution", "cc by"),
    ("gnu gpl", "gnu general public license"),
    ("version ", "v"),
    ("v. ", "v"),
]


def normal_form(text: Column) -> Column:
    """The normal form of a text column; the copyright pattern only runs where it can match."""
    low = F.lower(text)
    held = low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights reserved")
    low = F.when(held, F.regexp_replace(low, NOTICE, "")).otherwise(low)
    for a, b in SPELLINGS:
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """``known_digest, known_id`` of the table of known texts, one row for each digest.

    Several licences of one digest give the first by name. The digests of this module's own
    table are fetched first, so that plans do not carry the texts; a DataFrame of ``id, text``
    stays where it is and is broadcast if its counted rows allow it.
    """
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(KNOWN if known is None else known, "id string, text string")
    rows = rows.where("text is not null").select(F.sha2(normal_form(F.col("text")), 256).alias("known_digest"), "id").groupBy("known_digest").agg(F.min("id").alias("known_id"))
    if isinstance(known, DataFrame):
        return broadcast_if_small(rows)
    found = [F.struct(F.lit(r.known_digest).alias("known_digest"), F.lit(r.known_id).alias("known_id")) for r in rows.collect()]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*found))))


def scan(docs: DataFrame, known: DataFrame | list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, license_id, line_licenses`` for every document.

    digest is that of the whole text's normal form, license_id the licence whose text the
    whole document is (null if none), line_licenses the sorted licences that some line
    of it is the text of (joined by commas, empty if none). Every line is looked up.
    Null texts have a null digest and no licences; empty texts match none. Rows are kept one
    for one; ids that repeat share their lines' licences; other columns are not read.
    """
    table = known_digests(docs.sparkSession, known)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = own.select("id", F.sha2(normal_form(F.col("text")), 256).alias("digest")).join(table, F.expr("digest = known_digest"), "left")
    lines = own.select("id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("id", F.sha2(normal_form(F.col("line")), 256).alias("line_digest")).join(table, F.expr("line_digest = known_digest"))
    found = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("known_id")), ",").alias("line_licenses"))
    return whole.join(found, "id", "left").select(
        F.col("id").alias(id_col), "digest", F.col("known_id").alias("license_id"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses")
    )


def _plain_normal(text: str) -> str:
    """The normal form of a known text in plain Python, for the SQL: it shares no expression with :func:`normal_form`."""
    low = "\n".join(line for line in text.lower().split("\n") if not regex.match(NOTICE, line))
    for a, b in SPELLINGS:
        low = low.replace(a, b)
    return regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip()


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same result in DuckDB's SQL, with the digests of all known texts.

    Its patterns have no lookahead, so a line is a notice if it begins like one and not like the
    exceptions. Lines end at line feeds alone here.
    """
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    mark, words = r"^[^\p{L}\p{N}\n]*", "(?:notices?|holders?|owners?|licen[sc]es?|laws?|statements?|interests?)"
    begins = lambda x, what: f"regexp_matches({x}, {quote(mark + what)})"
    notice = f"""({begins("x", "copyright")} AND NOT {begins("x", "copyright[ " + chr(92) + "t]+" + words + chr(92) + "b")})
            OR ({begins("x", r"[(]c[)]")} AND NOT {begins("x", r"[(]c[)][ \t]+you\b")}) OR {begins("x", "(?:©|all rights reserved)")}"""

    def normal(text: str) -> str:
        low = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT ({notice})), chr(10))"
        for a, b in SPELLINGS:
            low = f"replace({low}, {quote(a)}, {quote(b)})"
        return f"sha256(trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"

    digests: dict[str, str] = {}
    for i, text in known:
        digest = hashlib.sha256(_plain_normal(text).encode()).hexdigest()
        digests[digest] = min(i, digests.get(digest, i))
    rows = ", ".join(f"('{d}', {quote(i)})" for d, i in digests.items())
    return f"""
        WITH known(digest, license_id) AS (VALUES {rows}),
        own AS (SELECT doc_id, text, {normal('text')} AS digest FROM documents),
        lines AS (SELECT doc_id, {normal('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) u),
        found AS (SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS line_licenses FROM lines l JOIN known k ON l.digest = k.digest GROUP BY 1)
        SELECT o.doc_id, o.digest, k.license_id, coalesce(f.line_licenses, '') AS line_licenses
        FROM own o LEFT JOIN known k ON o.digest = k.digest LEFT JOIN found f ON o.doc_id = f.doc_id"""
