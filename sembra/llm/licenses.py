"""Licence scans by canonical digest lookup (DataFrame functions only).

A text is cut into lines; each is lower-cased, punctuation and white space become one blank,
equivalent spellings become one, and copyright lines go.  The canonical text is the canonical lines
joined by a blank.  Its SHA-256 is hash-joined with the digests of known licences, made by the same
expressions.  Licence notices (known texts of one line) are looked up in the same way for each line.

Where a text is wrapped, a line of a licence may begin with the word copyright, and a spelling of
two words may be cut.  So a second digest is looked up, of the lines without those that STATEMENT
matches, with the spellings of two words replaced in the joined text.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_digests import DIGESTS

#: Replaced in this order, in the known texts as well, so it matters only that both sides agree.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("organisation", "organization"), ("authoris", "authoriz"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("behaviour", "behavior"),
    ("utilis", "utiliz"), ("recognis", "recogniz"), ("initialis", "initializ"), ("merchantibility", "merchantability"), ("fulfilment", "fulfillment"), ("wilful", "willful"), ("whilst", "while"),
]
COPYRIGHT = r"^\s*(copyright|\(c\)|©)([^\p{L}]|$)"
_YEAR = r"[\[<{(]?\s*([0-9]{4}|(?i:yyyy|year))"
#: A copyright statement: a mark followed by a sign or a year, or by a name in capitals; or reserved rights on a line.
STATEMENT = rf"^\s*((?i:copyright)[\s:,]*(\((?i:c)\)|©|{_YEAR})|Copyright\s+(?!Holder|Owner|Notice|Law|Licen|Act|Statement|Interest)\p{{Lu}}|\((?i:c)\)[\s:,]*((?i:copyright)[\s:,]*)?{_YEAR}|©|(?i:all rights reserved)[^\p{{L}}\p{{N}}]*$)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: (licence, known text): whole licences, and notices of one line.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "The MIT License\n" + _MIT),
    ("ISC", _ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC_BODY + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_BODY + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("Apache-2.0", "Released under the Apache License 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License v3.0."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
#: The SQL twin holds these alone.
SQL_KNOWN = list(KNOWN)
_AGREE = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
{}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
You should have received a copy of the GNU {kind}General Public License along with this {what}{end}"""
_ADDRESS = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_OLD_ADDRESS = "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"
_BULLETS = lambda t: t.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
#: Standard headers of files, and usual variants of the short licences.
KNOWN += [("ISC", title + _AGREE + _ISC_END) for title in ("", "ISC License\n")]
KNOWN += [("BSD-2-Clause", title + _BULLETS(_BSD_HEAD) + _BSD_END) for title in ("", "BSD 2-Clause License\n")]
KNOWN += [("BSD-3-Clause", title + _BULLETS(_BSD_HEAD + _BSD_3) + _BSD_END) for title in ("", "BSD 3-Clause License\n")]
KNOWN += [("Apache-2.0", _APACHE.format(s)) for s in ("http", "https")] + [("MPL-2.0", _MPL.format(s)) for s in ("http", "https")]
KNOWN += [
    (name, _GNU.format(what=what, kind=kind, v=v, end=end))
    for name, kind, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"))
    for what in ("program", "library")
    for end in (_ADDRESS, _OLD_ADDRESS, ". If not, see <http://www.gnu.org/licenses/>.", ". If not, see <https://www.gnu.org/licenses/>.", ".")
]
_MIT_LINES = _MIT.split("\n")
_MIT_0 = _MIT_LINES[0].removesuffix(", subject to the following conditions:") + ".\n" + _MIT_LINES[2]
KNOWN += [("MIT-0", title + _MIT_0) for title in ("", "MIT No Attribution\n")]


def license_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in license_texts: as they are, without the title, and with either kind of address."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        rest = text.split("\n", 1)[1]
        for t in (text, rest):
            out += [(file.name.removesuffix(".txt"), x) for x in dict.fromkeys((t, t.replace("http://", "https://"), t.replace("https://", "http://")))]
    return out


KNOWN += license_texts()
#: Known texts up to this size are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20


def _canonical(x: Column) -> Column:
    x = F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _marked_lines(text: Column) -> Column:
    """Per line its canonical form, and whether it goes by COPYRIGHT and by STATEMENT."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(_canonical(x).alias("line"), F.rlike(F.lower(x), F.lit(COPYRIGHT)).alias("c"), F.rlike(x, F.lit(STATEMENT)).alias("s")))


def _without(marked: Column, mark: str) -> Column:
    return F.transform(F.filter(marked, lambda x: ~x[mark] & (x["line"] != "")), lambda x: x["line"])


def _unwrapped(lines: Column) -> Column:
    """The canonical text, whatever the lines."""
    x = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        if " " in old:
            x = F.replace(x, F.lit(old), F.lit(new))
    return x


def known_digests(spark: SparkSession, known: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license) by both digests: of equal digests the first name by order stays, so a lookup gives one row."""
    given = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{n}')" for n, d in digests or [("", "")]) + " AS t(digest, license)").where("digest <> ''")
    if not known:
        return given.groupBy("digest").agg(F.min("license").alias("license"))
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(n)}, {quote(t)})" for n, t in known) + " AS t(license, text)")
    marked = rows.select("license", _marked_lines(F.col("text")).alias("m"))
    both = F.array(F.array_join(_without(F.col("m"), "c"), " "), _unwrapped(_without(F.col("m"), "s")))
    return marked.select("license", F.explode(both).alias("text")).where("text <> ''").select(F.sha2("text", 256).alias("digest"), "license").union(given).groupBy("digest").agg(F.min("license").alias("license"))


def licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, license, notices, n_notices.

    The table of licences is ``known`` and, where that is the default, DIGESTS of long texts too.
    license: the known licence whose canonical text equals the document's by either digest, else
    null.  notices: the licences whose known text is one line of the document, each once, in order,
    comma-joined (empty: none); n_notices counts such lines.  A null or empty text has the digest of
    the empty text and no licence; an empty known text matches nothing.  Repeated rows and null ids
    stay; a very long text is digested as a whole; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, [(n, t) for n, t in known if t.strip()], DIGESTS if known is KNOWN else ())
    if sum(len(n) + len(t) for n, t in known) <= BROADCAST_BYTES:
        digests = F.broadcast(digests)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _marked_lines(F.col(text_col)).alias("m"))
    rows = rows.select("rid", "doc_id", _without(F.col("m"), "c").alias("lines"), F.sha2(_unwrapped(_without(F.col("m"), "s")), 256).alias("unwrapped"))
    rows = rows.select("rid", "doc_id", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"), "unwrapped", F.explode_outer("lines").alias("line"))
    hits = rows.select("rid", "doc_id", "canonical_sha256", "unwrapped", F.sha2("line", 256).alias("digest")).join(digests, "digest", "left")
    found = hits.groupBy("rid", "doc_id", "canonical_sha256", "unwrapped").agg(F.count("license").alias("n_notices"), F.collect_set("license").alias("notices"))
    whole = digests.select(F.col("digest").alias("canonical_sha256"), F.col("license").alias("first"))
    again = digests.select(F.col("digest").alias("unwrapped"), F.col("license").alias("second"))
    found = found.join(whole, "canonical_sha256", "left").join(again, "unwrapped", "left")
    return found.select("doc_id", "canonical_sha256", F.coalesce("first", "second").alias("license"), F.array_join(F.sort_array("notices"), ",").alias("notices"), "n_notices")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, and the licences that its lines name; whole texts."""
    return licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    one = "trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        one = f"replace({one}, '{old}', '{new}')"
    lines = lambda t: f"list_filter(list_transform(list_filter(string_split(lower(coalesce({t}, '')), chr(10)), lambda y: NOT regexp_matches(y, '{COPYRIGHT}')), lambda x: {one}), lambda z: z <> '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in SQL_KNOWN)
    return f"""
WITH known AS (SELECT sha256(array_to_string({lines('text')}, ' ')) AS digest, min(license) AS license FROM (VALUES {values}) t(license, text) GROUP BY 1),
d AS (SELECT doc_id, {lines('text')} AS lines FROM documents),
e AS (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM e JOIN known USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest FROM d)
SELECT w.doc_id, w.digest AS canonical_sha256, known.license, coalesce(n.notices, '') AS notices, coalesce(n.n, 0) AS n_notices
FROM w LEFT JOIN known ON w.digest = known.digest LEFT JOIN n ON n.doc_id = w.doc_id"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _oracle()}
