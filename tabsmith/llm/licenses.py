"""License scans by canonical digests.

A text is brought to a canonical form (lower case, letters and digits only, copyright lines dropped,
one spelling for equivalent words), and the digest of the whole form is hash-joined to the digests
of known licence texts. Licence notices mostly stand on lines of their own, so each line is looked
up in the same way, as an entire text. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column

# Spellings that count as equal, and known licence texts.
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("honour", "honor"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("modernise", "modernize"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("organise", "organize"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("whilst", "while"), ("wilful", "willful"), ("cc by nc", "creative commons attribution noncommercial"),
]
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
{AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Lines that name who holds the rights; the patterns read alike in Python, Java and RE2.
COPYRIGHT = r"(^|\n)[ \t]*[*#/;]*[ \t]*(copyright[ \t:]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}\n]+"
NAMES = sorted({name for name, _ in KNOWN})


def canonical(text: str) -> str:
    """Canonical form, lines apart."""
    import regex

    out = regex.sub(OTHER, " ", re.sub(COPYRIGHT, "\n", text.lower()))
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def digests() -> list[tuple[str, int]]:
    """Digest of every known text and the number of its licence."""
    whole = {sha256(" ".join(canonical(t).split()).encode()).hexdigest(): NAMES.index(n) for n, t in KNOWN}
    return sorted(whole.items())


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "\n"), OTHER, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, license (of the entire text, else NULL), n_lines (lines that are a
    known text), licenses (all names found, in order, joined by commas; empty if none).

    NULL and empty texts match nothing. Repeated rows are kept, an empty table gives no rows. The known
    digests, a fixed list, are broadcast; the sums are made where the texts are read.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(d, n, 1 << n) for d, n in digests()], "digest string, number int, bit long")
    rows = docs.select(
        column(docs, doc_id).alias("doc_id"), canonical_column(F.coalesce(column(docs, text), F.lit(""))).alias("form"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    entire = F.trim(F.regexp_replace("form", "[ \n]+", " "))
    lines = F.transform(F.split("form", "\n"), lambda x: F.trim(x))
    units = rows.select("doc_id", "row_no", F.posexplode(F.concat(F.array(entire), lines)).alias("place", "unit"))
    found = units.withColumn("digest", F.sha2("unit", 256)).join(F.broadcast(known), "digest", "left")
    sums = found.groupBy("doc_id", "row_no").agg(
        F.max(F.when(F.col("place") == 0, F.col("number"))).alias("whole"),
        F.count_if((F.col("place") > 0) & F.col("number").isNotNull()).alias("n_lines"),
        F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("bits"),
    )
    names = F.array(*[F.lit(n) for n in NAMES])
    held = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(NAMES)]), lambda x: x.isNotNull())
    return sums.select("doc_id", F.get(names, F.col("whole")).alias("license"), "n_lines", F.array_join(held, ",").alias("licenses"))


def oracle() -> str:
    """The same in SQL over `documents`."""
    form = f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', chr(10), 'g'), '{OTHER}', ' ', 'g')"
    form = form.replace(r"\n", "\\n")
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{NAMES[n]}')" for d, n in digests())
    return f"""WITH rows AS (SELECT doc_id, row_number() OVER () AS row_no, {form} AS form FROM documents),
      units AS (
        SELECT doc_id, row_no, 0 AS place, trim(regexp_replace(form, '[ \\n]+', ' ', 'g')) AS unit FROM rows
        UNION ALL SELECT doc_id, row_no, 1, trim(unnest(string_split(form, chr(10)))) FROM rows),
      found AS (SELECT u.*, k.name FROM units u LEFT JOIN (VALUES {values}) k(digest, name) ON sha256(u.unit) = k.digest)
    SELECT doc_id, max(name) FILTER (WHERE place = 0) AS license, count(name) FILTER (WHERE place = 1) AS n_lines,
      coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses
    FROM found GROUP BY doc_id, row_no"""
