"""License scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, punctuation and equivalent
spellings), and the SHA-256 of the form is hash-joined to the digests of known licences.
What is looked up is always an entire text: the whole document, and each whole line of it,
as short notices stand on a line of their own. Digests explode, one row each, and meet the
known table in one hash join; it is broadcast if it is counted to be small. Only a document's
id and its hits are shuffled, never its text.

Defined results: a null text counts as empty, and an empty canonical form matches nothing
(its digest is still given). Repeated rows give repeated result rows. Several notices are
listed once each, in alphabetical order.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

# The licences' own words.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
LICENSES = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
#: Digests of the canonical forms of longer licences, as Debian's base-files has their whole texts.
DIGESTS = {
    "Apache-2.0": "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
}
#: Notices that stand for a licence: each name below, in each of the forms.
NOTICE_FORMS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This software is licensed under the {}.", "SPDX-License-Identifier: {}"]
NOTICE_NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
}
#: Lines of the standard headers of source files that name their licence.
HEADER_LINES = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Spellings that count as equal, put in this order on the lower-case text.
EQUAL_SPELLINGS = [("licence", "license"), ("favour", "favor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https://", "http://"), ("©", "(c)"), ("&", " and ")]
#: British -ise forms that licences use.
ISE = r"\b(organi|recogni|authori|utili|initiali)s(e|ed|es|ing|ation|ations)\b"
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright *\(c\)|\(c\)|copyright *[0-9]{4})[^\n]*$"
RESERVED = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


def canonical(text):
    """The canonical form, one line for each line of ``text``; words stand a blank apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for a, b in EQUAL_SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    for pattern, put in ((COPYRIGHT, ""), (RESERVED, ""), (ISE, "$1z$2"), (r"[^\p{L}\p{N}\n]+", " ")):
        out = F.regexp_replace(out, pattern, put)
    return out


def canonical_text(text: str) -> str:
    """:func:`canonical` in Python, for the known texts only."""
    out = text.lower()
    for a, b in EQUAL_SPELLINGS:
        out = out.replace(a, b)
    plain = lambda p: p.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
    assert not any(unicodedata.category(c)[0] in "LN" and not c.isascii() for c in out)
    for pattern, put in ((COPYRIGHT, ""), (RESERVED, ""), (ISE, r"\1z\2"), (r"[^\p{L}\p{N}\n]+", " ")):
        out = re.sub(plain(pattern), put, out)
    return out


def _one_line(text: str) -> str:
    return re.sub(r"[ \n]+", " ", text).strip(" ")


def _notices() -> list[tuple[str, str]]:
    named = [(name, form.format(x)) for name, spelled in NOTICE_NAMES.items() for form in NOTICE_FORMS for x in spelled]
    return named + [(name, line) for name, lines in HEADER_LINES.items() for line in lines]


def known() -> list[tuple[str, str, bool]]:
    """(digest, licence, whether it is a notice) of all known texts; a digest has one licence."""
    rows = {}
    for name, text in LICENSES.items():
        rows[hashlib.sha256(_one_line(canonical_text(text)).encode()).hexdigest()] = (name, False)
    for name, digest in DIGESTS.items():
        rows[digest] = (name, False)
    for name, notice in _notices():
        rows.setdefault(hashlib.sha256(_one_line(canonical_text(notice)).encode()).hexdigest(), (name, True))
    return [(d, *x) for d, x in sorted(rows.items())]


def scan(docs: DataFrame, table: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), notices, n_notice_lines.

    ``notices`` joins the licences of lines with a comma (empty if none). ``table`` has the
    digest of each canonical text, its licence, and whether it is a notice that stands on a
    line; of repeated digests the first row counts.
    """
    spark: SparkSession = docs.sparkSession
    rows_ = list({d: (d, name, bool(notice)) for d, name, notice in reversed(known() if table is None else table)}.values())
    texts = spark.createDataFrame(rows_, "digest string, license string, is_notice boolean")
    texts = F.broadcast(texts) if len(rows_) <= BROADCAST_ROWS else texts
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical(F.col("text")).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    whole = F.array(F.trim(F.regexp_replace("form", "[ \n]+", " ")))
    rows = rows.select("row", "doc_id", F.posexplode(F.concat(whole, lines)).alias("line", "part"))
    rows = rows.select("row", "doc_id", "line", F.sha2("part", 256).alias("digest")).join(texts, "digest", "left")
    # The first is the whole text; of the others only known notices go on.
    rows = rows.where("line = 0 or is_notice")
    first = F.col("line") == 0
    out = rows.groupBy("row").agg(
        F.max(F.when(first, F.col("doc_id"))).alias("doc_id"), F.max(F.when(first, F.col("digest"))).alias("digest"), F.max(F.when(first, F.col("license"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~first, F.col("license")))), ",").alias("notices"), F.count_if(~first).alias("n_notice_lines"),
    )
    return out.drop("row")


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = "lower(coalesce(text, ''))"
    for a, b in EQUAL_SPELLINGS:
        form = f"replace({form}, {quote(a)}, {quote(b)})"
    for pattern, put in ((COPYRIGHT, ""), (RESERVED, ""), (ISE, r"\1z\2"), (r"[^\p{L}\p{N}\n]+", " ")):
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(put)}, 'g')"
    values = ", ".join(f"({quote(d)}, {quote(n)}, {str(x).lower()})" for d, n, x in known())
    return f"""
    WITH known(digest, license_id, is_notice) AS (VALUES {values}),
    forms AS (SELECT row_number() OVER () AS r, doc_id, {form} AS form FROM documents),
    lines AS (SELECT r, trim(unnest(string_split(form, chr(10))), ' ') AS line FROM forms),
    hits AS (SELECT r, license_id FROM lines JOIN known ON is_notice AND sha256(line) = digest),
    found AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n FROM hits GROUP BY r),
    whole AS (SELECT r, doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM forms)
    SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notice_lines
    FROM whole LEFT JOIN found USING (r) LEFT JOIN (SELECT digest, license_id FROM known) USING (digest)"""
