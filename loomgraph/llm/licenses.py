"""Licence scan by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, anything but letters and digits
made a space. The digest of the whole form is looked up among those of known licence texts; the same look-up on each line finds
one-line notices inside longer texts. The table of known forms is part of this module and its folder of texts, so its size is fixed.

Rows: null and empty texts have no licence. A row's answer depends on its text only, so repeated rows repeat it. Texts of any length are looked up whole, and every line of
them. Where two licences have one canonical form, the name that sorts first is given. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import re
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import named

# Licence names and the texts or notices that stand for them.
MIT = (
    "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]
# Spellings and what they become, in this order, on lower-case text of words and single spaces.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("released under", "licensed under"),
    ("creative commons attribution noncommercial", "cc by nc"),
    ("creative commons attribution non commercial", "cc by nc"),
    ("creative commons attribution sharealike", "cc by sa"),
    ("creative commons attribution", "cc by"),
    ("gnu gpl", "gnu general public license"),
    ("version", "v"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("judgement", "judgment"),
    ("fulfilment", "fulfillment"),
    ("favour", "favor"),
]
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|all rights reserved|©|\(c\))[^\n]*$"
NOT_WORD = r"[^a-z0-9]+"


def canonical(text: Column) -> Column:
    """The canonical form: words with single spaces between. Between them are two while spellings are replaced, so that each word has spaces of its own."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, NOT_WORD, "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def spaced(spelling: str) -> str:
    return f" {spelling.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def whole_texts() -> list[tuple[str, str]]:
    """Whole licences from the folder of texts, in the forms that they are handed on in: with or without title, numbers, rights line or closing advice."""
    folder = files("loomgraph.llm") / "license_texts"
    read = lambda name: (folder / f"{name}.txt").read_text(encoding="utf-8")
    out = []
    for name, n in (("BSD-2-Clause", 2), ("BSD-3-Clause", 3)):
        body = read(name)
        plain = re.sub(r"(?m)^ *(?:[0-9]\.|\*) ", "", body[body.index("Redistribution and use") :])
        parts = re.split(r"(?=Redistributions of source|Redistributions in binary|Neither the name)", plain)
        numbered = parts[0] + "".join(f"{k}. {p}" for k, p in enumerate(parts[1:], 1))
        titles = ("", f"BSD {n}-Clause License\n", f"The BSD {n}-Clause License\n")
        for title, rights, text in product(titles, ("", "All rights reserved.\n"), (plain, numbered)):
            out += [(name, title + rights + text), (name, title + rights + re.sub(r"HOLDER(\s+)OR", r"OWNER\1OR", text))]
    for name, body in (("MIT", MIT.split("\n", 1)[1]), ("ISC", ISC.split("\n", 1)[1])):
        out += [(name, title + body) for title in ("", f"The {name} License\n", f"The {name} License ({name})\n")]
    apache, gpl2 = read("Apache-2.0"), read("GPL-2.0")
    moved = re.sub(r"51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", gpl2)
    forms = [("Apache-2.0", apache), ("Apache-2.0", re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", apache)), ("GPL-2.0", gpl2), ("GPL-2.0", moved)]
    forms += [(name, read(name)) for name in ("GPL-3.0", "MPL-2.0", "CC0-1.0")]
    end = "END OF TERMS AND CONDITIONS"
    forms += [(name, t[: t.index(end) + cut]) for name, t in forms if end in t for cut in (0, len(end))]
    return out + [(name, re.sub("https?://", web, t)) for name, t in forms for web in ("http://", "https://")]


def known_licenses(spark) -> DataFrame:
    """digest, license; forms that fall together count once. As many rows as KNOWN and ``whole_texts`` at most."""
    rows = spark.createDataFrame(KNOWN + whole_texts(), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the whole text, else null), notices (licences of single lines, sorted and distinct, joined by commas), n_notice_lines per row.

    Whole texts are hash-joined to the known digests; lines look theirs up in a map literal of the same fixed table, so nothing is shuffled. Every
    line gets a canonical form, as any of its words may be a spelling of a known one.
    """
    rows = named(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = known_licenses(docs.sparkSession).collect()
    known = docs.sparkSession.createDataFrame(found, "digest string, license string")
    listed = F.create_map(*[F.lit(x) for r in found for x in (r.digest, r.license)])
    hits = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.try_element_at(listed, digest(x))), lambda x: x.isNotNull())
    scanned = rows.select("id", digest(F.col("text")).alias("digest"), hits.alias("hits"))
    joined = scanned.join(F.broadcast(known), "digest", "left")
    return joined.select("id", "license", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").cast("long").alias("n_notice_lines"))
