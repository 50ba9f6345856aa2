"""Licence scans by canonical digest.

A text is brought to a canonical form (lower case, no copyright lines, one
spelling of equivalent words, words only, single spaces) and its SHA-256 is
looked up among those of known licences. Both whole texts and whole lines are
looked up, so a document that is a licence and one that carries a notice are
told apart. The table of known licences is fixed and small, so it is broadcast;
another may be given as a table.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts

# Equivalent spellings, as patterns of canonical words.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bfavour", "favor"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bjudgement", "judgment"),
    (r"\borganis", "organiz"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bhttps\b", "http"),
    (r"\bversion (\d)", r"v \1"),
    (r"\bv(\d)", r"v \1"),
]

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
#: As above, behind comment marks too, but no line of a licence's own wording.
_WORDING = r"notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interest|rights?|permission|disclaimers?|protection|and|or|in|on|is"
COMMENTED_LINE = rf"(^|\n)[ \t#*/;!%<>-]*(copyright(?!s?[ \t]+(?:{_WORDING})\b)|\(c\)(?![ \t]+(?:you|if|in|under|accompany|prohibit|affirmer)\b)|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Licence notices and texts, by SPDX identifier.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted. " + _ISC_WARRANTY),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
]


TEXTS = Path(__file__).parent / "license_texts"
#: Paragraphs of title at the head of the shipped texts.
TITLE = {"GPL-2.0-only.spdx": 2, "CC0-1.0": 2, "CC-BY-SA-4.0": 2, "BSD-2-Clause": 0}
END = "END OF TERMS AND CONDITIONS"
NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)


def whole_texts() -> list[tuple[str, str]]:
    """Entire licences: the shipped files and the short ones of :data:`KNOWN`, with and
    without title, and without what follows the end of the terms."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8").strip()
        bare = text
        for _ in range(TITLE.get(name, 1)):
            bare = re.split(r"\n\s*\n", bare, maxsplit=1)[1]
        for form in (text, bare):
            out += [(name.removesuffix(".spdx"), form), (name.removesuffix(".spdx"), form.partition(END)[0] + END * (END in form))]
    short = {i: [text for known, text in KNOWN if known == i and len(text) > 400] for i in ("MIT", "ISC", "0BSD")}
    two = re.sub(COMMENTED_LINE, r"\1", (TEXTS / "BSD-2-Clause.txt").read_text(encoding="utf-8"), flags=re.I).strip()
    three = two.replace("THIS SOFTWARE IS PROVIDED", f"3. {NO_ENDORSEMENT}\n\nTHIS SOFTWARE IS PROVIDED", 1)
    short |= {"BSD-2-Clause": [two, re.sub(r"(?m)^\d\. ", "", two)], "BSD-3-Clause": [three, re.sub(r"(?m)^\d\. ", "", three)]}
    titles = {
        "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
        "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
        "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
        "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    }
    for name, bodies in short.items():
        out += [(name, f"{title}\n{reserved}\n{body}") for body in bodies for title in ("", *titles[name]) for reserved in ("", "All rights reserved.")]
    return out


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COMMENTED_LINE, "\n")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling.replace(r"\1", "$1"))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | list[tuple[str, str]] = KNOWN) -> DataFrame:
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, license_text string")
    return table.select("license_id", digest(F.col("license_text")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


# Beginnings of the words that spelling rules write.
REWRITTEN = ("licen", "sublicense", "non", "infringement", "favo", "fulfil", "judg", "organi", "copyright", "owner", "holder", "http", "version", "sub")


def may_match(text: Column, known: list[tuple[str, str]] = KNOWN, words: int = 4) -> Column:
    """A condition that every text with a known digest meets, and few others: all of
    the longest words of some known text that no rule rewrites stand in it. It
    spares the other texts the work of the canonical form."""
    tests = set()
    for _, known_text in known:
        plain = re.sub(COMMENTED_LINE, "\n", known_text.lower())
        own = {w for w in re.findall("[a-z]{3,}", plain) if not w.startswith(REWRITTEN)}
        tests.add(tuple(sorted(own, key=lambda w: (-len(w), w))[:words]))
    if not tests or () in tests:
        return F.lit(True)
    low = F.lower(text)
    every = [reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in test)) for test in sorted(tests)]
    return reduce(lambda a, b: a | b, every)


def license_scan(docs: DataFrame, known: DataFrame | list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input id, licence and scope: doc_id, license_id, scope, n.

    ``scope`` is 'text' where the whole text is the licence and 'line' where n of
    its lines are; a text of one line counts as both. Null and empty texts,
    and texts without a known digest, give no row. Rows that repeat an id add up;
    null ids are counted together. Other columns are not read. ``known`` holds
    (license_id, license_text), as rows or as a table of any size; without it,
    :data:`KNOWN` and :func:`whole_texts`.
    """
    known = [*KNOWN, *whole_texts()] if known is None else known
    table = isinstance(known, DataFrame)
    possible = lambda text: F.lit(True) if table else may_match(F.col(text), known)
    texts = keyed_texts(docs, id_col, text_col).where(possible("text"))
    whole = texts.select("doc_id", F.lit("text").alias("scope"), digest(F.col("text")).alias("digest"))
    lines = texts.select("doc_id", F.lit("line").alias("scope"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(possible("line")).select("doc_id", "scope", digest(F.col("line")).alias("digest"))
    digests = known_digests(docs.sparkSession, known)
    found = whole.union(lines).join(digests if table else F.broadcast(digests), "digest")
    return found.groupBy("doc_id", "license_id", "scope").agg(F.count("*").alias("n"))


def _duck(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, {quote(NOT_WORD)}, ' ', 'g'))"
    for pattern, spelling in SPELLINGS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(spelling)}, 'g')"
    return f"sha256({out})"


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known)
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, {_duck("license_text")} AS digest FROM (VALUES {rows}) AS k(license_id, license_text) GROUP BY 2),
units AS (
  SELECT doc_id, 'text' AS scope, {_duck("coalesce(text, '')")} AS digest FROM documents
  UNION ALL
  SELECT doc_id, 'line', {_duck("line")} FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0
)
SELECT doc_id, license_id, scope, count(*) AS n FROM units JOIN known USING (digest) GROUP BY doc_id, license_id, scope
"""
