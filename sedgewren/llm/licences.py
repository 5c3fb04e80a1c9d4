"""Licence scans by canonical digest lookup, with DataFrame functions alone.

A text is brought to a canonical form: A-Z lowered, copyright lines dropped, every run of other characters than a to z and 0 to 9
made one blank, equivalent spellings made one.  The SHA-256 digest of the canonical whole text is joined to the digests of
known licences; so are the digests of its single lines, which finds licence notices inside other texts.  Known licences are a
small fixed table (some hundred digests), which is broadcast; a line longer than twice the longest notice, in canonical
form, cannot be one and is not hashed.

Defined cases: null texts, and texts of which nothing is left in canonical form, have a null digest and no licence; repeated
rows are found alike; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence texts use alike, the second taken as canonical.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "sublicence": "sublicense", "noncommercial": "non commercial", "percent": "per cent", "owner": "holder",
}

# Names that notices call licences by.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["Unlicense"],
}

# The frames of notices; {} is a name.
FRAMES = ["{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This work is licensed under a {}", "This software is licensed under the {}", "Distributed under the {}", "This project is licensed under the {}", "SPDX-License-Identifier: {id}"]

# Whole licence texts, without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Copyright lines.  A line goes if a mark (the word, a sign or both) is followed by a year; if a sign and the word, or ©, are followed by
# names alone; or if it stands in the text's head and the word is followed by names alone.  Names are words that don't begin with a small
# letter, and the few that join them.  The head is made of lines of such words (titles), links, and reservations of rights.
# A line of names that goes on after a comma or "and" belongs to the one before.
_NAME = r"(?:[^a-z \t\n][^ \t\n]*|(?:and|of|the|by|for|de|van|von|der|la|le|et|al|contributors|authors|others)[,.;]?)"
_NAMES = rf"{_NAME}(?:[ \t]+{_NAME})*"
_LEAD, _WORD, _SIGN, _LINK = r"^[^A-Za-z0-9\n(©]*", r"(?i:copyright)", r"(?:\([cC]\)|©)", r"https?://[^ \t\n]*"
_MARK = rf"(?:{_WORD}[^A-Za-z0-9\n(©]*{_SIGN}?|{_SIGN}[^A-Za-z0-9\n]*{_WORD}?)"
_BOTH = rf"(?:{_WORD}[^A-Za-z0-9\n(©]*{_SIGN}|{_SIGN}[^A-Za-z0-9\n]*{_WORD}|©)"
_HEAD = rf"\A((?:[ \t]*(?:{_NAMES}|{_LINK}|All rights reserved\.?)?[ \t]*\n)*?)"
#: (pattern, what stays) in the order in which they are applied.
DROPPED = [
    *[(rf"({_LEAD}{_MARK}[^\n]*(?:,|&| and))[ \t]*\n[ \t]*({_NAMES}[ \t]*)$", r"\1 \2")] * 2,
    (rf"{_LEAD}{_MARK}[^A-Za-z0-9\n]*(?:by[ \t]+)?(?:19|20)[0-9][0-9][^\n]*$", ""),
    (rf"{_LEAD}{_BOTH}[,:.]?[ \t]*{_NAMES}[ \t]*$", ""),
    *[(rf"{_HEAD}[^A-Za-z0-9\n]*{_WORD}[,:]?[ \t]+{_NAMES}[ \t]*$", r"\1")] * 3,
    (rf"{_HEAD}[ \t]*{_LINK}[ \t]*$", r"\1"),
]
#: Texts without any of these have no such line.
MARKED = r"(?i)copyright|\(c\)|©|https?://"
#: A holder named in a clause, and the clause as it is known.
HOLDER, HELD = "neither the name of (.{1,80}?) nor the names of its", "neither the name of the copyright holder nor the names of its"


#: Where the appendix of a long licence begins.
APPENDIX = r"\n[ \t]*(APPENDIX: )?How to (Apply|apply) [^\n]*\n|\n[ \t]*END OF TERMS AND CONDITIONS"


def notices() -> list[tuple[str, str]]:
    """(licence, text) of all notices: every frame with every name."""
    return [(i, f.format(n, id=i)) for i, names in NAMES.items() for n in names for f in FRAMES]


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of all whole texts: as they are, after a title line and a reservation of rights (the copyright line between
    them is none of the canonical form), and without the appendix on how to apply them."""
    texts = dict(TEXTS)
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        texts[path.stem] = path.read_text(encoding="utf-8")
    out = []
    for i, text in texts.items():
        ends = [text] + [text[: m.start()] for m in [re.search(APPENDIX, text)] if m]
        titles = [t for n in NAMES.get(i, [i]) for t in (n, f"The {n}", f"{n} ({i})", f"The {n} ({i})")]
        # clauses may have other signs than numbers, which the canonical form doesn't keep
        ends += [re.sub(r"(?m)^[0-9]\. ", "", e) for e in ends if "\n1. " in e]
        out += [(i, f"{title}{rights}{end}") for end in ends for title in ("", *(f"{t}\n\n" for t in titles)) for rights in ("", "All rights reserved.\n\n")]
    return out


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _spelled(text: Column) -> Column:
    """The canonical spelling of the words of a plain text; texts without any other spelling, which are most, are not taken apart."""
    pairs = F.create_map(*(F.lit(x) for pair in EQUIVALENT.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(pairs, w), w)), " ")
    return F.when(text.rlike(rf"\b(?:{'|'.join(EQUIVALENT)})\b"), spelled).otherwise(text)


def _without_copyright(text: Column) -> Column:
    """A text without its copyright lines, lowered."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    for pattern, stays in DROPPED:
        lines = F.regexp_replace(lines, "(?md)" + pattern, re.sub(r"\\([0-9])", r"$\1", stays))
    return _lowered(F.when(text.rlike(MARKED), lines).otherwise(text))


def _whole(low: Column) -> Column:
    """Canonical form of a whole text that _without_copyright() gave; null if nothing is left."""
    out = _spelled(_plain(low))
    return F.nullif(F.when(out.contains("neither the name of"), F.regexp_replace(out, HOLDER, HELD)).otherwise(out), F.lit(""))


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null if nothing is left."""
    return _whole(_without_copyright(text))


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence, size, notice) of the known texts and notices; a notice has a single line."""
    rows = texts if texts is not None else [*whole_texts(), *notices()]
    out = spark.createDataFrame(rows, "licence string, text string").select("licence", canonical(F.col("text")).alias("t"), ~F.col("text").contains("\n") & (F.length("text") <= 400)).toDF("licence", "t", "notice").where("t is not null")
    return out.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("t")).alias("size"), F.max("notice").alias("notice"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, text_licence, line_licences: the licence that the whole text is, and those that its lines name.

    ``known`` has the columns of known_licences(); it is broadcast, so it is checked to be small.
    """
    known = known if known is not None else known_licences(docs.sparkSession)
    rows, most = known.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("notice"), F.col("size"))), F.lit(0))).first()
    if rows > 100_000:
        raise ValueError("more than 100,000 known licences are no fixed table any more")
    low = _without_copyright(F.coalesce("text", F.lit("")))
    lowered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), low.alias("low"))
    plain = F.filter(F.transform(F.split("low", "\n"), _plain), lambda x: (x != "") & (F.length(x) <= 2 * most))
    lines = F.array_distinct(F.transform(plain, lambda x: F.sha2(_spelled(x), 256)))
    marked = lowered.select("doc_id", "row", F.sha2(_whole(F.col("low")), 256).alias("text_digest"), lines.alias("lines"))
    named = marked.join(F.broadcast(known.select(F.col("digest").alias("text_digest"), F.col("licence").alias("text_licence"))), "text_digest", "left")
    each = named.select("doc_id", "row", "text_digest", "text_licence", F.explode_outer("lines").alias("digest"))
    found = each.join(F.broadcast(known.where("notice").select("digest", "licence")), "digest", "left")
    # a document has one row in each task at most after the map-side part of this aggregate
    sets = found.groupBy("row", "doc_id", "text_digest", "text_licence").agg(F.collect_set("licence").alias("licences"))
    return sets.select("doc_id", "text_digest", "text_licence", F.array_join(F.array_sort("licences"), ",").alias("line_licences"))


def canonical_text(text: str) -> str:
    """Canonical form in plain Python, for tests and the SQL of the known digests."""
    if re.search(MARKED, text):
        text = re.sub("\r\n?", "\n", text)
        for pattern, stays in DROPPED:
            text = re.sub("(?m)" + pattern, stays, text)
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return re.sub(HOLDER, HELD, " ".join(EQUIVALENT.get(w, w) for w in re.sub("[^a-z0-9]+", " ", low).split()))


def scan_sql(docs: str = "documents") -> str:
    """The scan as DuckDB SQL."""
    import hashlib

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known: dict[str, tuple[str, bool]] = {}
    for i, text in [*whole_texts(), *notices()]:
        d = hashlib.sha256(canonical_text(text).encode()).hexdigest()
        notice = "\n" not in text and len(text) <= 400
        known[d] = (min(i, known[d][0]), notice or known[d][1]) if d in known else (i, notice)
    values = ", ".join(f"('{d}', {quoted(i)}, {n})" for d, (i, n) in sorted(known.items()))
    keys = "[" + ", ".join(map(quoted, EQUIVALENT)) + "]"
    words = "[" + ", ".join(map(quoted, EQUIVALENT.values())) + "]"
    plain = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    spelled = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce(list_extract({words}, list_position({keys}, w)), w)), ' ')"
    lines = "regexp_replace(text, '\r\n?', chr(10), 'g')"
    for pattern, stays in DROPPED:
        lines = f"regexp_replace({lines}, {quoted('(?m)' + pattern)}, {quoted(stays)}, 'g')"
    low = f"translate(case when regexp_matches(text, {quoted(MARKED)}) then {lines} else text end, '{_UPPER}', '{_LOWER}')"
    held = f"regexp_replace({spelled('t')}, '{HOLDER}', '{HELD}', 'g')"
    return f"""
with known(digest, licence, notice) as (values {values}),
given as (select doc_id, row_number() over () as r, coalesce(text, '') as text from {docs}),
lowered as (select doc_id, r, {low} as low from given),
whole as (select doc_id, r, low, nullif({plain('low')}, '') as t from lowered),
marked as (select doc_id, r, sha256({held}) as text_digest from whole),
lines as (select r, unnest(string_split(low, chr(10))) as line from lowered),
hashed as (select distinct r, sha256({spelled('p')}) as digest from (select r, {plain('line')} as p from lines) where p <> ''),
named as (select r, string_agg(distinct licence, ',' order by licence) as licences from hashed join known using (digest) where notice group by r)
select doc_id, text_digest, known.licence as text_licence, coalesce(licences, '') as line_licences
from marked left join known on known.digest = text_digest left join named using (r)"""
