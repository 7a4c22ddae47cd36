"""License recognition by sentences, in DataFrame functions only.

A text is cut into sentences, each is normalised to lower-case letters and digits
with single spaces, holders' names in it give way to placeholders, and known ones get an
identifier. A licence is recognised where its rule, a sequence of identifiers, stands in
the text's sequence of known sentences. Longer rules go first and take their
sentences, so a rule inside another one's place doesn't count; and more than a few
unknown sentences between two known ones part them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of several licences. Fixed values, as all texts below.
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "See the License for the specific language governing permissions and limitations under the License.",
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
)
_MIT_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_MIT_0 = (_MIT[0].replace(", subject to the following conditions:", "."),)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
)
_ISC_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_NO_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
)
_GNU_NO_WARRANTY = (
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
)


def _gnu(what: str, license_: str, version: str, stop: str) -> tuple[str, ...]:
    """The notice of a licence of the GNU family, with the sign that its texts have behind 'software' and 'Foundation'."""
    return (
        f"This {what} is free software{stop[0]} you can redistribute it and/or modify it under the terms of the {license_} as published by the Free Software Foundation{stop[1]} either version {version} of the License, or (at your option) any later version.",
    )


#: Identifiers that a line 'SPDX-License-Identifier: ...' may name, and the licence each stands for.
SPDX = {
    k: k.removesuffix("-only").removesuffix("-or-later")
    for k in "Apache-2.0 MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 "
    "CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC0-1.0 Unlicense Zlib BSL-1.0".split()
}
#: Rules: a licence's name and its sentences in order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", _APACHE[:2]),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", ("This project is licensed under the Apache License 2.0.",)),
    ("MIT", ("Released under the MIT License.",)),
    ("MIT", ("Licensed under the MIT License.",)),
    ("MIT", ("This project is licensed under the MIT License.",)),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_NO_WARRANTY),
    ("MIT-0", _MIT_0),
    ("MIT-0", _MIT_0 + _MIT_NO_WARRANTY),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_NO_WARRANTY),
    ("0BSD", (_ISC[0].replace(", provided that the above copyright notice and this permission notice appear in all copies.", "."),)),
    ("0BSD", (_ISC[0].replace(", provided that the above copyright notice and this permission notice appear in all copies.", "."), *_ISC_NO_WARRANTY)),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_NO_WARRANTY),
    ("BSD-3-Clause", (*_BSD, _BSD_NAMES)),
    ("BSD-3-Clause", (*_BSD, _BSD_NAMES, *_BSD_NO_WARRANTY)),
    ("Zlib", _ZLIB),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("GPL-2.0", ("This work is licensed under the GNU General Public License, version 2.",)),
    ("AGPL-3.0", ("This work is licensed under the GNU Affero General Public License, version 3.",)),
    *(
        (name, _gnu(what, license_, version, stop) + more)
        for name, what, license_, version, stop in (
            ("GPL-3.0", "program", "GNU General Public License", "3", ":,"),
            ("GPL-2.0", "program", "GNU General Public License", "2", ";;"),
            ("LGPL-3.0", "library", "GNU Lesser General Public License", "3", ";;"),
            ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1", ";;"),
            ("AGPL-3.0", "program", "GNU Affero General Public License", "3", ":,"),
        )
        for more in ((), tuple(x.format(what) for x in _GNU_NO_WARRANTY))
    ),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    )),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.",)),
    ("CC-BY-SA-4.0", ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",)),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-NC-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",)),
    ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0.",)),
    ("CC0-1.0", ("This work is dedicated to the public domain under CC0 1.0.",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    )),
    *((name, (f"SPDX-License-Identifier: {spdx}",)) for spdx, name in SPDX.items()),
)
#: Ends of sentences: white space behind these marks, a colon at a line's end, or a line without a letter or digit.
MARKS = ".!?"
#: In normalised sentences: spellings, list numbers, and names of holders.
CANON = (
    ("licence", "license"),
    (r"\bhttps\b", "http"),
    ("^(?:[0-9]{1,2}|[a-c]|i{1,3}) (redistributions|neither) ", r"\1 "),
    ("^neither the names? of .+ nor the names? of (?:its|their|the) contributors? may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^this software is provided by .+ as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("^in no event shall .+ be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
    ("^(the software is provided as is and) .+ disclaims? all warranties", r"\1 the author disclaims all warranties"),
    ("^in no event shall .+ be liable for any special", "in no event shall the author be liable for any special"),
)
#: Unknown sentences that may stand between two of a rule.
MAX_GAP = 4


def normalised(sentence: str) -> str:
    """Runs of other characters than ASCII letters and digits as one space, ends trimmed, placeholders for holders."""
    out = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    for pattern, new in CANON:
        out = re.sub(pattern, new, out)
    return out


def _parts(sentence: str) -> list[str]:
    """A rule's sentence is cut as texts are: 'v. 2.0' is two."""
    return [x for x in map(normalised, re.split(rf"(?<=[{MARKS}])\s+", sentence)) if x]


def _ways(rule: tuple[str, ...]) -> list[list[str]]:
    """A rule's normalised sentences; and with those joined that a colon joins, where texts run on behind it."""
    ways = [[p for s in rule for p in _parts(s)]]
    for k, sentence in enumerate(rule[:-1]):
        if sentence.endswith(":"):
            ways.append([p for s in (*rule[:k], f"{sentence} {rule[k + 1]}", *rule[k + 2 :]) for p in _parts(s)])
    return ways


#: Known sentences and their identifiers; rules as texts of identifiers, the longest first.
SENTENCES: dict[str, int] = {}
PATTERNS: list[tuple[str, str]] = []
for _name, _rule in RULES:
    for _way in _ways(_rule):
        PATTERNS.append((_name, "".join(f"<{SENTENCES.setdefault(p, len(SENTENCES) + 1)}>" for p in _way)))
PATTERNS.sort(key=lambda x: -x[1].count("<"))

#: One of these stands in every rule, so texts without any need no cutting.
CUES = ("licen[cs]e", "permission", "redistribut", "public domain", "freely")
CUE = "(?i)" + "|".join(c.replace(" ", "[^A-Za-z0-9]+") for c in CUES)
assert all(any(re.search(CUE, s) for s in rule) for _, rule in RULES)

#: What ends a paragraph; what stands between words.
PARAGRAPH, OTHER = r"\n[^a-z0-9\n]*\n", "[^a-z0-9]+"
#: Short forms in holders' names, whose full stop ends no sentence.
FIRMS = r"\b(inc|ltd|co|corp|llc)[.]"


def _marked(text: Column) -> Column:
    """In lower case, with an empty line behind each mark that ends a sentence."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    plain = F.regexp_replace(plain, FIRMS, "$1")
    return F.regexp_replace(F.regexp_replace(plain, rf"(?<=[{MARKS}])[ \t-\r]+", "\n\n"), r":[ \t]*\n", ":\n\n")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def recognised(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``sentence_ids``, ``n_license_sentences`` and ``licenses``.

    ``sentence_ids`` lists the known sentences in order ("<3><4>", a bar where more than
    :data:`MAX_GAP` unknown ones part them; "" if none) and ``licenses`` the recognised
    licences, sorted and separated by commas. What stands between two ends of
    sentences is one sentence if it is known, over any number of lines, with or without its first line
    (a title); otherwise each of its lines is one. Whole texts of any length are read;
    null and empty ones have none. Rows that are repeated give repeated results, an empty
    table none; a kept column with the name of an output gives way.
    Everything stays in the document's row.
    """
    known = F.create_map(*(F.lit(x) for sentence, i in SENTENCES.items() for x in (sentence, f"<{i}>")))

    def named(sentence: Column) -> Column:
        for pattern, new in CANON:
            sentence = F.regexp_replace(sentence, pattern, new.replace("\\1", "$1"))
        return known[sentence]

    def cut(paragraph: Column) -> Column:
        lines = F.array_remove(F.transform(F.split(paragraph, "\n"), lambda x: F.trim(F.regexp_replace(x, OTHER, " "))), "")
        joined = lambda x: named(F.array_join(x, " "))
        each = lambda x: F.transform(x, lambda y: F.coalesce(named(y), F.lit("-")))
        rest = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
        whole = lambda x, w, t: F.when(w.isNotNull(), F.array(w)).when(t.isNotNull(), F.concat(each(F.slice(x, 1, 1)), F.array(t))).otherwise(each(x))
        return _let(lines, lambda x: _let(F.struct(joined(x).alias("w"), F.when(F.size(x) > 2, joined(rest(x))).alias("t")), lambda k: whole(x, k["w"], k["t"])))

    keep = tuple(c for c in keep if c not in ("sentence_ids", "n_license_sentences", "licenses"))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), F.col(f"`{text}`").alias("text"))
    units = F.array_join(F.flatten(F.transform(F.split(_marked(F.col("text")), PARAGRAPH), cut)), "")
    parted = F.trim(F.replace(F.regexp_replace(units, f"-{{{MAX_GAP + 1},}}", "|"), F.lit("-"), F.lit("")), F.lit("|"))
    rows = rows.withColumn("sentence_ids", F.when(F.col("text").rlike(CUE), parted).otherwise(F.lit(""))).drop("text")
    rules = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for n, p in PATTERNS))
    start = F.struct(F.col("sentence_ids").alias("s"), F.array().cast("array<string>").alias("names"))

    def taken(state: Column, rule: Column) -> Column:
        new = F.struct(F.replace(state["s"], rule["p"], F.lit("*")).alias("s"), F.array_append(state["names"], rule["n"]).alias("names"))
        return F.when(F.contains(state["s"], rule["p"]), new).otherwise(state)

    found = F.aggregate(rules, start, taken, lambda s: F.array_join(F.array_sort(F.array_distinct(s["names"])), ","))
    return rows.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "sentence_ids",
        (F.length("sentence_ids") - F.length(F.replace("sentence_ids", F.lit("<"), F.lit("")))).cast("long").alias("n_license_sentences"),
        F.when(F.col("sentence_ids") == "", "").otherwise(found).alias("licenses"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canon_sql(x: str) -> str:
    for pattern, new in CANON:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return x


_RULES_SQL = ", ".join(f"{{'s': {_quoted(p)}, 'names': [{_quoted(n)}]}}" for n, p in PATTERNS)
ORACLE = rf"""
WITH known(sentence, id) AS (VALUES {", ".join(f"({_quoted(s)}, '<{i}>')" for s, i in SENTENCES.items())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN regexp_matches(text, {_quoted(CUE)}) THEN text ELSE '' END AS t FROM documents),
marked AS (
  SELECT rid, regexp_replace(regexp_replace(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10)), '{FIRMS}', '\1', 'g'),
    '([{MARKS}])[ \t-\r]+', '\1' || chr(10) || chr(10), 'g'), ':[ \t]*\n', ':' || chr(10) || chr(10), 'g') AS t FROM d WHERE t <> ''
), paragraphs AS (
  SELECT rid, unnest(range(len(p))) AS pp, list_filter(list_transform(string_split(unnest(p), chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM (SELECT rid, regexp_split_to_array(t, '\n[^a-z0-9\n]*\n') AS p FROM marked)
), looked AS (
  SELECT rid, pp, lines, w.id AS w, t.id AS t FROM (SELECT *, {_canon_sql("array_to_string(lines, ' ')")} AS whole,
    CASE WHEN len(lines) > 2 THEN {_canon_sql("array_to_string(lines[2:], ' ')")} END AS rest FROM paragraphs)
  LEFT JOIN known w ON w.sentence = whole LEFT JOIN known t ON t.sentence = rest
), units AS (
  SELECT rid, pp, 0 AS nth, w AS id FROM looked WHERE w IS NOT NULL
  UNION ALL SELECT rid, pp, 1, t FROM looked WHERE w IS NULL AND t IS NOT NULL
  UNION ALL SELECT rid, pp, nth, coalesce(k.id, '-') FROM (
    SELECT rid, pp, unnest(range(len(x))) AS nth, unnest(x) AS line FROM (SELECT rid, pp, CASE WHEN t IS NOT NULL THEN lines[1:1] ELSE lines END AS x FROM looked WHERE w IS NULL))
    LEFT JOIN known k ON k.sentence = {_canon_sql("line")}
), ids AS (
  SELECT rid, trim(replace(regexp_replace(string_agg(id, '' ORDER BY pp, nth), '-{{{MAX_GAP + 1},}}', '|', 'g'), '-', ''), '|') AS ids FROM units GROUP BY rid
), names AS (
  SELECT rid, list_reduce(list_prepend({{'s': ids, 'names': []::VARCHAR[]}}, [{_RULES_SQL}]), lambda a, r:
    CASE WHEN contains(a.s, r.s) THEN {{'s': replace(a.s, r.s, '*'), 'names': list_concat(a.names, r.names)}} ELSE a END).names AS names FROM ids WHERE ids <> ''
)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, (length(coalesce(ids, '')) - length(replace(coalesce(ids, ''), '<', '')))::BIGINT AS n_license_sentences,
  coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses
FROM d LEFT JOIN ids USING (rid) LEFT JOIN names USING (rid)
"""
