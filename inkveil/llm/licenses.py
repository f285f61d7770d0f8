"""License scans by sentence rules, with DataFrame functions only.

A text is cut into pieces at line ends, after . ! ? before white space, and after the ':' that ends a known
sentence; a piece is lower-cased and every run of other characters than letters and digits, comment marks
too, becomes one space. A known sentence is one piece or several lines' pieces in a row, with no blank line
and no sentence end between them, so wrapped texts count; of two that begin at one place the longer is taken.
Known sentences give identifiers;
the identifiers of a document, in order, are matched against ordered rules, each a run of identifiers. The
first rule of the list that occurs is the document's license; all rules that occur are kept beside it.

Defined cases: null and empty texts have no sentences, an empty list and a null license; repeated sentences
count each; very long texts are scanned whole; rows that repeat an id each give a row; an empty table gives no rows;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkveil.llm.common import table

#: Known sentences by identifier, as their licenses word them.
SENTENCES = {
    "mit-release": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-see": "Licensed under the MIT License, see LICENSE.",
    "mit-file": "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
    "mit-use": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-v2-see": "Licensed under the Apache License, Version 2.0, see LICENSE.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-use": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Rules in order of precedence: name, license, run of sentence identifiers.
RULES = [
    ("mit-whole", "MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("mit-text", "MIT", "mit-grant mit-notice mit-warranty"),
    ("apache-2.0-whole", "Apache-2.0", "apache-header apache-copy apache-disclaimer apache-limits"),
    ("apache-2.0-header", "Apache-2.0", "apache-header apache-disclaimer"),
    ("gpl-3.0-header", "GPL-3.0-or-later", "gpl3-free gpl-warranty"),
    ("gpl-2.0-header", "GPL-2.0-or-later", "gpl2-free gpl-warranty"),
    ("agpl-3.0-header", "AGPL-3.0-or-later", "agpl3-free"),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", "lgpl21-free"),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", "lgpl3-free"),
    ("bsd-3-clause-whole", "BSD-3-Clause", "bsd-redistribution bsd-source bsd-binary bsd-endorse"),
    ("bsd-3-clause-text", "BSD-3-Clause", "bsd-redistribution bsd-endorse"),
    ("bsd-2-clause-whole", "BSD-2-Clause", "bsd-redistribution bsd-source bsd-binary"),
    ("isc-text", "ISC", "isc-grant"),
    ("gpl-3.0-work", "GPL-3.0-only", "gpl3-work"),
    ("gpl-3.0-free", "GPL-3.0-or-later", "gpl3-free"),
    ("gpl-2.0-free", "GPL-2.0-or-later", "gpl2-free"),
    ("apache-2.0-licensed", "Apache-2.0", "apache-licensed"),
    ("apache-2.0-notice", "Apache-2.0", "apache-header"),
    ("apache-2.0-see", "Apache-2.0", "apache-v2-see"),
    ("mit-released", "MIT", "mit-release"),
    ("mit-see", "MIT", "mit-see"),
    ("mit-file", "MIT", "mit-file"),
    ("mit-style", "MIT", "mit-use"),
    ("bsd-style", "BSD-3-Clause", "bsd-use"),
    ("mit-licensed", "MIT", "mit-licensed"),
    ("mit-permission", "MIT", "mit-grant"),
    ("bsd-redistribution", "BSD-2-Clause", "bsd-redistribution"),
    ("mpl-2.0", "MPL-2.0", "mpl2-form"),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", "cc-by-nc-licensed"),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", "cc-by-nc-work"),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", "cc-by-sa-licensed"),
    ("cc-by-4.0", "CC-BY-4.0", "cc-by-licensed"),
    ("cc-by-4.0-work", "CC-BY-4.0", "cc-by-work"),
    ("unlicense", "Unlicense", "unlicense"),
]
#: Each known sentence holds one of these, lower-cased; texts without any are not cut at all.
HINTS = ("licen", "permission", "warrant", "redistribut", "public domain", "liab", "mozilla")


def _pieces(sentence: str) -> list[str]:
    """The normal forms of what a known sentence is cut into; only v. 2.0 and the like give more than one."""
    return [n for s in re.split(r"\n|(?<=[.!?])\s+", sentence) if (n := re.sub("[^a-z0-9]+", " ", s.lower()).strip())]


NORMAL = {_pieces(s)[-1] if len(_pieces(s)) == 1 else re.sub("[^a-z0-9]+", " ", s.lower()).strip(): k for k, s in SENTENCES.items()}
assert len(NORMAL) == len(SENTENCES) and all(any(h in n for h in HINTS) for n in NORMAL)


#: Any known sentence, longest first, with a space or one line end between its words, from one cut to another.
KNOWN = "(?<![^\\n])(?:" + "|".join(n.replace(" ", "[ \\n]") for n in sorted(NORMAL, key=lambda n: (-len(n), n))) + ")(?![^\\n])"
#: The last words of the known sentences that end in ':'.
COLON = "|".join(sorted({n.split()[-1] for n, k in NORMAL.items() if SENTENCES[k].endswith(":")}))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; null where there is no hint of a license."""
    low = F.lower(text)
    # "v. 2.0" is no end of a sentence, wrapped or not. Two line ends are a cut that no sentence spans, one is a line's.
    cut = F.regexp_replace(F.regexp_replace(low, r"\bv\.\s+(?:[^a-z0-9\s]+\s+)?(?=\d)", "v "), r"[.!?]\s+", "\n\n")
    cut = F.regexp_replace(cut, rf"\b({COLON}):\s+", "$1\n\n")
    cut = F.trim(F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9\n]+", " "), " *\n *", "\n"))
    known = F.create_map(*[F.lit(x) for pair in NORMAL.items() for x in pair])
    ids = F.transform(F.regexp_extract_all(cut, F.lit(KNOWN), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    hint = F.contains(low, F.lit(HINTS[0]))
    for h in HINTS[1:]:
        hint = hint | F.contains(low, F.lit(h))
    return F.when(hint, F.filter(ids, lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids, rules, license of every document."""
    d = docs.select("doc_id", F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>")).alias("ids"))
    d = d.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"))
    row = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    hit = lambda ids: F.contains(row, F.lit(f" {ids} "))
    rules = F.concat_ws(" ", *[F.when(hit(ids), F.lit(name)) for name, _, ids in RULES])
    license = F.coalesce(*[F.when(hit(ids), F.lit(spdx)) for _, spdx, ids in RULES])
    return d.select("doc_id", "n_known", "sentence_ids", rules.alias("rules"), license.alias("license"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"{q(n)}: {q(k)}" for n, k in NORMAL.items())
    hints = " OR ".join(f"contains(low, {q(h)})" for h in HINTS)
    rules = ", ".join(f"CASE WHEN contains(row, {q(f' {ids} ')}) THEN {q(name)} END" for name, _, ids in RULES)
    names = ", ".join(f"CASE WHEN contains(row, {q(f' {ids} ')}) THEN {q(spdx)} END" for _, spdx, ids in RULES)
    return rf"""
WITH t AS (SELECT doc_id, lower(text) AS low FROM documents),
c AS (SELECT doc_id, CASE WHEN {hints} THEN list_filter(list_transform(string_split(regexp_replace(regexp_replace(low, '\bv\. (\d)', 'v \1', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)),
    lambda s: (MAP {{{pairs}}})[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) END AS ids FROM t),
d AS (SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ' '), '') AS sentence_ids FROM c),
e AS (SELECT *, ' ' || sentence_ids || ' ' AS row FROM d)
SELECT doc_id, n_known, sentence_ids, concat_ws(' ', {rules}) AS rules, coalesce({names}) AS license FROM e"""


QUERIES, ORACLES = {"op9_licenses": op9_licenses}, {"op9_licenses": _sql()}
