"""License scans: normalised sentences become known sentence ids, whose sequence ordered rules then read.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed sentences of public licences and their usual notices: id and text, of which only letters and digits count.
SENTENCES = (
    ("apache_short", "Licensed under the Apache License, Version 2.0"),
    ("apache_the", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("apache_use", "you may not use this file except in compliance with the License"),
    ("apache_copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_copy_https", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache_asf", "The ASF licenses this file to You under the Apache License, Version 2.0 (the License)"),
    ("apache_title", "Apache License Version 2.0, January 2004"),
    ("mit_short", "Released under the MIT License"),
    ("mit_licensed", "Licensed under the MIT License"),
    ("mit_this", "This project is licensed under the MIT License"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit0_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit_warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit_liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd_redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd_names", "Neither the name of HOLDER nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_names_one", "The name of HOLDER may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd_warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("bsd_liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("bsd_file", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc_grant_and", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zero_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_warranty", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("gpl2_free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2_only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl2_title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl3_short", "This work is licensed under the GNU General Public License version 3"),
    ("gpl_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl3_title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl_details", "See the GNU General Public License for more details"),
    ("gpl_received", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl21_free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl21_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl3_free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3_program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl_hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("agpl_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl_title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl_subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl_copy_http", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl_title", "Mozilla Public License Version 2.0"),
    ("epl2_notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2_short", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl2_title", "Eclipse Public License - v 2.0"),
    ("epl1_notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("unlicense_free", "This is free and unencumbered software released into the public domain"),
    ("unlicense_anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib_origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("boost_short", "Distributed under the Boost Software License, Version 1.0"),
    ("boost_title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("cc0_title", "CC0 1.0 Universal"),
    ("cc0_short", "Licensed under CC0 1.0"),
    ("ccby4_short", "Licensed under CC BY 4.0"),
    ("ccbysa4_short", "Licensed under CC BY-SA 4.0"),
    ("ccbync4_short", "Licensed under CC BY-NC 4.0"),
    ("ccbynd4_short", "Licensed under CC BY-ND 4.0"),
    ("ccby4_work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ccbysa4_work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ccbync4_work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("ccbynd4_work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("apache_grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl3_body", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("gpl2_body", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("agpl_body", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl3_body", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("mpl_body", "This License does not grant any rights in the trademarks, service marks, or logos of any Contributor (except as may be necessary to comply with the notice requirements in Section 3.4)"),
    ("boost_grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("reserved", "All rights reserved"),
)
#: Fixed licences and the identifiers that files name them by.
IDENTIFIERS = (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("MIT-0", "MIT-0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("0BSD", "0BSD"),
    ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"),
    ("MPL-2.0", "MPL-2.0"), ("EPL-1.0", "EPL-1.0"), ("EPL-2.0", "EPL-2.0"), ("Unlicense", "Unlicense"), ("Zlib", "Zlib"), ("BSL-1.0", "BSL-1.0"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
)
#: Ordered rules: a licence, and the sentences that say so, in this order, with others between them or not.
RULES = (
    ("0BSD", ("zero_grant",)),
    ("AGPL-3.0", ("agpl_free",)),
    ("AGPL-3.0", ("agpl_body",)),
    ("AGPL-3.0", ("agpl_title",)),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("apache_the", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_the", "apache_use", "apache_copy_https")),
    ("Apache-2.0", ("apache_asf", "apache_use")),
    ("Apache-2.0", ("apache_grant",)),
    ("Apache-2.0", ("apache_title",)),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names_one")),
    ("BSD-4-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_advertising")),
    ("BSD-style", ("bsd_file",)),
    ("BSL-1.0", ("boost_short",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_title",)),
    ("CC-BY-4.0", ("ccby4_short",)),
    ("CC-BY-4.0", ("ccby4_work",)),
    ("CC-BY-NC-4.0", ("ccbync4_short",)),
    ("CC-BY-NC-4.0", ("ccbync4_work",)),
    ("CC-BY-ND-4.0", ("ccbynd4_short",)),
    ("CC-BY-ND-4.0", ("ccbynd4_work",)),
    ("CC-BY-SA-4.0", ("ccbysa4_short",)),
    ("CC-BY-SA-4.0", ("ccbysa4_work",)),
    ("CC0-1.0", ("cc0_short",)),
    ("CC0-1.0", ("cc0_title",)),
    ("EPL-1.0", ("epl1_notice",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("EPL-2.0", ("epl2_short",)),
    ("EPL-2.0", ("epl2_title",)),
    ("GPL-2.0", ("gpl2_free",)),
    ("GPL-2.0", ("gpl2_only",)),
    ("GPL-2.0", ("gpl2_body",)),
    ("GPL-2.0", ("gpl2_title",)),
    ("GPL-3.0", ("gpl3_short",)),
    ("GPL-3.0", ("gpl_free",)),
    ("GPL-3.0", ("gpl3_body",)),
    ("GPL-3.0", ("gpl3_title",)),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_and",)),
    ("LGPL-2.1", ("lgpl21_free",)),
    ("LGPL-2.1", ("lgpl21_title",)),
    ("LGPL-3.0", ("lgpl3_free",)),
    ("LGPL-3.0", ("lgpl3_program",)),
    ("LGPL-3.0", ("lgpl3_body",)),
    ("LGPL-3.0", ("lgpl3_title",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_this",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT-0", ("mit0_grant", "mit_warranty")),
    ("MPL-2.0", ("mpl_subject", "mpl_copy")),
    ("MPL-2.0", ("mpl_subject", "mpl_copy_http")),
    ("MPL-2.0", ("mpl_body",)),
    ("MPL-2.0", ("mpl_title",)),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("Zlib", ("zlib_grant", "zlib_origin")),
    ("all-rights-reserved", ("reserved",)),
    *((name, (f"spdx_{i}",)) for name, i in IDENTIFIERS),
)
#: Licences that begin alike, the one with the most sentences first, and the sentence with which each of their texts begins: such a
#: text is used up by the first of them that it fits, so that each text tells one of them and two texts two.
USED_UP, BEGIN = ("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause"), "bsd_redistribution"
#: A holder's name has so many words at most where a sentence names one.
HOLDER_WORDS = 12
#: Before the identifiers of a file; alternatives and exceptions follow on the same line, within so many characters.
TAG, TAG_LINE = "spdx-license-identifier:", 1_000

#: Ends of sentences: a line's end, or one of these marks before white space or the text's end.
END = r"[.!?;:]+(?:[\x20\t\r\n]+|$)|[\r\n]+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised sentence to id.
KNOWN = {normal(s): i for i, s in (*SENTENCES, *((f"spdx_{i}", f"SPDX-License-Identifier: {i}") for _, i in IDENTIFIERS))}
#: Each known sentence has one of these.
SIGNS = ("license", "software", "redistribution", "trademarks", "mpl", "program", "reserved", "cc0", "advertising")


def _tagged(lower: Column) -> Column:
    """The text with each identifier of an expression behind a tag of its own; what follows WITH is an exception, and no licence."""
    line = rf"(?<={TAG}[^\r\n]{{0,{TAG_LINE}}})"
    plain = F.regexp_replace(lower, rf"{line}[ \t]+with[ \t]+[a-z0-9.-]+", "")
    each = F.regexp_replace(plain, rf"{line}[ \t)]+(?:or|and)[ \t(]+", f"\n{TAG} ")
    return F.when(F.contains(lower, F.lit(TAG)), each).otherwise(lower)


def _unnamed(words: Column) -> Column:
    """Words with the holder's name in the sentences that have one left out."""
    own = rf"(?:[a-z0-9]+[\x20\n]){{1,{HOLDER_WORDS}}}?"
    for before, behind in (("neither the name of", "nor the names of"), ("the name of", "may not be used to endorse")):
        a, b = (x.replace(" ", r"[\x20\n]") for x in (before, behind))
        words = F.regexp_replace(words, rf"(?<![a-z0-9]){a}[\x20\n]{own}{b}(?![a-z0-9])", f"{before} holder {behind}")
    return words


def _sentence_ids(text: Column) -> Column:
    """Known ids in the order of the text.

    A known sentence is found in the sequence of words from one end to another; within it, ends count as white
    space, so it may be wrapped over lines, behind comment marks or not. Of two that overlap the first counts, of two that begin alike the longer.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(F.regexp_replace(_tagged(lower), END, "\n"), r"[^a-z0-9\n]+", " ")
    words = _unnamed(F.regexp_replace(words, r"^\x20| ?\n[\x20\n]*|\x20$", "\n"))
    each = sorted((s.replace(" ", r"[\x20\n]") for s in KNOWN), key=len, reverse=True)
    found = F.regexp_extract_all(words, F.lit(r"(?<![^\n])(?:" + "|".join(each) + r")(?![^\n])"), F.lit(0))
    known = F.create_map(*[F.lit(x) for item in KNOWN.items() for x in item])
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    return F.when(lower.rlike("|".join(SIGNS)), ids)


def _fits(listed: Column, rules, name: str) -> Column:
    """Whether a rule of the name reads its ids, in their order, in the marked list."""
    out = F.lit(False)
    for n, ids in rules:
        if n == name:
            out |= listed.like("%" + "%".join(f"<{i}>".replace("_", r"\_") for i in ids) + "%")
    return out


def _one_text(rules, name: str) -> str:
    """A pattern of the marked ids of one text that a rule of the name fits: none of them begins another text, or was used up."""
    between = f"(?:<(?!{BEGIN}>|used>)[^<>]+>)*?"
    return "|".join(between.join(f"<{i}>" for i in ids) for n, ids in rules if n == name and ids[0] == BEGIN)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, n_sentences, sentences, licenses) for every row of (doc_id, text).

    sentences: the known ids in text order, comma-joined, n_sentences how many. licenses: the
    licences of the rules that fit, each once, by name, comma-joined. A text of a licence that begins like others is the first of them that it fits; another such
    text beside it counts for itself. Of an SPDX expression each licence is told.
    Null and empty texts: 0 and empty strings. Repeated rows each give a row. Empty table: no rows.
    """
    ids = docs.select("doc_id", F.coalesce(_sentence_ids(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.array().cast("array<string>")).alias("_ids"))
    listed = F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">"))
    row = ids.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentences"), listed.alias("_listed"))
    names = sorted({name for name, _ in rules})
    told = {n: _fits(F.col("_listed"), rules, n) for n in names}
    rest = F.col("_listed")
    for n in (n for n in USED_UP if n in told):
        spent = F.regexp_replace(rest, _one_text(rules, n), "<used>")
        others = [(m, ids_) for m, ids_ in rules if m == n and ids_[0] != BEGIN]
        told[n] = (spent != rest) | _fits(F.col("_listed"), others, n)
        rest = spent
    found = F.when(F.col("n_sentences") > 0, F.concat_ws(",", *[F.when(told[n], F.lit(n)) for n in names])).otherwise("")
    return row.select("doc_id", "n_sentences", "sentences", found.alias("licenses"))


def op8_license_scans(docs: DataFrame) -> DataFrame:
    return scan(docs)


# SQL goes another way: the parts between ends are joined again, one by one, as long as a known sentence begins so;
# of sentences that overlap the first counts, then the longest; and rules are read along the numbered ids.
def _rules_sql() -> str:
    out = []
    for k, (name, ids) in enumerate(r for r in RULES if r[1][0] != BEGIN):
        steps = [f"SELECT n, min(a) AS a FROM told WHERE id = '{ids[0]}' GROUP BY n"]
        for i in ids[1:]:
            steps.append(f"SELECT t.n, min(t.a) AS a FROM told t JOIN ({steps[-1]}) p ON t.n = p.n AND t.a > p.a WHERE t.id = '{i}' GROUP BY t.n")
        out.append(f"SELECT n, '{name}' AS name FROM ({steps[-1]}) r{k}")
    return " UNION ".join(out)


_GAP, _NAME = "[^a-z0-9]+", f"(?:[a-z0-9]+[^a-z0-9]+){{1,{HOLDER_WORDS}}}?"
SQL = rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())}),
lowered AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
-- lines with a tag: behind it, exceptions go and each alternative becomes a line
tagged AS (
  SELECT n, doc_id, CASE WHEN contains(t, '{TAG}') THEN array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN contains(x, '{TAG}') THEN
    x[: strpos(x, '{TAG}') + {len(TAG) - 1}] || regexp_replace(regexp_replace(x[strpos(x, '{TAG}') + {len(TAG)} :], '[ \t]+with[ \t]+[a-z0-9.-]+', '', 'g'), '[ \t)]+(or|and)[ \t(]+', chr(10) || '{TAG} ', 'g') ELSE x END), chr(10)) ELSE t END AS t
  FROM lowered),
numbered AS (
  SELECT n, doc_id, regexp_replace(regexp_replace(t, '(^|[^a-z0-9])neither{_GAP}the{_GAP}name{_GAP}of{_GAP}{_NAME}nor{_GAP}the{_GAP}names{_GAP}of($|[^a-z0-9])', '\1neither the name of holder nor the names of\2', 'g'),
    '(^|[^a-z0-9])the{_GAP}name{_GAP}of{_GAP}{_NAME}may{_GAP}not{_GAP}be{_GAP}used{_GAP}to{_GAP}endorse($|[^a-z0-9])', '\1the name of holder may not be used to endorse\2', 'g') AS t
  FROM tagged),
split AS (SELECT n, regexp_split_to_array(t, '{END}') AS p FROM numbered),
each AS (SELECT n, unnest(p) AS s, unnest(range(len(p))) AS k FROM split),
parts AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY k) AS i, f FROM (SELECT n, k, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ') AS f FROM each) WHERE f <> ''),
heads AS (SELECT DISTINCT f FROM parts WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', f || ' '))),
grown AS (
  SELECT n, i AS a, i AS b, f AS s FROM parts JOIN heads USING (f)
  UNION ALL
  SELECT g.n, g.a, p.i, g.s || ' ' || p.f FROM grown g JOIN parts p ON p.n = g.n AND p.i = g.b + 1 WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(sentence || ' ', g.s || ' ' || p.f || ' '))),
found AS (SELECT n, a, b, id FROM grown JOIN known ON s = sentence),
told AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.n = f.n AND ((o.a < f.a AND o.b >= f.a) OR (o.a = f.a AND o.b > f.b)))),
lists AS (SELECT n, count(*) AS c, string_agg(id, ',' ORDER BY a) AS ids FROM told GROUP BY n),
texts AS (SELECT n, s, '<' || string_agg(id, '><' ORDER BY a) || '>' AS ids FROM (SELECT *, count(*) FILTER (WHERE id = '{BEGIN}') OVER (PARTITION BY n ORDER BY a) AS s FROM told) WHERE s > 0 GROUP BY n, s),
fits AS ({_rules_sql()} UNION
  SELECT n, CASE WHEN ids LIKE '%<bsd_source>%<bsd_binary>%<bsd_advertising>%' THEN 'BSD-4-Clause' WHEN ids LIKE '%<bsd_source>%<bsd_binary>%<bsd_names>%' OR ids LIKE '%<bsd_source>%<bsd_binary>%<bsd_names_one>%' THEN 'BSD-3-Clause' ELSE 'BSD-2-Clause' END
  FROM texts WHERE ids LIKE '%<bsd_source>%<bsd_binary>%'),
named AS (SELECT n, string_agg(name, ',' ORDER BY name) AS names FROM fits GROUP BY n)
SELECT doc_id, coalesce(c, 0) AS n_sentences, coalesce(ids, '') AS sentences, coalesce(names, '') AS licenses FROM numbered LEFT JOIN lists USING (n) LEFT JOIN named USING (n)
"""
