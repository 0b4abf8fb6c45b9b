"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences; each is normalised to lower-case ASCII letters and digits and mapped to the
identifier of a known licence sentence. The identifiers of a document, in order, are matched against
ordered rules; what a rule matches is taken out, so that a later, weaker rule can't use it again. Other sentences leave a
gap in the sequence, which a rule spans only where it says so; copyright lines and numbers of clauses leave none. Names of
holders are replaced before the look-up. Known sentences that no rule took are reported, since they hint at an unknown licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "the mit license": "mit_name",
    "mit license": "mit_name",
    "the mit license mit": "mit_name",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "this work is licensed under the mit license": "mit_ref",
    "spdx license identifier mit": "mit_ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "spdx license identifier isc": "isc_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "released under the bsd license": "bsd_ref",
    "licensed under the bsd 3 clause license": "bsd3_ref",
    "spdx license identifier bsd 3 clause": "bsd3_ref",
    "spdx license identifier bsd 2 clause": "bsd2_ref",
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_head",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_head",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "this work is licensed under the apache license version 2 0": "apache2_ref",
    "released under the apache license version 2 0": "apache2_ref",
    "spdx license identifier apache 2 0": "apache2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_hope",
    "see the gnu general public license for more details": "gpl_see",
    "you should have received a copy of the gnu general public license along with this program": "gpl_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "released under the gnu general public license version 3": "gpl3_ref",
    "spdx license identifier gpl 3 0 only": "gpl3_ref",
    "spdx license identifier gpl 3 0 or later": "gpl3plus_ref",
    "spdx license identifier gpl 2 0 only": "gpl2_ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_head",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_obtain",
    "spdx license identifier mpl 2 0": "mpl2_head",
    "licensed under cc by 4 0": "ccby4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_ref",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_ref",
    "licensed under cc0 1 0": "cc0_ref",
    "all rights reserved": "reserved",
    "this software is provided by the copyright holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "in no event shall the copyright holder be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd_liability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc_liability",
    "isc license": "isc_name",
    "bsd 2 clause license": "bsd2_name",
    "bsd 3 clause license": "bsd3_name",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache_obtain",
    "http www apache org licenses license 2 0": "apache_url",
    "apache license": "apache_title",
    "version 2 0 january 2004": "apache_version",
    "apache license version 2 0 january 2004": "apache2_title",
    "http www apache org licenses": "apache_url",
    "terms and conditions for use reproduction and distribution": "apache_terms",
    "gnu general public license": "gpl_title",
    "version 3 29 june 2007": "gpl_v3_date",
    "version 2 june 1991": "gpl_v2_date",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license": "lgpl_title",
    "version 2 1 february 1999": "lgpl_v21_date",
    "gnu affero general public license": "agpl_title",
    "version 3 19 november 2007": "agpl_v3_date",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu_verbatim",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21plus_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3plus_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3plus_grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl_hope",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl_copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3plus_grant",
    "see the gnu affero general public license for more details": "agpl_see",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl_copy",
    "spdx license identifier lgpl 2 1 only": "lgpl21_ref",
    "spdx license identifier lgpl 2 1 or later": "lgpl21plus_ref",
    "spdx license identifier lgpl 3 0 only": "lgpl3_ref",
    "spdx license identifier lgpl 3 0 or later": "lgpl3plus_ref",
    "spdx license identifier agpl 3 0 only": "agpl3_ref",
    "spdx license identifier agpl 3 0 or later": "agpl3plus_ref",
    "spdx license identifier gpl 2 0 or later": "gpl2plus_ref",
    "spdx license identifier epl 2 0": "epl2_ref",
    "spdx license identifier unlicense": "unlicense_ref",
    "spdx license identifier zlib": "zlib_ref",
    "spdx license identifier bsl 1 0": "bsl1_ref",
    "spdx license identifier cc0 1 0": "cc0_ref",
    "mozilla public license version 2 0": "mpl2_title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_grant",
    "eclipse public license v 2 0": "epl2_title",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_anyone",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib_origin",
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required": "zlib_credit",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib_altered",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "boost software license version 1 0 august 17th 2003": "bsl1_title",
    "distributed under the boost software license version 1 0": "bsl1_ref",
}

# What stands for the name of a holder in known sentences (pattern of a normalised sentence, what it becomes).
HOLDERS = [
    ("^neither the names? of .+ nor the names of (its|their|the|any) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^the names? of .+ may not be used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("^this software is provided by .+ as is and any express or implied warranties", "this software is provided by the copyright holder as is and any express or implied warranties"),
    ("^in no event shall .+ be liable for any direct indirect incidental special exemplary", "in no event shall the copyright holder be liable for any direct indirect incidental special exemplary"),
]

# Ordered rules; a sequence of identifiers (a trailing ? may be absent, ~ may be other sentences) and the licence it shows.
RULES = [
    ("mit_name? ~ mit_grant mit_notice mit_as_is mit_liability?", "MIT"),
    ("isc_name? ~ isc_grant mit_as_is? isc_as_is? isc_liability?", "ISC"),
    ("bsd3_name? ~ reserved? bsd_grant bsd_source bsd_binary bsd_names bsd_as_is? bsd_liability?", "BSD-3-Clause"),
    ("bsd2_name? ~ reserved? bsd_grant bsd_source bsd_binary bsd_as_is? bsd_liability?", "BSD-2-Clause"),
    ("zlib_as_is zlib_liability zlib_grant zlib_origin zlib_credit? zlib_altered zlib_notice", "Zlib"),
    ("unlicense_grant unlicense_anyone", "Unlicense"),
    ("apache2_head apache_comply? apache_obtain? apache_url? apache_as_is? apache_see?", "Apache-2.0"),
    ("apache_title apache_version apache_url? apache_terms?", "Apache-2.0"),
    ("apache2_title apache_url? apache_terms?", "Apache-2.0"),
    ("agpl_title agpl_v3_date ~ gnu_verbatim", "AGPL-3.0-only"),
    ("lgpl_title gpl_v3_date ~ gnu_verbatim", "LGPL-3.0-only"),
    ("lgpl_title lgpl_v21_date ~ gnu_verbatim", "LGPL-2.1-only"),
    ("gpl_title gpl_v3_date ~ gnu_verbatim", "GPL-3.0-only"),
    ("gpl_title gpl_v2_date ~ gnu_verbatim", "GPL-2.0-only"),
    ("gpl3_title ~ gnu_verbatim?", "GPL-3.0-only"),
    ("gpl2_title ~ gnu_verbatim?", "GPL-2.0-only"),
    ("agpl3plus_grant gpl_hope? agpl_see? agpl_copy?", "AGPL-3.0-or-later"),
    ("lgpl3plus_grant lgpl_hope? gpl_hope? lgpl_see? lgpl_copy?", "LGPL-3.0-or-later"),
    ("lgpl21plus_grant lgpl_hope? lgpl_see? lgpl_copy?", "LGPL-2.1-or-later"),
    ("gpl3plus_grant gpl_hope? gpl_see? gpl_copy?", "GPL-3.0-or-later"),
    ("gpl2plus_grant gpl_hope? gpl_see? gpl_copy?", "GPL-2.0-or-later"),
    ("mpl2_title? mpl2_head mpl2_obtain?", "MPL-2.0"),
    ("mpl2_title", "MPL-2.0"),
    ("epl2_title? epl2_grant", "EPL-2.0"),
    ("epl2_title", "EPL-2.0"),
    ("bsl1_title", "BSL-1.0"),
    ("bsl1_ref", "BSL-1.0"),
    ("mit_ref", "MIT"),
    ("mit_name", "MIT"),
    ("isc_ref", "ISC"),
    ("apache2_ref apache_comply? apache_obtain? apache_url? apache_as_is? apache_see?", "Apache-2.0"),
    ("gpl3_ref", "GPL-3.0-only"),
    ("gpl3plus_ref", "GPL-3.0-or-later"),
    ("gpl2_ref", "GPL-2.0-only"),
    ("gpl2plus_ref", "GPL-2.0-or-later"),
    ("lgpl21_ref", "LGPL-2.1-only"),
    ("lgpl21plus_ref", "LGPL-2.1-or-later"),
    ("lgpl3_ref", "LGPL-3.0-only"),
    ("lgpl3plus_ref", "LGPL-3.0-or-later"),
    ("agpl3_ref", "AGPL-3.0-only"),
    ("agpl3plus_ref", "AGPL-3.0-or-later"),
    ("epl2_ref", "EPL-2.0"),
    ("unlicense_ref", "Unlicense"),
    ("zlib_ref", "Zlib"),
    ("isc_name", "ISC"),
    ("bsd3_name", "BSD-3-Clause"),
    ("bsd2_name", "BSD-2-Clause"),
    ("bsd3_ref", "BSD-3-Clause"),
    ("bsd2_ref", "BSD-2-Clause"),
    ("bsd_ref", "BSD"),
    ("ccbync4_ref", "CC-BY-NC-4.0"),
    ("ccbysa4_ref", "CC-BY-SA-4.0"),
    ("ccby4_ref", "CC-BY-4.0"),
    ("cc0_ref", "CC0-1.0"),
    ("reserved", "All-Rights-Reserved"),
]

#: Every known sentence holds one of these within a word, which a test asserts; other texts need no cutting.
MARKS = (
    "licen", "permission", "redistribut", "warrant", "liable", "reserved", "mpl", "unencumbered", "misrepresented", "reproduction", "compiled", "acknowledgment",
    "january", "february", "june", "november", "distribution",
)
#: Shows its licence only where no known sentence of another one is left over.
ALONE = "reserved"

# A sentence ends before anything but a small letter, and not after these abbreviations. A line break inside a sentence: before a small letter, or between lines of capitals.
_WRAPS = ((r"\n[ \t#*/;-]*([a-z(])", " "), (r"([A-Z ,\"]{20})\n[ \t#*/;-]*([A-Z ]{5})", None))
_END = (r"([.!?])[ \t\r]+([^a-z \t\r])", r"(?i)\b(corp|inc|ltd|co)\.")
_OTHER = r"[^a-z0-9]+"
#: Normalised sentences that leave no gap: none, numbers of clauses, copyright lines.
_CLEAR = r"^([0-9]{1,2}|[a-z]|[ivx]{1,4}|(c )?copyright .*|)$"


def _pattern(rule: str) -> str:
    return "".join("_?" if x == "~" else f"(<{x[:-1]}>)?" if x.endswith("?") else f"<{x}>" for x in rule.split())


def licences(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, sentences, licences, unmatched) for every row of docs(doc_id, text), as strings.

    sentences: the identifiers of known licence sentences in order, joined by commas; licences: what the
    rules found, in the order of the rules, each once, "all rights reserved" only where no other known sentence is left over; unmatched: known sentences that no rule took.
    All are empty where nothing is known, as for null and empty texts. Repeated rows stay; null ids are
    passed on; an empty table gives an empty result; other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(low, F.lit(m))
    joined = F.regexp_replace(F.regexp_replace(text, _WRAPS[0][0], " $1"), _WRAPS[1][0], "$1 $2")
    cut = F.split(F.regexp_replace(F.regexp_replace(joined, _END[1], "$1"), _END[0], "$1\n$2"), "\n")
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def plain(sentence: Column) -> Column:
        out = F.trim(F.regexp_replace(F.lower(sentence), _OTHER, " "))
        for pattern, name in HOLDERS:
            out = F.regexp_replace(out, pattern, name)
        return out

    mark = lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.rlike(_CLEAR), F.lit("")).otherwise(F.lit("_")))
    rows = docs.select(F.col("doc_id").cast("long"), F.when(marked, F.transform(F.transform(cut, plain), mark)).alias("marks"))
    rows = rows.select("doc_id", F.coalesce(F.filter("marks", lambda x: x != ""), F.array().cast("array<string>")).alias("marks"))
    sequence = F.array_join(F.transform("marks", lambda x: F.when(x == "_", x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))), "")
    rows = rows.select("doc_id", F.array_join(F.filter("marks", lambda x: x != "_"), ",").alias("sentences"), F.regexp_replace(sequence, "_+", "_").alias("rest"), F.array().cast("array<string>").alias("found"))
    for rule, licence in RULES:
        hit = F.col("rest").rlike(_pattern(rule))
        if rule == ALONE:
            hit = hit & ~F.contains(F.regexp_replace("rest", _pattern(rule), ""), F.lit("<"))
        rows = rows.select("doc_id", "sentences", F.when(hit, F.regexp_replace("rest", _pattern(rule), "|")).otherwise(F.col("rest")).alias("rest"), F.when(hit, F.array_append("found", F.lit(licence))).otherwise(F.col("found")).alias("found"))
    unmatched = F.array_join(F.regexp_extract_all("rest", F.lit("<([a-z0-9_]+)>")), ",")
    return rows.select("doc_id", "sentences", F.array_join(F.array_distinct("found"), ",").alias("licences"), unmatched.alias("unmatched"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences that the sentences of every document show."""
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in SENTENCES.items()) + "}"
    cut = f"regexp_replace(regexp_replace(coalesce(text, ''), {q(_WRAPS[0][0])}, ' \\1', 'g'), {q(_WRAPS[1][0])}, '\\1 \\2', 'g')"
    cut = f"string_split(regexp_replace(regexp_replace({cut}, {q(_END[1])}, '\\1', 'g'), {q(_END[0])}, '\\1' || chr(10) || '\\2', 'g'), chr(10))"
    mark_any = " OR ".join(f"contains(lower(coalesce(text, '')), {q(m)})" for m in MARKS)
    plain = f"trim(regexp_replace(lower(s), {q(_OTHER)}, ' ', 'g'))"
    for pattern, name in HOLDERS:
        plain = f"regexp_replace({plain}, {q(pattern)}, {q(name)})"
    mark = f"coalesce(known[s], CASE WHEN regexp_matches(s, {q(_CLEAR)}) THEN '' ELSE '_' END)"
    out = f"""WITH k AS (SELECT {known} AS known),
cut AS (SELECT doc_id, CASE WHEN {mark_any} THEN list_filter(list_transform(list_transform({cut}, lambda s: {plain}), lambda s: {mark}), lambda x: x <> '') ELSE CAST([] AS VARCHAR[]) END AS marks FROM documents, k),
r0 AS (SELECT doc_id, coalesce(array_to_string(list_filter(marks, lambda x: x <> '_'), ','), '') AS sentences, regexp_replace(coalesce(array_to_string(list_transform(marks, lambda x: CASE WHEN x = '_' THEN x ELSE '<' || x || '>' END), ''), ''), '_+', '_', 'g') AS rest, CAST([] AS VARCHAR[]) AS found FROM cut)"""
    for i, (rule, licence) in enumerate(RULES):
        hit = f"regexp_matches(rest, {q(_pattern(rule))})"
        if rule == ALONE:
            hit = f"({hit} AND NOT contains(regexp_replace(rest, {q(_pattern(rule))}, '', 'g'), '<'))"
        out += f",\nr{i + 1} AS (SELECT doc_id, sentences, CASE WHEN {hit} THEN regexp_replace(rest, {q(_pattern(rule))}, '|', 'g') ELSE rest END AS rest, CASE WHEN {hit} AND NOT list_contains(found, {q(licence)}) THEN list_append(found, {q(licence)}) ELSE found END AS found FROM r{i})"
    return out + f"\nSELECT doc_id, sentences, coalesce(array_to_string(found, ','), '') AS licences, coalesce(array_to_string(regexp_extract_all(rest, '<([a-z0-9_]+)>', 1), ','), '') AS unmatched FROM r{len(RULES)}"


ORACLE = _sql()
