import duckdb

from lectern.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2019, Example Corp.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Example Corp. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.

THIS SOFTWARE IS PROVIDED BY EXAMPLE CORP. AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
_PARTS = "bsd_grant,bsd_source,bsd_binary,bsd_names,bsd_as_is"
ROWS = [
    (20, BSD, f"reserved,{_PARTS}", "BSD-3-Clause", ""),
    (21, BSD.replace("2. Redist", "A sentence of somebody else.\n2. Redist"), f"reserved,{_PARTS}", "", f"reserved,{_PARTS}"),
    (26, "Copyright 2020 A.\nAll rights reserved.", "reserved", "All-Rights-Reserved", ""),
    (27, "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "zlib_credit", "", "zlib_credit"),
    (28, "Version 2, June 1991", "gpl_v2_date", "", "gpl_v2_date"),
    (22, BSD.replace("Corp. nor", "Corp nor"), f"reserved,{_PARTS}", "BSD-3-Clause", ""),
    (23, "SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl21plus_ref", "LGPL-2.1-or-later", ""),
    (24, "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Somebody\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "agpl_title,agpl_v3_date,gnu_verbatim", "AGPL-3.0-only", ""),
    (25, MIT.replace("The above", "Some other words here.\nThe above"), "mit_name,mit_grant,mit_notice,mit_as_is,mit_liability", "MIT", "mit_grant,mit_notice,mit_as_is,mit_liability"),
    (1, MIT, "mit_name,mit_grant,mit_notice,mit_as_is,mit_liability", "MIT", ""),
    (2, "Some words here.\nReleased under the MIT License.\nMore text.", "mit_ref", "MIT", ""),
    (3, "x. Licensed under CC BY-NC 4.0. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", "ccbync4_ref,apache2_ref", "Apache-2.0,CC-BY-NC-4.0", ""),
    (4, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd_source", "", "bsd_source"),
    (5, "The licence of a poet", "", "", ""),
    (6, None, "", "", ""),
    (7, "", "", "", ""),
    (None, "spdx-license-identifier: mit", "mit_ref", "MIT", ""),
    (8, "word " * 100000 + ".\nThis work is licensed under the GNU General Public License, version 3.", "gpl3_ref", "GPL-3.0-only", ""),
    (2, "Some words here.\nReleased under the MIT License.\nMore text.", "mit_ref", "MIT", ""),
]


def test_rules_and_oracle(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t, *_ in ROWS], "doc_id long, text string, licences string, rest int")
    got = sorted((tuple(r) for r in licenses.licences(df).collect()), key=str)
    assert got == sorted(((d, s, l, u) for d, _, s, l, u in ROWS), key=str)
    assert licenses.licences(df.limit(0)).count() == 0
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(d, t) for d, t, *_ in ROWS])
    assert sorted(c.execute(licenses.ORACLE).fetchall(), key=str) == got
    plan = licenses.licences(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_sentence_alone_is_found(spark):
    """The marks that texts are chosen by miss no sentence: each holds one within a word, and each is found when it is all of a text."""
    assert all(any(m in word for m in licenses.MARKS for word in sentence.split()) for sentence in licenses.SENTENCES)
    rows = [(k, sentence.capitalize() + ".") for k, sentence in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.sentences for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == list(licenses.SENTENCES.values())
