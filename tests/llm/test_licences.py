"""Verbatim licence notices, wrapped and commented, against the operator and its SQL."""

import textwrap

import duckdb
import pandas as pd
import pytest

from hourgrid.llm import license_scan

MIT = """MIT License

Copyright (c) 2021 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Copyright (c) 2004-2010 by Some Consortium
Copyright (c) 1995-2003 by Another One. All rights reserved.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD = """Copyright (c) 1999, Some Owner. All rights reserved.
Copyright (c) 2003, Other Owner. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

GNU = """some program - what it does
Copyright (C) 2007  Some Author

This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}.  If not, see <https://www.gnu.org/licenses/>."""


def gnu(name, version, stop, either, what="program"):
    return GNU.format(name=name, version=version, stop=stop, either=either, what=what)


APACHE = """Copyright 2019 Some Company

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

CC0 = """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."""

CC_BY = "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."

NOTICES = {
    "MIT": MIT,
    "ISC": ISC,
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format(ENDORSE),
    "GPL-2.0-or-later": gnu("General Public License", "2", ";", "; either"),
    "GPL-3.0-or-later": gnu("General Public License", "3", ":", ", either"),
    "LGPL-2.1-or-later": gnu("Lesser General Public License", "2.1", ";", "; either", "library"),
    "LGPL-3.0-or-later": gnu("Lesser General Public License", "3", ":", ", either"),
    "AGPL-3.0-or-later": gnu("Affero General Public License", "3", ":", ", either"),
    "Apache-2.0": APACHE,
    "MPL-2.0": MPL,
    "Unlicense": UNLICENSE,
    "CC0-1.0": CC0,
    "CC-BY-4.0": CC_BY,
}


def laid_out(text, prefix, width, before="", after=""):
    lines = []
    for line in text.split("\n"):
        lines += [prefix + part for part in textwrap.wrap(line, width)] or [prefix.rstrip()]
    return before + "\n".join(lines) + after


def styles(text):
    yield text
    yield laid_out(text, "", 72)
    yield laid_out(text, "// ", 60, after="\n\nint main() { return 0; }\n")
    yield laid_out(text, "# ", 41, before="#!/bin/sh\n#\n", after="\n\nset -e\n")
    yield laid_out(text, " * ", 76, before="/*\n", after="\n */\nvoid f(void);\n")
    yield laid_out(text, "  ", 72).replace("\n", "\r\n")


def by_sql(rows):
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    found = connection.execute(license_scan.checking_sql()).fetchall()
    return sorted(tuple(row) for row in found)


def by_spark(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "licences", "sentences"]
    return sorted(tuple(r[c] for c in columns) for r in license_scan.scan(docs).collect())


def test_verbatim_notices_in_every_layout(spark):
    rows, expected = [], []
    for name, text in NOTICES.items():
        for laid in styles(text):
            rows.append((len(rows), laid))
            expected.append(name)
    got = by_spark(spark, rows)
    assert [r[1] for r in got] == expected
    assert by_sql(rows) == got


def test_reserved_rights_belong_to_their_notice_only(spark):
    notice = MIT.split("\n\n", 2)[2]
    rows = [
        (0, f"Copyright (c) 2020 X. All rights reserved.\n{notice}"),
        (1, f"{notice}\n\nAll rights reserved."),
        (2, "Copyright (c) 2020 X. All rights reserved.\nint main();"),
        (3, "Copyright (c) 2020 X. All rights reserved.\n\nUnauthorized copying of this file, via any medium, is strictly prohibited without permission."),
        (4, "// Copyright 2020 X\n// Licensed under the MIT License.\n// All rights reserved"),
    ]
    got = by_spark(spark, rows)
    assert [r[1] for r in got] == ["MIT", "MIT,proprietary", "proprietary", "proprietary", "MIT,proprietary"]
    assert by_sql(rows) == got


@pytest.mark.parametrize("wide", [False, True])
def test_defined_cases_equal_the_sql(spark, wide):
    rows = [
        (1, None), (None, "Released under the MIT License."), (1, "Released under the MIT License."),
        (1, "Released under the MIT License."), (2, ""), (3, "\n\n\n"), (4, "x " * 300_000 + "All rights reserved."),
        (5, "\n" * 20_000 + "All rights reserved" + "\n" * 20_000), (6, "лицензия\nкопия\n" * 5000 + "ISC license"),
        (7, "* SPDX-License-Identifier: MIT\n */"), (8, "copyright (c) 2020\ncopyright (c) 2021\ncopyright © 1999 a.\nAll rights\nreserved"),
        (9, "Copyright\tThe X Authors. All rights reserved.\r\n\r\nIn the public\r\ndomain"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if wide:
        for name in ("low", "hit", "wrapped", "by_line", "licences", "sentences"):
            docs = docs.selectExpr("*", f"'clash' AS {name}")
    columns = ["doc_id", "licences", "sentences"]
    got = [tuple(r[c] for c in columns) for r in license_scan.scan(docs).collect()]
    typed = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    connection = duckdb.connect()
    connection.register("documents", typed)
    expected = connection.execute(license_scan.checking_sql()).fetchall()
    assert sorted(got, key=repr) == sorted(map(tuple, expected), key=repr)
    assert license_scan.scan(docs.where("false")).count() == 0
