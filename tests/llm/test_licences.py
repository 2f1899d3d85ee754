"""License scans of whole licences, named holders and long odd texts."""

from shelfmark.llm import license_scan

ISC = """Copyright (c) 2020, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
REGENTS = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 * 3. Neither the name of the University nor the names of its contributors
 *    may be used to endorse or promote products derived from this software
 *    without specific prior written permission.
 *
 * THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
 * ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
 * ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
 * FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
 * DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
 * OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
 * HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
 * LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
 * OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
 * SUCH DAMAGE.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
LGPL = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
TEXTS = {
    ISC: "ISC",
    REGENTS: "BSD-3-Clause",
    MPL: "MPL-2.0",
    LGPL: "LGPL-2.1-or-later",
    UNLICENSE: "Unlicense",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "This project is licensed under the ISC License.": "ISC",
    "This Source Code Form is subject to a licence": None,
    "Permission to use this is granted": None,
    REGENTS.partition(" * 2.")[0]: None,
}


def test_licences(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: r["primary_license"] for r in license_scan.scan_licenses(rows).collect()}
    assert [found[i] for i in range(len(TEXTS))] == list(TEXTS.values())


def test_long_rows_of_marks(spark):
    """Rows of marks, blanks, stops and breaks of any length are read, and a notice after them is found."""
    texts = [mark * 100_000 + "\nReleased under the MIT License." for mark in ("# ", "| ", "- ", "//", "/*", "; ", "%", "\n", "\n# ", ". ", ":\n", " ")]
    rows = spark.createDataFrame(list(enumerate(["license\n" + t for t in texts])), "doc_id long, text string")
    found = license_scan.scan_licenses(rows).collect()
    assert [r["licenses"] for r in found] == ["MIT"] * len(texts)


def test_every_sentence_has_a_hint():
    import re

    assert all(re.search(license_scan.HINT, s) for _, s in license_scan.SENTENCES)
    assert len({s for _, s in license_scan.SENTENCES}) == len(license_scan.SENTENCES) >= 100
    known = {i for i, _ in license_scan.SENTENCES}
    assert all(i.strip("[]") in known for _, rule in license_scan.RULES for i in rule.split())
