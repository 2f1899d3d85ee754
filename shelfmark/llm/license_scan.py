"""License scans by recognising sentences.

A text is cut into sentences: comment marks at line starts go, a paragraph's
lines are joined, and a sentence ends at a stop before white space or with its
paragraph. Each sentence is normalised (lower case, marks and white space to
single spaces) and looked up among the known licence sentences; of a sentence
that is not known, the lines are looked up one by one, since a notice is often
a line of its own. The identifiers found, in order, are matched against
ordered rules: a licence is recognised where its rule's identifiers follow
each other (those in brackets may be missing). Names of holders inside a
sentence are put to one form before the lookup.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences (normalised) by identifier; an identifier can have several forms.
SENTENCES = [
    ("apache-2.0/line", "licensed under the apache license version 2 0"),
    ("bsd-3/line", "released under the bsd 3 clause license"),
    ("cc-by-4.0/line", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0/line", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0/line", "licensed under cc by sa 4 0"),
    ("cc0/line", "released under cc0 1 0 universal"),
    ("gpl-2.0/line", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0/line", "this work is licensed under the gnu general public license version 3"),
    ("mit/line", "released under the mit license"),
    ("rights/line", "all rights reserved"),
    (
        "mit/grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
    ),
    ("mit/grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "mit/notice",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the software",
    ),
    (
        "mit/notice",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all"
        " copies or substantial portions of the software",
    ),
    ("mit/notice", "the above copyright notice and this permission notice shall be included in all copies"),
    (
        "mit/warranty",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    ("mit/warranty", "the software is provided as is without warranty of any kind"),
    (
        "mit/liability",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in"
        " an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
        " other dealings in the software",
    ),
    (
        "bsd/use",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
    ),
    (
        "bsd/use",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met 1",
    ),
    ("bsd/use", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd/source",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer",
    ),
    ("bsd/source", "redistributions of source code must retain the above copyright notice"),
    (
        "bsd/binary",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd/binary", "redistributions in binary form must reproduce the above copyright notice"),
    (
        "bsd/endorse",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ),
    ("bsd/endorse", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (
        "bsd/warranty",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties"
        " including but not limited to the implied warranties of merchantability and fitness for a particular purpose are"
        " disclaimed",
    ),
    (
        "bsd/liability",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special"
        " exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        " loss of use data or profits or business interruption however caused and on any theory of liability whether in"
        " contract strict liability or tort including negligence or otherwise arising in any way out of the use of this"
        " software even if advised of the possibility of such damage",
    ),
    (
        "apache/grant",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with"
        " the license",
    ),
    ("apache/may", "you may not use this file except in compliance with the license"),
    ("apache/copy", "you may obtain a copy of the license at"),
    ("apache/copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache/copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    (
        "apache/unless",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
        " on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("apache/see", "see the license for the specific language governing permissions and limitations under the license"),
    (
        "isc/grant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "isc/grant",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "isc/warranty",
        "the software is provided as is and the author disclaims all warranties with regard to this software including"
        " all implied warranties of merchantability and fitness",
    ),
    (
        "isc/liability",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages"
        " whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other"
        " tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "0bsd/grant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("mpl/terms", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl/copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl/copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense/free", "this is free and unencumbered software released into the public domain"),
    (
        "unlicense/anyone",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or"
        " as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "unlicense/dedicate",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all"
        " copyright interest in the software to the public domain",
    ),
    (
        "unlicense/benefit",
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    ),
    (
        "unlicense/intend",
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
        " this software under copyright law",
    ),
    ("unlicense/more", "for more information please refer to http unlicense org"),
    ("unlicense/more", "for more information please refer to https unlicense org"),
    ("zlib/warranty", "this software is provided as is without any express or implied warranty"),
    (
        "zlib/liability",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    (
        "zlib/grant",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to"
        " alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "zlib/origin",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "zlib/credit",
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is"
        " not required",
    ),
    (
        "zlib/altered",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original"
        " software",
    ),
    ("zlib/notice", "this notice may not be removed or altered from any source distribution"),
    (
        "bsl/grant",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license the software to use reproduce display distribute execute and"
        " transmit the software and to prepare derivative works of the software and to permit third parties to whom the"
        " software is furnished to do so all subject to the following",
    ),
    ("bsl/line", "distributed under the boost software license version 1 0"),
    (
        "apache/copyright-grant",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"
        " non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"
        " publicly display publicly perform sublicense and distribute the work and such derivative works in source or"
        " object form",
    ),
    (
        "apache/contributions",
        "unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by you to"
        " the licensor shall be under the terms and conditions of this license without any additional terms or conditions",
    ),
    (
        "apache/trademarks",
        "this license does not grant permission to use the trade names trademarks service marks or product names of the"
        " licensor except as required for reasonable and customary use in describing the origin of the work and"
        " reproducing the content of the notice file",
    ),
    (
        "gnu/verbatim",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    (
        "gpl-2/designed",
        "the licenses for most software are designed to take away your freedom to share and change it",
    ),
    (
        "gpl-2/contrast",
        "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"
        " to make sure the software is free for all its users",
    ),
    ("gpl-3/copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    (
        "gpl-3/designed",
        "the licenses for most software and other practical works are designed to take away your freedom to share and"
        " change the works",
    ),
    (
        "gpl-3/contrast",
        "by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions"
        " of a program to make sure it remains free software for all its users",
    ),
    (
        "agpl-3/copyleft",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works"
        " specifically designed to ensure cooperation with the community in the case of network server software",
    ),
    (
        "lgpl-3/incorporates",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the"
        " gnu general public license supplemented by the additional permissions listed below",
    ),
    (
        "lgpl/free-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation either version 2 1 of the license or at your option"
        " any later version",
    ),
    (
        "lgpl/free-3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation either version 3 of the license or at your option"
        " any later version",
    ),
    (
        "lgpl/free-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation either version 3 of the license or at your option"
        " any later version",
    ),
    (
        "lgpl/hope",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose",
    ),
    ("lgpl/see", "see the gnu lesser general public license for more details"),
    (
        "lgpl/received",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    (
        "lgpl/received",
        "you should have received a copy of the gnu lesser general public license along with this program",
    ),
    (
        "agpl/free-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general"
        " public license as published by the free software foundation either version 3 of the license or at your option"
        " any later version",
    ),
    ("agpl/see", "see the gnu affero general public license for more details"),
    (
        "agpl/received",
        "you should have received a copy of the gnu affero general public license along with this program",
    ),
    ("cc-by-4.0/line", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-4.0/line", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0/line", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa-4.0/line", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0/line", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-4.0/line", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0/line", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (
        "gpl/free-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 2 of the license or at your option any"
        " later version",
    ),
    (
        "gpl/free-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any"
        " later version",
    ),
    ("gpl/free", "this program is free software you can redistribute it and or modify it"),
    (
        "gpl/hope",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose",
    ),
    ("gpl/hope", "this program is distributed in the hope that it will be useful"),
    ("gpl/see", "see the gnu general public license for more details"),
    (
        "gpl/received",
        "you should have received a copy of the gnu general public license along with this program",
    ),
]
#: Names of licences by identifier, of which notices of one line are made, and their short forms.
NAMES = [
    ("mit/line", "mit license", "mit"),
    ("apache-2.0/line", "apache license version 2 0", "apache 2 0"),
    ("bsd-2/line", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd-3/line", "bsd 3 clause license", "bsd 3 clause"),
    ("isc/line", "isc license", "isc"),
    ("mpl-2.0/line", "mozilla public license version 2 0", "mpl 2 0"),
    ("gpl-2.0/line", "gnu general public license version 2", "gpl 2 0 only"),
    ("gpl-3.0/line", "gnu general public license version 3", "gpl 3 0 only"),
    ("gpl-2.0+/line", "gnu general public license version 2 or later", "gpl 2 0 or later"),
    ("gpl-3.0+/line", "gnu general public license version 3 or later", "gpl 3 0 or later"),
    ("lgpl-2.1/line", "gnu lesser general public license version 2 1", "lgpl 2 1 only"),
    ("lgpl-3.0/line", "gnu lesser general public license version 3", "lgpl 3 0 only"),
    ("agpl-3.0/line", "gnu affero general public license version 3", "agpl 3 0 only"),
    ("unlicense/line", "unlicense", "unlicense"),
    ("zlib/line", "zlib license", "zlib"),
    ("bsl/line", "boost software license version 1 0", "bsl 1 0"),
]
#: Notices of one line about a licence, by its name and by its short form.
NOTICES = [
    "released under the {name}", "licensed under the {name}", "distributed under the {name}", "this project is licensed under the {name}",
    "this software is licensed under the {name}", "this software is released under the {name}", "this work is licensed under the {name}",
    "spdx license identifier {short}",
]
SENTENCES += [
    (i, s) for i, name, short in NAMES for s in (n.format(name=name, short=short) for n in NOTICES) if s not in {x for _, x in SENTENCES}
]
#: Where a sentence names its holder, and the form under which it is known.
HOLDERS = [
    ("^neither the name of .* nor the names of (?:its|their) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
    ("^this software is provided by .* as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    ("^in no event shall .* be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
]
#: Rules, each an ordered sequence of sentence identifiers; longer ones of a licence come first.
RULES = [
    ("MIT", "mit/grant mit/notice mit/warranty [mit/liability]"),
    ("MIT", "mit/line"),
    ("ISC", "isc/grant isc/warranty [isc/liability]"),
    ("ISC", "isc/line"),
    ("0BSD", "0bsd/grant isc/warranty [isc/liability]"),
    ("MPL-2.0", "mpl/terms [mpl/copy]"),
    ("MPL-2.0", "mpl-2.0/line"),
    ("Unlicense", "unlicense/free unlicense/anyone [unlicense/dedicate] [unlicense/benefit] [unlicense/intend] [mit/warranty] [mit/liability] [unlicense/more]"),
    ("Unlicense", "unlicense/line"),
    ("Zlib", "zlib/warranty zlib/liability zlib/grant [zlib/origin] [zlib/credit] [zlib/altered] [zlib/notice]"),
    ("Zlib", "zlib/line"),
    ("BSL-1.0", "bsl/grant"),
    ("BSL-1.0", "bsl/line"),
    ("Apache-2.0", "apache/copyright-grant apache/contributions apache/trademarks"),
    ("GPL-2.0", "gnu/verbatim gpl-2/designed gpl-2/contrast"),
    ("GPL-3.0", "gnu/verbatim gpl-3/copyleft gpl-3/designed gpl-3/contrast"),
    ("AGPL-3.0", "gnu/verbatim agpl-3/copyleft"),
    ("LGPL-3.0", "gnu/verbatim lgpl-3/incorporates"),
    ("LGPL-2.1-or-later", "lgpl/free-2.1 lgpl/hope [lgpl/see] [lgpl/received]"),
    ("LGPL-3.0-or-later", "lgpl/free-3 lgpl/hope [lgpl/see] [lgpl/received]"),
    ("LGPL-3.0-or-later", "lgpl/free-3 gpl/hope [lgpl/see] [lgpl/received]"),
    ("AGPL-3.0-or-later", "agpl/free-3 gpl/hope [agpl/see] [agpl/received]"),
    ("LGPL-2.1", "lgpl-2.1/line"),
    ("LGPL-3.0", "lgpl-3.0/line"),
    ("AGPL-3.0", "agpl-3.0/line"),
    ("GPL-2.0-or-later", "gpl-2.0+/line"),
    ("GPL-3.0-or-later", "gpl-3.0+/line"),
    ("BSD-2-Clause", "bsd-2/line"),
    ("BSD-3-Clause", "bsd/use bsd/source bsd/binary bsd/endorse [bsd/warranty] [bsd/liability]"),
    ("BSD-2-Clause", "bsd/use bsd/source bsd/binary [bsd/warranty] [bsd/liability]"),
    ("BSD-3-Clause", "bsd-3/line"),
    ("Apache-2.0", "apache/grant apache/copy [apache/unless] [apache/see]"),
    ("Apache-2.0", "apache-2.0/line [apache/may] [apache/copy]"),
    ("GPL-3.0-or-later", "gpl/free-3 gpl/hope [gpl/see] [gpl/received]"),
    ("GPL-2.0-or-later", "gpl/free-2 gpl/hope [gpl/see] [gpl/received]"),
    ("GPL-3.0", "gpl-3.0/line"),
    ("GPL-2.0", "gpl-2.0/line"),
    ("GPL", "gpl/free gpl/hope"),
    ("CC-BY-4.0", "cc-by-4.0/line"),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0/line"),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0/line"),
    ("CC0-1.0", "cc0/line"),
    ("LicenseRef-all-rights-reserved", "rights/line"),
]
#: Comment marks, bullets and blanks at the start of a line: one flat class, so that a row of marks may have any length.
LEADER = r"(^|\n)[ \t/#*;%|-]+"
#: A sentence ends with its paragraph, at a colon that ends a line, or at a stop, question or exclamation mark before white space.
END = r"\n[ \t\r]*\n[\x20\x09-\x0D]*|:[ \t\r]*\n[\x20\x09-\x0D]*|[.!?]+[\x20\x09-\x0D]+"
_MARKS = "[^a-z0-9]+"


def _hints() -> list[str]:
    """A few long words, of which every known sentence has one: texts without any hold no known sentence."""
    open_, found = [set(w for w in s.split() if len(w) > 5) or {s} for _, s in SENTENCES], []
    while open_:
        counts = Counter(w for words in open_ for w in words)
        found.append(max(sorted(counts), key=counts.get))
        open_ = [words for words in open_ if found[-1] not in words]
    return found


HINT = "(?i)" + "|".join(s.replace(" ", "[^a-z0-9]+") for s in sorted(_hints()))


def normalised(sentence: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(sentence), _MARKS, " "))
    for pattern, known in HOLDERS:
        # Sentences without a holder's place are told by their beginning.
        out = F.regexp_replace(out, pattern, known)
    return out


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = F.create_map(*[F.lit(x) for i, s in SENTENCES for x in (s, i)])
    known = list(dict.fromkeys(s for _, s in SENTENCES))
    ids = lambda forms: F.transform(F.filter(forms, lambda n: n.isin(known)), lambda n: F.element_at(table, n))

    def of(x: Column) -> Column:
        # A sentence that is known stands alone; of one that is not, lines may be.
        return ids(
            F.when(x["n"].isin(known), F.array(x["n"]))
            .when(F.contains(x["s"], F.lit("\n")), F.transform(F.split(x["s"], "\n"), normalised))
            .otherwise(F.array().cast("array<string>"))
        )

    parts = F.split(F.regexp_replace(text, LEADER, "$1"), END)
    each = F.transform(parts, lambda s: F.struct(s.alias("s"), normalised(s).alias("n")))
    return F.when(text.rlike(HINT), F.flatten(F.transform(each, of))).otherwise(F.array().cast("array<string>"))


def _pattern(rule: str) -> str:
    """A rule as a regular expression over ``<identifier><identifier>...``."""
    parts = "".join(f"(<{i[1:-1]}>)?" if i[0] == "[" else f"<{i}>" for i in rule.split())
    return parts.replace(".", "[.]").replace("+", "[+]")


def _needed(rule: str) -> list[str]:
    return [i for i in rule.split() if i[0] != "["]


def _longer(rule: str) -> list[str]:
    """Rules that begin with all that this one needs and go on: where they match, this one does not."""
    own = _needed(rule)
    return [r for _, r in RULES if _needed(r)[: len(own)] == own and len(_needed(r)) > len(own)]


def _by_length() -> list[int]:
    return sorted(range(len(RULES)), key=lambda k: (-len(_needed(RULES[k][1])), k))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses, primary_license of every row.

    ``licenses`` names, sorted and joined by ``|``, the licences whose rule is
    in the text; the rule that needs most sentences gives ``primary_license``
    (ties: order of RULES). Null and empty texts, and texts without a known
    sentence, have 0, empty strings and a null primary licence. Rows are
    scanned on their own: repeated rows alike, an empty table gives no rows.
    """
    # The scan runs once per row, before the rules look at it.
    found = docs.select("doc_id", F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>")).alias("ids"))
    line = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    lined = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), line.alias("_line"))
    hits, line = [], F.col("_line")
    for name, rule in RULES:
        rest = line
        for other in _longer(rule):
            rest = F.regexp_replace(rest, _pattern(other), "")
        # A rule is tried where its first needed sentence is.
        begins = F.contains(line, F.lit(f"<{_needed(rule)[0]}>"))
        hits.append(F.when(begins & rest.rlike(_pattern(rule)), F.lit(name)))
    # Rules in the order in which they give the primary licence.
    tried = F.when(line != "", F.array_compact(F.array(*[hits[k] for k in _by_length()])))
    told = lined.withColumn("_hits", F.coalesce(tried, F.array().cast("array<string>")))
    return told.select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.array_join(F.array_sort(F.array_distinct("_hits")), "|").alias("licenses"),
        F.get("_hits", 0).alias("primary_license"),
    )


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES)
    cases = []
    for name, rule in RULES:
        rest = "line"
        for other in _longer(rule):
            rest = f"regexp_replace({rest}, '{_pattern(other)}', '', 'g')"
        cases.append(f"WHEN regexp_matches({rest}, '{_pattern(rule)}') THEN '{name}'")
    names = ", ".join(f"CASE {c} END" for c in cases)
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, form in HOLDERS:
        norm = f"regexp_replace({norm}, '{pattern}', '{form}')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS pos FROM (
    SELECT doc_id, string_split_regex(regexp_replace(text, '{LEADER}', '\1', 'g'), '{END}') AS ps FROM documents)),
sentences AS (SELECT doc_id, pos, s, id FROM parts LEFT JOIN known ON sentence = {norm.format('s')}),
lines AS (
  SELECT doc_id, pos, unnest(ls) AS s, generate_subscripts(ls, 1) AS n FROM (
    SELECT doc_id, pos, string_split(s, chr(10)) AS ls FROM sentences WHERE id IS NULL)),
ids AS (
  SELECT doc_id, pos, 0 AS n, id FROM sentences WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, pos, n, known.id FROM lines JOIN known ON sentence = {norm.format('s')}),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY pos, n) AS sentence_ids,
         string_agg('<' || id || '>', '' ORDER BY pos, n) AS line FROM ids GROUP BY doc_id),
every AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(line, '') AS line
  FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id)
SELECT doc_id, n_sentences, sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), '|') AS licenses,
  CASE {' '.join(cases[k] for k in _by_length())} END AS primary_license
FROM every"""
