"""Licences by sentence rules, in DataFrame functions only.

A text is normalised and cut into sentences; sentences found in a table of known
licence sentences become identifiers; the sequence of identifiers of a text is then
matched against ordered rules. A rule is a run of identifiers; the first rules are the
most specific, and what a rule has matched is no longer open to later ones.

Texts are cut twice, once with line breaks as blanks, for sentences wrapped over
lines, and once with line breaks as ends, for lines without a full stop; the licences
of both are reported. A line without ASCII letters or digits, comment signs or not, ends
a sentence, and a copyright line is one of its own. Only texts with a word that every known
sentence has one of are cut at all.

"All rights reserved" before a notice belongs to the notice; alone it is proprietary.

Defined cases: null and empty texts have no licence; sentences that belong to a
licence but to no rule are reported as identifiers only; repeated rows are scanned one
by one; columns other than doc_id and text are ignored; an empty table gives no row.
"""

from pyspark.sql import functions as F

# Words and word pairs of which every known sentence has one.
MARKS = (
    "licen", "copyright", "permission", "warrant", "redistribut", "rights reserved",
    "public domain", "liable", "spdx", "freely", "misrepresented",
)

# The same as single words, which wrapped lines, comment signs and double
# blanks leave whole; the operator looks for these before it normalises a text.
WORD_MARKS = (
    "licen", "copyright", "permission", "warrant", "redistribut", "reserved", "domain",
    "liable", "spdx", "freely", "misrepresented",
)

# Known sentences after normalisation (lower case; letters, digits, - and
# + only, single blanks, no full stop) and their identifiers.
SENTENCES = {
    # permissive notices
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this software is licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "distributed under the mit license": "MitRef",
    "spdx-license-identifier mit": "MitRef",
    "mit license": "MitTitle",
    "the mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIsMit",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "LiableMit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "AsIsIsc",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "LiableIsc",
    "isc license": "IscTitle",
    "the isc license": "IscTitle",
    "spdx-license-identifier isc": "IscRef",
    "licensed under the isc license": "IscRef",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "AsIsBsd",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "LiableBsd",
    "in no event shall the copyright holders or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "LiableBsd",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "LiableBsd",
    "bsd 2-clause license": "Bsd2Title",
    "bsd 3-clause license": "Bsd3Title",
    "use of this source code is governed by a bsd-style license that can be found in the license file": "BsdRef",
    "licensed under the bsd license": "BsdRef",
    "released under the bsd license": "BsdRef",
    "spdx-license-identifier bsd-2-clause": "Bsd2Ref",
    "spdx-license-identifier bsd-3-clause": "Bsd3Ref",
    # Apache
    "licensed under the apache license version 2 0": "Apache2Ref",
    "licensed under the apache license version 2 0 the license": "Apache2Ref",
    "this project is licensed under the apache license version 2 0": "Apache2Ref",
    "released under the apache license version 2 0": "Apache2Ref",
    "released under the apache license 2 0": "Apache2Ref",
    "licensed under the apache license 2 0": "Apache2Ref",
    "spdx-license-identifier apache-2 0": "Apache2Ref",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at http": "ApacheCopy",
    "you may obtain a copy of the license at https": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "apache license version 2 0 january 2004": "Apache2Title",
    "apache license version 2 0 january 2004 http": "Apache2Title",
    "apache license version 2 0 january 2004 https": "Apache2Title",
    # copyleft, as whole sentences and as the pieces that semicolons and colons leave
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is licensed under the gnu general public license version 3": "Gpl3Ref",
    "spdx-license-identifier gpl-3 0-only": "Gpl3Ref",
    "spdx-license-identifier gpl-3 0-or-later": "Gpl3PlusRef",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "spdx-license-identifier gpl-2 0-only": "Gpl2Ref",
    "spdx-license-identifier gpl-2 0-or-later": "Gpl2PlusRef",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3PlusGrant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2PlusGrant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "see the gnu lesser general public license for more details": "LgplSee",
    "see the gnu affero general public license for more details": "AgplSee",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AgplTerms",
    "either version 2 of the license or at your option any later version": "Version2Plus",
    "either version 2 1 of the license or at your option any later version": "Version21Plus",
    "either version 3 of the license or at your option any later version": "Version3Plus",
    "version 2 of the license": "Version2",
    "version 2 1 of the license": "Version21",
    "version 3 of the license": "Version3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2PlusGrant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3PlusGrant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21PlusGrant",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3PlusGrant",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3PlusGrant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2OnlyGrant",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "Gpl3OnlyGrant",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplUseful",
    "this library is distributed in the hope that it will be useful but without any warranty": "GplUseful",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplMerchant",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "you should have received a copy of the gnu lesser general public license along with this program": "GplReceived",
    "you should have received a copy of the gnu lesser general public license along with this library": "GplReceived",
    "you should have received a copy of the gnu affero general public license along with this program": "GplReceived",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu lesser general public license version 2 1": "Lgpl21Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "this work is licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
    "this source code form is subject to the terms of the mozilla public license v": "Mpl2Form",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "mozilla public license version 2 0": "Mpl2Title",
    "spdx-license-identifier mpl-2 0": "Mpl2Ref",
    # content licences
    "licensed under cc by-nc 4 0": "CcByNc4Ref",
    "licensed under cc by-nc-sa 4 0": "CcByNcSa4Ref",
    "licensed under cc by-nc-nd 4 0": "CcByNcNd4Ref",
    "licensed under cc by-sa 4 0": "CcBySa4Ref",
    "licensed under cc by-nd 4 0": "CcByNd4Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution-noncommercial 4 0 international license": "CcByNc4Ref",
    "this work is licensed under a creative commons attribution-sharealike 4 0 international license": "CcBySa4Ref",
    "this work is licensed under the creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under the creative commons attribution-noncommercial 4 0 international license": "CcByNc4Ref",
    "this work is licensed under the creative commons attribution-sharealike 4 0 international license": "CcBySa4Ref",
    "this work is licensed under a creative commons attribution-noderivatives 4 0 international license": "CcByNd4Ref",
    "this work is licensed under a creative commons attribution-noncommercial-sharealike 4 0 international license": "CcByNcSa4Ref",
    "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4 0 international license": "CcByNcNd4Ref",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "Cc0Deed",
    "this work is dedicated to the public domain": "PublicDomain",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "this file is in the public domain": "PublicDomain",
    # reserved rights
    "all rights reserved": "AllRights",
    "unauthorized copying of this file via any medium is strictly prohibited without permission": "NoCopying",
}

# Ordered rules of notices, most specific first. What stands before a notice
# as its title or as "All rights reserved" belongs to it.
NOTICES = (
    ("MIT", ("MitGrant", "MitNotice", "AsIsMit", "LiableMit")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "AsIsBsd", "LiableBsd")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AsIsBsd", "LiableBsd")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "AsIsBsd")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AsIsBsd")),
    ("Apache-2.0", ("Apache2Ref", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Apache2Ref", "ApacheComply", "ApacheCopy", "ApacheSee")),
    ("LGPL-2.1-or-later", ("LgplTerms", "Version21Plus")),
    ("LGPL-2.1-or-later", ("Lgpl21PlusGrant",)),
    ("LGPL-3.0-or-later", ("LgplTerms", "Version3Plus")),
    ("LGPL-3.0-or-later", ("Lgpl3PlusGrant",)),
    ("LGPL-2.1", ("LgplTerms", "Version21")),
    ("LGPL-3.0", ("LgplTerms", "Version3")),
    ("AGPL-3.0-or-later", ("AgplTerms", "Version3Plus")),
    ("AGPL-3.0-or-later", ("Agpl3PlusGrant",)),
    ("AGPL-3.0", ("AgplTerms", "Version3")),
    ("GPL-3.0-or-later", ("Gpl3PlusGrant", "GplWarranty", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2PlusGrant", "GplWarranty", "GplSee")),
    ("GPL-3.0-or-later", ("GplTerms", "Version3Plus")),
    ("GPL-2.0-or-later", ("GplTerms", "Version2Plus")),
    ("GPL-3.0-only", ("GplTerms", "Version3")),
    ("GPL-2.0-only", ("GplTerms", "Version2")),
    ("GPL-3.0-only", ("Gpl3OnlyGrant",)),
    ("GPL-2.0-only", ("Gpl2OnlyGrant",)),
    ("ISC", ("IscGrant", "AsIsIsc", "LiableIsc")),
    ("ISC", ("IscGrant",)),
    ("MIT", ("MitGrant", "MitNotice")),
    ("GPL-3.0-or-later", ("Gpl3PlusGrant",)),
    ("GPL-2.0-or-later", ("Gpl2PlusGrant",)),
    ("MPL-2.0", ("Mpl2Form",)),
    ("Unlicense", ("UnlicenseGrant",)),
)

# Ordered rules of shorter mentions.
REFERENCES = (
    ("Apache-2.0", ("Apache2Ref", "ApacheComply")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("Apache-2.0", ("Apache2Title",)),
    ("MIT", ("MitTitle", "MitGrant")),
    ("MIT", ("MitRef",)),
    ("ISC", ("IscRef",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-style", ("BsdRef",)),
    ("BSD-style", ("BsdGrant",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-3.0-or-later", ("Gpl3PlusRef",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("GPL-2.0-or-later", ("Gpl2PlusRef",)),
    ("LGPL-3.0", ("Lgpl3Ref",)),
    ("LGPL-2.1", ("Lgpl21Ref",)),
    ("AGPL-3.0", ("Agpl3Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4Ref",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4Ref",)),
    ("CC-BY-NC-4.0", ("CcByNc4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("CC-BY-ND-4.0", ("CcByNd4Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    ("CC0-1.0", ("Cc0Deed",)),
    ("public-domain", ("PublicDomain",)),
    ("proprietary", ("AllRights", "NoCopying")),
    ("proprietary", ("AllRights",)),
)
RULES = (
    *[rule for name, run in NOTICES for rule in ((name, ("AllRights", *run)), (name, run))],
    *REFERENCES,
)

# The tag of an SPDX line; its colon ends no sentence.
TAG = "spdx-license-identifier"

SIGNS = "[^a-z0-9.;:!?+-]+"
ENDS = "[.;:!?]+( |$)"
# A line break before a line without letters or digits, and a line that states a copyright.
BLANK = r"\n(?=[^a-z0-9\n]*\n)"
STATED = r"(^|\n)([^a-z0-9\n]*copyright[ \t]+(?:\(c\)|©|[12][0-9]{3})[^\n]*)"
# The sentence repeated, as under several copyright lines.
AGAIN = r"(\|AllRights)+\|"


def run_of(ids):
    """A rule as text; it is a substring of a sequence where its identifiers follow."""
    return "|" + "".join(f"{i}|" for i in ids)


def mark_filter(lowered):
    found = F.lit(False)
    for mark in WORD_MARKS:
        found = found | F.contains(lowered, F.lit(mark))
    return found


def identifiers(lowered):
    """The identifiers of the known sentences of a lower-cased text, in order."""
    ended = F.regexp_replace(lowered, STATED, "$1. $2 . ")
    ended = F.regexp_replace(ended, BLANK, "\n. ")
    tagged = F.regexp_replace(ended, rf"{TAG}[ \t]*:", f"{TAG} ")
    sentences = F.split(F.regexp_replace(tagged, SIGNS, " "), ENDS)
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    plain = F.transform(
        sentences, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9+-]+", " "))
    )
    return F.filter(
        F.transform(plain, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull()
    )


def matched(ids):
    """The licences of an identifier sequence, after the ordered rules."""
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("licence"), F.lit(run_of(run)).alias("run"))
            for name, run in RULES
        ]
    )
    text = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    text = F.regexp_replace(text, AGAIN, "|AllRights|")
    start = F.struct(text.alias("open"), F.expr("cast(array() as array<string>)").alias("found"))

    def apply(state, rule):
        return F.when(
            F.contains(state["open"], rule["run"]),
            F.struct(
                F.replace(state["open"], rule["run"], F.lit("|#|")).alias("open"),
                F.array_append(state["found"], rule["licence"]).alias("found"),
            ),
        ).otherwise(state)

    return F.aggregate(rules, start, apply)["found"]


def scan(docs):
    """One row per document: doc_id, licences and sentences (sorted, joined by commas)."""
    lowered = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    none = F.expr("cast(array() as array<string>)")
    wrapped = identifiers(F.col("low"))
    by_line = identifiers(F.replace(F.col("low"), F.lit("\n"), F.lit(". ")))
    cut = lowered.withColumn("hit", mark_filter(F.col("low"))).select(
        "doc_id",
        F.when(F.col("hit"), wrapped).otherwise(none).alias("wrapped"),
        F.when(F.col("hit"), by_line).otherwise(none).alias("by_line"),
    )

    def joined(first, second):
        return F.array_join(F.sort_array(F.array_union(first, second)), ",")

    # What "All rights reserved" belongs to shows in whole sentences only.
    rest = F.when(
        F.array_contains("wrapped", "AllRights"), F.array_remove("by_line", "AllRights")
    ).otherwise(F.col("by_line"))
    return cut.select(
        "doc_id",
        joined(matched(F.col("wrapped")), matched(rest)).alias("licences"),
        joined(F.col("wrapped"), F.col("by_line")).alias("sentences"),
    )


def checking_sql():
    """The same in plain SQL, rule by rule: every text is cut, lines are joined anew."""

    def ids(text):
        cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
        return f"""list_filter(list_transform(
          regexp_split_to_array(regexp_replace(
            regexp_replace({text}, '{TAG}[ \t]*:', '{TAG} ', 'g'), '{SIGNS}', ' ', 'g'), '{ENDS}'),
          lambda s: CASE trim(regexp_replace(s, '[^a-z0-9+-]+', ' ', 'g')) {cases} END),
          lambda i: i IS NOT NULL)"""

    def licences(name):
        steps = (
            f"SELECT doc_id, n, {name}, regexp_replace('|' || array_to_string({name}, '|') || '|', "
            f"'{AGAIN}', '|AllRights|', 'g') AS open, []::VARCHAR[] AS found FROM cut"
        )
        for licence, run in RULES:
            text = run_of(run)
            steps = (
                f"SELECT doc_id, n, {name}, replace(open, '{text}', '|#|') AS open, "
                f"CASE WHEN contains(open, '{text}') THEN list_append(found, '{licence}') "
                f"ELSE found END AS found FROM ({steps})"
            )
        return steps

    # Line by line: one that states a copyright stands alone, one without a letter or
    # digit that another follows ends what is before it.
    stated = r"^[^a-z0-9]*copyright[ \t]+(\(c\)|©|[12][0-9]{3})"
    one = f"""CASE WHEN regexp_matches(line, '{stated}') THEN '. ' || line || ' . '
          WHEN i > 1 AND i < len(lines) AND NOT regexp_matches(line, '[a-z0-9]') THEN '. ' || line
          ELSE line END"""
    return f"""
    WITH source AS (
      SELECT doc_id, row_number() OVER () AS n,
             string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
    joined AS (
      SELECT doc_id, n, array_to_string(list_transform(lines, lambda line, i: {one}), chr(10)) AS low
      FROM source),
    pieces AS (
      SELECT doc_id, n, {ids("low")} AS wrapped,
             {ids("replace(low, chr(10), '. ')")} AS by_line FROM joined),
    cut AS (
      SELECT doc_id, n, wrapped, CASE WHEN list_contains(wrapped, 'AllRights')
             THEN list_filter(by_line, lambda i: i <> 'AllRights') ELSE by_line END AS by_line
      FROM pieces),
    a AS ({licences("wrapped")}), b AS ({licences("by_line")})
    SELECT a.doc_id,
      array_to_string(list_sort(list_distinct(list_concat(a.found, b.found))), ',') AS licences,
      array_to_string(list_sort(list_distinct(list_concat(a.wrapped, b.by_line))), ',') AS sentences
    FROM a JOIN b ON a.n = b.n"""
