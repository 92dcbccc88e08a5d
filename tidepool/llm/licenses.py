"""License scans by sentence rules, in built-in functions only and without any shuffle.

A text is cut into sentences, each sentence is normalised (ASCII lower case, every run of other characters one space) and
looked up among known license sentences. The row's sequence of identifiers is then matched against ordered rules: the first
rule whose identifiers stand next to each other in the sequence names its license and consumes them.

Two readings are taken, line by line and with single line breaks joined (wrapped licenses), and merged by position: what
either of them knows is kept, and the lines that make up a joined sentence do not count beside it. Joined sentences are read
with and without a cut at colons, and "v." before a number ends none. Marks of comments at the beginning of lines go first, so
that a commented header has its blank lines. ``ORACLE`` is the same definition.

Edge cases: null or empty texts have no sentences (empty strings, counts 0). A very long text is cut and matched whole within
its row. Repeated rows are scanned row by row and stay. Null ids stay. An empty table gives no rows. Only the id and text columns
are read; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Normalised sentences of public licenses with identifiers.
SENTENCES: dict[str, str] = {
    "this work is licensed under the gnu general public license version 3": "GPL3-REF",
    "this work is licensed under the gnu general public license version 2": "GPL2-REF",
    "licensed under the apache license version 2 0": "APACHE2-REF",
    "licensed under the apache license version 2 0 the license": "APACHE2-REF",
    "you may not use this file except in compliance with the license": "APACHE2-COMPLY",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "APACHE2-REF",
    "you may obtain a copy of the license at": "APACHE2-COPY",
    "http www apache org licenses license 2 0": "APACHE2-URL",
    "https www apache org licenses license 2 0": "APACHE2-URL",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE2-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2-ASIS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2-SEE",
    "released under the mit license": "MIT-REF",
    "this project is licensed under the mit license": "MIT-REF",
    "licensed under the mit license": "MIT-REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-ASIS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-LIABLE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-ASIS",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-ENDORSE",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2-LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3-LATER",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21-LATER",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL-HOPE",
    "see the gnu general public license for more details": "GPL-SEE",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2-REF",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2-COPY",
    "licensed under cc by nc 4 0": "CC-BY-NC4-REF",
    "licensed under cc by 4 0": "CC-BY4-REF",
    "licensed under cc by sa 4 0": "CC-BY-SA4-REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC-BY4-REF",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CC-BY-SA4-REF",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-GRANT",
    "distributed under the boost software license version 1 0": "BSL1-REF",
    "boost software license version 1 0 august 17th 2003": "BSL1-TITLE",
    "apache license version 2 0 january 2004": "APACHE2-TITLE",
    "apache license version 2 0 january 2004 http www apache org licenses": "APACHE2-TITLE",
    "apache license version 2 0 january 2004 https www apache org licenses": "APACHE2-TITLE",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "APACHE2-DEFINE",
    "all additions and alterations are licensed under the apache 2 0 license": "APACHE2-REF",
    "apache software license 2 0": "APACHE2-REF",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "NCSA-GRANT",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "MIT0-GRANT",
    "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation": "HPND-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers": "NCSA-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimers in the documentation and or other materials provided with the distribution": "NCSA-BINARY",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the disclaimer that follows these conditions in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD-ASIS",
    "gnu general public license version 1 february 1989": "GPL1-TITLE",
    "gnu general public license version 2 june 1991": "GPL2-TITLE",
    "gnu general public license version 3 29 june 2007": "GPL3-TITLE",
    "gnu lesser general public license version 2 1 february 1999": "LGPL21-TITLE",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3-TITLE",
    "gnu library general public license version 2 june 1991": "LGPL2-TITLE",
    "gnu affero general public license version 3 19 november 2007": "AGPL3-TITLE",
    "gnu free documentation license version 1 2 november 2002": "GFDL12-TITLE",
    "gnu free documentation license version 1 3 3 november 2008": "GFDL13-TITLE",
    "this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license": "GPL2-APPLIES",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "GPL3-PREAMBLE",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "AGPL3-PREAMBLE",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "LGPL3-INCORPORATES",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3-LATER",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "LGPL2-LATER",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3-LATER",
    "mozilla public license version 2 0": "MPL2-TITLE",
    "mozilla public license version 1 1": "MPL11-TITLE",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2-COPY",
    "all code in this repository except where explicitly noted otherwise is released under the mozilla public license v 2 0": "MPL2-REF",
    "cc0 1 0 universal": "CC0-TITLE",
    "creative commons cc0 1 0 universal": "CC0-TITLE",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0-DEDICATE",
    "the artistic license": "ARTISTIC1-TITLE",
    "the artistic license 2 0": "ARTISTIC2-TITLE",
    "artistic license 2 0": "ARTISTIC2-TITLE",
    "eclipse public license v 1 0": "EPL1-TITLE",
    "eclipse public license v 2 0": "EPL2-TITLE",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "EPL-TERMS",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "this software is provided as is without any express or implied warranty": "ZLIB-ASIS",
    "this notice may not be removed or altered from any source distribution": "ZLIB-NOTICE",
    "python software foundation license version 2": "PSF2-TITLE",
    "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation": "PSF2-BETWEEN",
    "unicode license v3": "UNICODE3-TITLE",
    "do what the fuck you want to public license": "WTFPL-TITLE",
}
#: Sentences that name a holder: how they begin and end (fixed values).
NAMED = [("neither the name", "may be used to endorse or promote products derived from this software without specific prior written permission", "BSD-ENDORSE"), ("the name", "must not be used to endorse or promote products derived from this software without prior written permission", "BSD-ENDORSE"), ("nor the names of its contributors", "may be used to endorse or promote products derived from this software without specific prior written permission", "BSD-ENDORSE")]
#: SPDX tag lines, normalised by rule.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "MPL-2.0", "ISC", "Unlicense", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
SENTENCES |= {"spdx license identifier " + s.lower().replace("-", " ").replace(".", " "): f"SPDX:{s}" for s in SPDX}

#: Ordered rules: license, then the identifiers that must follow one another. Longer sequences stand before their parts.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["APACHE2-REF", "APACHE2-COMPLY", "APACHE2-COPY", "APACHE2-URL", "APACHE2-ASIS", "APACHE2-SEE"]),
    ("Apache-2.0", ["APACHE2-REF", "APACHE2-COMPLY", "APACHE2-COPY", "APACHE2-ASIS", "APACHE2-SEE"]),
    ("Apache-2.0", ["APACHE2-REF", "APACHE2-COPY", "APACHE2-ASIS", "APACHE2-SEE"]),
    ("Apache-2.0", ["APACHE2-REF", "APACHE2-COPY"]),
    ("Apache-2.0", ["APACHE2-REF"]),
    ("Apache-2.0", ["APACHE2-TITLE"]),
    ("Apache-2.0", ["APACHE2-DEFINE"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "MIT-LIABLE"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("MIT", ["MIT-GRANT"]),
    ("MIT", ["MIT-REF"]),
    ("ISC", ["ISC-GRANT", "ISC-ASIS"]),
    ("ISC", ["ISC-GRANT"]),
    ("MIT-0", ["MIT0-GRANT"]),
    ("HPND", ["HPND-GRANT"]),
    ("0BSD", ["0BSD-GRANT"]),
    ("NCSA", ["NCSA-GRANT", "NCSA-SOURCE", "NCSA-BINARY"]),
    ("NCSA", ["NCSA-GRANT"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"]),
    ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("GPL-2.0-or-later", ["GPL2-LATER", "GPL-HOPE", "GPL-SEE"]),
    ("GPL-2.0-or-later", ["GPL2-LATER"]),
    ("GPL-3.0-or-later", ["GPL3-LATER", "GPL-HOPE", "GPL-SEE"]),
    ("GPL-3.0-or-later", ["GPL3-LATER"]),
    ("LGPL-2.1-or-later", ["LGPL21-LATER"]),
    ("LGPL-2.0-or-later", ["LGPL2-LATER"]),
    ("LGPL-3.0-or-later", ["LGPL3-LATER"]),
    ("AGPL-3.0-or-later", ["AGPL3-LATER"]),
    ("AGPL-3.0", ["AGPL3-TITLE"]),
    ("AGPL-3.0", ["AGPL3-PREAMBLE"]),
    ("LGPL-3.0", ["LGPL3-TITLE"]),
    ("LGPL-3.0", ["LGPL3-INCORPORATES"]),
    ("LGPL-2.1", ["LGPL21-TITLE"]),
    ("LGPL-2.0", ["LGPL2-TITLE"]),
    ("GPL-3.0", ["GPL3-TITLE"]),
    ("GPL-3.0", ["GPL3-PREAMBLE"]),
    ("GPL-2.0", ["GPL2-TITLE"]),
    ("GPL-2.0", ["GPL2-APPLIES"]),
    ("GPL-1.0", ["GPL1-TITLE"]),
    ("GFDL-1.3", ["GFDL13-TITLE"]),
    ("GFDL-1.2", ["GFDL12-TITLE"]),
    ("GPL-3.0-only", ["GPL3-REF"]),
    ("GPL-2.0-only", ["GPL2-REF"]),
    ("MPL-2.0", ["MPL2-REF", "MPL2-COPY"]),
    ("MPL-2.0", ["MPL2-REF"]),
    ("MPL-2.0", ["MPL2-TITLE"]),
    ("MPL-1.1", ["MPL11-TITLE"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC4-REF"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA4-REF"]),
    ("CC-BY-4.0", ["CC-BY4-REF"]),
    ("Unlicense", ["UNLICENSE-GRANT"]),
    ("BSL-1.0", ["BSL1-REF"]),
    ("BSL-1.0", ["BSL1-TITLE"]),
    ("CC0-1.0", ["CC0-TITLE"]),
    ("CC0-1.0", ["CC0-DEDICATE"]),
    ("Artistic-1.0", ["ARTISTIC1-TITLE"]),
    ("Artistic-2.0", ["ARTISTIC2-TITLE"]),
    ("EPL-1.0", ["EPL1-TITLE"]),
    ("EPL-2.0", ["EPL2-TITLE"]),
    ("Zlib", ["ZLIB-GRANT"]),
    ("PSF-2.0", ["PSF2-TITLE"]),
    ("PSF-2.0", ["PSF2-BETWEEN"]),
    ("Unicode-3.0", ["UNICODE3-TITLE"]),
    ("WTFPL", ["WTFPL-TITLE"]),
    *((s, [f"SPDX:{s}"]) for s in SPDX),
]
#: Each known sentence holds one of these within a word (a test proves it), so that a text without any of them needs no cutting.
STEMS = ["licen", "permission", "warrant", "redistribut", "copyright", "unencumbered", "mozilla", "cc0", "altered", "endorse"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = r"[ \t\n\x0B\f\r]"
_LINES = r"[.!?]+[ \t\r\f\x0B]+|\n"
_JOINED = rf"[.!?:]+{_WHITE}+|\n{_WHITE}*\n"
#: Marks of comments at the beginning of lines; with them a line between two paragraphs is a blank one.
_COMMENT = r"(?m)^[ \t]*(?:/?\*+/?|//+|#+|;+|--+|%+)"
#: What may number an item of a list.
_ITEM = "^[0-9a-z]{1,2} "
#: Both readings cut here, so that they can be merged part by part.
_PARTS = rf"(?<!(?:^|[^A-Za-z0-9_])[vV])[.!?]+{_WHITE}+|\n{_WHITE}*\n"


def _norm(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _found(pieces: Column) -> Column:
    """Of each piece with an identifier: the identifier, the piece and its place among the pieces."""
    table = F.create_map(*(F.lit(x) for kv in SENTENCES.items() for x in kv))

    def named(s: Column) -> Column:
        holders = [F.when(s.startswith(a) & s.endswith(z), F.lit(i)) for a, z, i in NAMED]
        listed = F.try_element_at(table, F.regexp_replace(s, _ITEM, ""))
        return F.when(s.startswith("copyright "), F.lit("COPYRIGHT")).otherwise(F.coalesce(F.try_element_at(table, s), listed, *holders, F.when(s.contains("licen"), F.lit("UNKNOWN"))))

    normed = F.transform(pieces, lambda s, k: F.struct(_norm(s).alias("norm"), s.alias("s"), k.alias("k")))
    return F.filter(F.transform(normed, lambda x: F.struct(named(x["norm"]).alias("id"), x["s"].alias("s"), x["k"].alias("k"))), lambda x: x["id"].isNotNull())


def _merge(part: Column) -> Column:
    """Identifiers of a part: those of its lines, and the joined ones that the lines lack in place of their lines."""
    lines, new = part["lines"], part["new"]
    inside = lambda x: x["id"].isin("UNKNOWN", "COPYRIGHT") & F.exists(new, lambda n: (n["id"] != "COPYRIGHT") & n["s"].contains(x["s"]))
    placed = lambda c, reading: F.transform(c, lambda x: F.struct(F.instr(part["text"], x["s"]).alias("at"), F.lit(reading).alias("reading"), x["k"].alias("k"), x["id"].alias("id")))
    both = F.array_sort(F.concat(placed(F.filter(lines, lambda x: ~inside(x)), 0), placed(new, 1)))
    return F.when(F.size(new) == 0, F.transform(lines, lambda x: x["id"])).otherwise(F.transform(both, lambda x: x["id"]))


def _known(text: Column) -> Column:
    parts = F.transform(F.split(text, _PARTS), lambda p: F.struct(p.alias("text"), _found(F.split(p, _LINES)).alias("lines"), _found(F.split(p, _JOINED)).alias("joined"), _found(F.array(p)).alias("whole")))
    lacks = lambda a, x: (x["id"] != "UNKNOWN") & ~F.exists(a, lambda y: y["id"] == x["id"])
    parts = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["lines"].alias("lines"), F.concat(F.filter(p["joined"], lambda x: lacks(p["lines"], x)), F.filter(p["whole"], lambda x: lacks(F.concat(p["lines"], p["joined"]), x))).alias("new")))
    return F.flatten(F.transform(parts, _merge))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of sentence identifiers in order), licenses (array, in the order of the rules)."""
    text = F.col(text_col)
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    hit = F.lit(False)
    for stem in STEMS:
        hit = hit | lower.contains(stem)
    empty = F.array().cast("array<string>")
    per_row = docs.select(F.col(id_col), F.when(hit, text).alias("t"))
    merged = per_row.select(F.col(id_col), F.when(F.col("t").isNull(), empty).otherwise(_known(F.regexp_replace("t", _COMMENT, ""))).alias("ids"))
    # each identifier stands between commas of its own, so that consuming a sequence leaves its neighbours whole
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("seq")) for name, ids in RULES))
    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("rest"), empty.alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(acc["rest"], rule["seq"], F.lit("|")).alias("rest"), F.array_union(acc["found"], F.array(rule["name"])).alias("found"))
        return F.when(acc["rest"].contains(rule["seq"]), taken).otherwise(acc)

    return merged.select(F.col(id_col), F.col("ids"), F.aggregate(rules, start, step)["found"].alias("licenses"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size(F.filter("ids", lambda i: i != "UNKNOWN")).cast("long").alias("n_known"), F.size(F.filter("ids", lambda i: i == "UNKNOWN")).cast("long").alias("n_unknown"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """The same definition for DuckDB, part by part. Its patterns know no look-behind, so what follows a "v" is set aside before the cut."""
    norm = f"trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    holders = ", ".join(f"CASE WHEN starts_with(n, '{a}') AND ends_with(n, '{z}') THEN '{i}' END" for a, z, i in NAMED)
    named = f"CASE WHEN starts_with(n, 'copyright ') THEN 'COPYRIGHT' ELSE coalesce(({table})[n], ({table})[regexp_replace(n, '{_ITEM}', '')], {holders}, CASE WHEN contains(n, 'licen') THEN 'UNKNOWN' END) END"
    stems = " OR ".join(f"contains(translate(text, '{_UPPER}', '{_LOWER}'), '{s}')" for s in STEMS)
    known = "len(list_filter({c}, lambda i: i <> 'UNKNOWN'))"
    quoted = lambda pattern: pattern.replace("\n", "\\n")
    aside, back = "regexp_replace(text, '{}', '', 'g')".format(_COMMENT), "p"
    for mark, held in zip(".!?", "\uf8f1\uf8f2\uf8f3", strict=True):
        aside = f"regexp_replace({aside}, '\\b([vV])[{mark}]', '\\1{held}', 'g')"
        back = f"replace({back}, '{held}', '{mark}')"
    cut = quoted(_PARTS[_PARTS.index("[vV])") + 5 :])
    reading = lambda name, pieces: f"SELECT doc_id, part, '{name}' AS how, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, part, {pieces} AS l FROM p)"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, CASE WHEN {stems} THEN text ELSE '' END AS text FROM documents)",
        f"p0 AS (SELECT doc_id, string_split_regex({aside}, '{cut}') AS ps FROM d)",
        f"p AS (SELECT doc_id, part, {back} AS text FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS part FROM p0))",
        f"q AS (SELECT doc_id, part, how, s, {norm} AS n, k FROM ({reading('a', f"string_split_regex(text, '{quoted(_LINES)}')")} UNION ALL {reading('b', f"string_split_regex(text, '{quoted(_JOINED)}')")} UNION ALL {reading('c', '[text]')}))",
        f"f AS (SELECT doc_id, part, how, s, k, {named} AS id FROM q)",
        "n AS (SELECT * FROM f WHERE id IS NOT NULL)",
        "new AS (SELECT * FROM n x WHERE how <> 'a' AND id <> 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM n y WHERE y.doc_id = x.doc_id AND y.part = x.part AND y.id = x.id AND y.how < x.how))",
        "old AS (SELECT * FROM n x WHERE how = 'a' AND NOT (id IN ('UNKNOWN', 'COPYRIGHT') AND EXISTS (SELECT 1 FROM new y WHERE y.doc_id = x.doc_id AND y.part = x.part AND y.id <> 'COPYRIGHT' AND contains(y.s, x.s))))",
        "m AS (SELECT n.doc_id, n.part, n.id, 0 AS place, 0 AS reading, n.k FROM n WHERE how = 'a' AND NOT EXISTS (SELECT 1 FROM new y WHERE y.doc_id = n.doc_id AND y.part = n.part) UNION ALL "
        "SELECT o.doc_id, o.part, o.id, instr(p.text, o.s), CASE o.how WHEN 'a' THEN 0 ELSE 1 END, o.k FROM (SELECT * FROM old WHERE EXISTS (SELECT 1 FROM new y WHERE y.doc_id = old.doc_id AND y.part = old.part) UNION ALL SELECT * FROM new) o JOIN p ON p.doc_id = o.doc_id AND p.part = o.part)",
        "g AS (SELECT doc_id, list(id ORDER BY part, place, reading, k, id) AS ids FROM m GROUP BY doc_id)",
        "c0 AS (SELECT d.id AS doc_id, coalesce(ids, []) AS ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS rest, []::VARCHAR[] AS found FROM d LEFT JOIN g USING (doc_id))",
    ]
    for i, (name, seq) in enumerate(RULES):
        s = "," + ",,".join(seq) + ","
        ctes.append(f"c{i + 1} AS (SELECT doc_id, ids, replace(rest, '{s}', '|') AS rest, CASE WHEN contains(rest, '{s}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM c{i})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, {known.format(c='ids')} AS n_known, len(ids) - {known.format(c='ids')} AS n_unknown, coalesce(array_to_string(found, ','), '') AS licenses FROM c{len(RULES)}"


ORACLE = _oracle()
