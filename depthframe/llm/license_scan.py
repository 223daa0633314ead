"""Licence recognition by sentences and ordered rules. DataFrame functions only, no shuffle.

A text is cut into sentences, each is normalised (lower case, every run of other characters than
a-z and 0-9 as one space) and looked up among known licence sentences. The identifiers found,
in text order, form a sequence; a rule holds if its identifiers occur in the sequence in the
rule's order. Licence texts are often wrapped, so sentences are read twice: with line ends as
boundaries and with line ends as blanks; a rule may hold in either reading. In both, blank lines
(lines of comment marks alone too) and list marks at the start of a line (``1.``, ``(b)``, ``2)``) are
boundaries, and a licence tag with its value is a sentence of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import table

# Wording of public licences and licence notices, by sentence identifier.
SENTENCES = {
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.",
                       "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache2-compliance": ["you may not use this file except in compliance with the License."],
    "apache2-obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                       "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
                       "You may obtain a copy of the License at"],
    "apache2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the "
                      "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                      "either express or implied."],
    "apache-title": ["Apache License"],
    "apache2-date": ["Version 2.0, January 2004"],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License",
                   "The MIT License (MIT)", "The MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                  "and associated documentation files (the \"Software\"), to deal in the Software without "
                  "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                  "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                  "Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or "
                      "substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
                     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                     "NONINFRINGEMENT."],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                   "and associated documentation files (the \"Software\"), to deal in the Software without "
                   "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                   "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                   "Software is furnished to do so."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies.",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                   "fee is hereby granted."],
    "bsl1-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
                   "the software and accompanying documentation covered by this license (the \"Software\") to use, "
                   "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
                   "works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
                   "all subject to the following:"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial "
                   "applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented;"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                         "either in source code form or as a compiled binary, for any purpose, commercial or "
                         "non-commercial, and by any means."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.",
                    "Licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software:", "This library is free software:"],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your "
                   "option) any later version."],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation;"],
    "gpl-version2": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-version3": ["either version 3 of the License, or (at your option) any later version."],
    "gpl-only2": ["version 2 of the License."],
    "gpl2-as-published": ["you can redistribute it and/or modify it under the terms of the GNU General Public License "
                          "version 2 as published by the Free Software Foundation."],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                   "as published by the Free Software Foundation;"],
    "lgpl-version21": ["either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                    "as published by the Free Software Foundation, either version 3 of the License, or (at your "
                    "option) any later version."],
    "agpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                    "as published by the Free Software Foundation, either version 3 of the License, or (at your "
                    "option) any later version."],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gpl2-date": ["Version 2, June 1991"],
    "gpl3-date": ["Version 3, 29 June 2007"],
    "lgpl21-date": ["Version 2.1, February 1999"],
    "agpl3-date": ["Version 3, 19 November 2007"],
    "mpl-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at "
                  "http://mozilla.org/MPL/2.0/.",
                  "If a copy of the MPL was not distributed with this file, You can obtain one at "
                  "https://mozilla.org/MPL/2.0/."],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of "
                   "conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the "
                   "distribution."],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following "
                      "acknowledgement:"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written "
                    "permission."],
    "cc-by-4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
                       "This work is licensed under the Creative Commons Attribution 4.0 International License.",
                       "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.",
                          "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
                          "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                          "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
                          "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0.",
                          "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
                          "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0-notice": ["Released under CC0 1.0.", "This work is dedicated to the public domain.",
                   "CC0 1.0 Universal"],
    "all-rights": ["All rights reserved."],
}

# Names of the public licence tag list.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-2.0", "Unlicense", "Zlib", "Apache-2.0 OR MIT", "MIT OR Apache-2.0", "GPL-2.0-only WITH Linux-syscall-note",
]
TAG = "spdx-license-identifier:"

# Rule name and the sentence identifiers that must follow each other in this order.
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0-header", ["apache2-notice", "apache2-compliance", "apache2-obtain"]),
    ("Apache-2.0-text", ["apache-title", "apache2-date"]),
    ("MIT", ["mit-notice"]),
    ("MIT-text", ["mit-grant", "mit-condition"]),
    ("MIT-0-text", ["mit0-grant", "mit-warranty"]),
    ("ISC-text", ["isc-grant"]),
    ("0BSD-text", ["0bsd-grant"]),
    ("BSL-1.0-text", ["bsl1-grant"]),
    ("Zlib-text", ["zlib-as-is", "zlib-grant", "zlib-origin"]),
    ("Unlicense-text", ["unlicense-free", "unlicense-anyone"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later-header", ["gpl-free", "gpl3-later"]),
    ("GPL-3.0-or-later-header-2", ["gpl-free", "gpl2-later", "gpl-version3"]),
    ("GPL-2.0-or-later-header", ["gpl-free", "gpl2-later", "gpl-version2"]),
    ("GPL-2.0-only-header", ["gpl-free", "gpl2-later", "gpl-only2"]),
    ("GPL-2.0-only-header-2", ["gpl-free", "gpl2-as-published"]),
    ("LGPL-2.1-or-later-header", ["gpl-free", "lgpl-terms", "lgpl-version21"]),
    ("LGPL-3.0-or-later-header", ["gpl-free", "lgpl3-later"]),
    ("AGPL-3.0-or-later-header", ["gpl-free", "agpl3-later"]),
    ("GPL-2.0-text", ["gpl-title", "gpl2-date"]),
    ("GPL-3.0-text", ["gpl-title", "gpl3-date"]),
    ("LGPL-2.1-text", ["lgpl-title", "lgpl21-date"]),
    ("LGPL-3.0-text", ["lgpl-title", "gpl3-date"]),
    ("AGPL-3.0-text", ["agpl-title", "agpl3-date"]),
    ("MPL-2.0-header", ["mpl-form", "mpl2-copy"]),
    ("MPL-2.0-text", ["mpl2-title"]),
    ("BSD-2-Clause-text", ["bsd-grant", "bsd-source"]),
    ("BSD-3-Clause-text", ["bsd-grant", "bsd-source", "bsd-endorse"]),
    ("BSD-4-Clause-text", ["bsd-grant", "bsd-source", "bsd-advertise", "bsd-endorse"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("All-rights-reserved", ["all-rights"]),
]

#: A sentence ends at one of these marks before white space; 2.0 therefore stays whole.
END_MARK = "([.!?;:])[ \\t\\n\\x0B\\f\\r]+"
#: A blank line may hold comment marks; a list mark stands at the start of a line.
BLANK_LINE = "\\n[ \\t*#/;-]*\\n"
LIST_MARK = "\\n[ \\t*#/;-]*[(]?(?:[0-9]{1,2}|[a-z])[.)][ \\t]+"
CUT = "\x01"


def normal_sentence(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip(" ")


def known_sentences() -> dict[str, str]:
    """Identifier of every known sentence, in normal form."""
    tags = {normal_sentence(f"{TAG} {tag}"): _tag_id(tag) for tag in TAGS}
    return {normal_sentence(s): name for name, forms in SENTENCES.items() for s in forms} | tags


def _tag_id(tag: str) -> str:
    return "tag-" + normal_sentence(tag).replace(" ", "-")


def all_rules() -> list[tuple[str, list[str]]]:
    return [*RULES, *((f"tag:{tag}", [_tag_id(tag)]) for tag in TAGS)]


def identifiers(text: Column, lines: bool) -> Column:
    """Array of sentence identifiers in text order. ``lines``: line ends are boundaries too.

    Sentences are first looked up in a hash set; only known ones reach the map, which is searched in order.
    """
    known = known_sentences()
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    cut = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), CUT, " ")
    cut = F.replace(F.replace(cut, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    cut = F.replace(cut, F.lit(TAG), F.lit(CUT + TAG[:-1] + " "))
    cut = F.regexp_replace(cut, BLANK_LINE, CUT + "\n")
    cut = F.regexp_replace(cut, LIST_MARK, CUT)
    cut = F.regexp_replace(cut, END_MARK, "$1" + CUT)
    if lines:
        cut = F.replace(cut, F.lit("\n"), F.lit(CUT))
    cut = F.regexp_replace(cut, f"[^a-z0-9{CUT}]+", " ")
    found = F.filter(F.transform(F.split(cut, CUT, -1), lambda s: F.trim(s)), lambda s: s.isin(*known))
    return F.transform(found, lambda s: F.element_at(F.create_map(*pairs), s))


def rule_pattern(ids: list[str]) -> str:
    """Matches a sequence written as ``;a;b;`` that holds ``ids`` in this order, gaps allowed."""
    return ";" + ";(?:[^;]+;)*".join(re.escape(i) for i in ids).replace("\\-", "-") + ";"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_sentences`` (known ones, by lines), ``sentence_ids``, ``licenses``.

    ``sentence_ids`` holds the identifiers in text order joined by ``;`` and ``licenses`` the
    names of the rules that hold, in rule order, joined by ``;``; both are empty strings for null,
    empty or licence-free texts. A rule is left out if a longer one that starts with the same
    identifiers holds. Repeated rows are judged each by itself.
    """
    text = F.col(f"`{text_col}`")
    ids = docs.select(
        F.col(f"`{id_col}`").alias("id"), identifiers(text, True).alias("a"), identifiers(text, False).alias("b")
    )
    seq = ids.select(
        "id", F.size("a").cast("bigint").alias("n"), F.array_join("a", ";").alias("ids"),
        F.concat(F.lit(";"), F.array_join("a", ";"), F.lit(";")).alias("a"),
        F.concat(F.lit(";"), F.array_join("b", ";"), F.lit(";")).alias("b"),
    )
    rules = all_rules()
    holds = {n: F.col("a").rlike(rule_pattern(r)) | F.col("b").rlike(rule_pattern(r)) for n, r in rules}
    names = []
    for name, rule in rules:
        longer = [n for n, r in rules if len(r) > len(rule) and r[: len(rule)] == rule]
        held = holds[name]
        for n in longer:
            held = held & ~holds[n]
        names.append(F.when(held, F.lit(name)))
    return seq.select(
        F.col("id").alias(id_col), F.col("n").alias("n_sentences"),
        F.col("ids").alias("sentence_ids"),
        F.when((F.col("a") == ";;") & (F.col("b") == ";;"), "").otherwise(F.concat_ws(";", *names)).alias("licenses"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items())

    def ids(lines: bool) -> str:
        cut = "replace(lower(coalesce(text, '')), chr(1), ' ')"
        cut = f"replace(replace({cut}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
        cut = f"replace({cut}, '{TAG}', chr(1) || '{TAG[:-1]} ')"
        cut = f"regexp_replace({cut}, '{BLANK_LINE}', chr(1) || chr(10), 'g')"
        cut = f"regexp_replace({cut}, '{LIST_MARK}', chr(1), 'g')"
        cut = f"regexp_replace({cut}, '{END_MARK}', '\\1' || chr(1), 'g')"
        if lines:
            cut = f"replace({cut}, chr(10), chr(1))"
        cut = f"regexp_replace({cut}, '[^a-z0-9\\x01]+', ' ', 'g')"
        look = f"list_transform(string_split({cut}, chr(1)), lambda s: MAP {{{pairs}}}[trim(s)])"
        return f"list_filter({look}, lambda x: x IS NOT NULL)"

    def holds(rule: list[str]) -> str:
        return f"(regexp_matches(a, {quote(rule_pattern(rule))}) OR regexp_matches(b, {quote(rule_pattern(rule))}))"

    cases = []
    for name, rule in all_rules():
        longer = [r for _, r in all_rules() if len(r) > len(rule) and r[: len(rule)] == rule]
        cond = " AND ".join([holds(rule), *[f"NOT {holds(r)}" for r in longer]])
        cases.append(f"CASE WHEN {cond} THEN {quote(name)} END")
    return f"""
WITH t AS (SELECT doc_id, {ids(True)} AS x, {ids(False)} AS y FROM documents),
s AS (SELECT doc_id, x, ';' || array_to_string(x, ';') || ';' AS a, ';' || array_to_string(y, ';') || ';' AS b FROM t)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_sentences, array_to_string(x, ';') AS sentence_ids,
       concat_ws(';', {", ".join(cases)}) AS licenses
FROM s
"""


SQL = _sql()
