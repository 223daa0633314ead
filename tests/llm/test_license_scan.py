from pyspark.sql import functions as F

from depthframe.llm import license_scan as ls

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
    'documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation '
    "the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to "
    "permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
)
BSD = " ".join(ls.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source"))
MIT_FILE = "Copyright (c) 2020 A. Person\n\n" + MIT + (
    '\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n"
)
BSD_FILE = (
    "Copyright 2019 X\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted "
    "provided that the following conditions are met:\n\n1) Redistributions of source code must retain the above copyright "
    "notice,\n   this list of conditions and the following disclaimer.\n\n2) Redistributions in binary form must reproduce the "
    "above copyright notice, this\n   list of conditions and the following disclaimer in the documentation and/or other\n"
    "   materials provided with the distribution.\n\n3) Neither the name of the copyright holder nor the names of its\n"
    "   contributors may be used to endorse or promote products derived from this\n   software without specific prior written "
    "permission.\n"
)
APACHE_HEADER = (
    '# Copyright 2020 X\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file '
    "except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     "
    "http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law\n"
)
LGPL_HEADER = (
    " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General "
    "Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) "
    "any later version.\n"
)
MPL_HEADER = (
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
    "distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
)
ISC_FILE = (
    "Copyright X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
    "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
)
CASES = [
    ("Some text.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0"),
    ("no stop before\nRELEASED under the MIT license!\n", "MIT"),
    (MIT, "MIT-text"),
    (BSD, "BSD-2-Clause-text"),
    (BSD + "\nmore words. " + ls.SENTENCES["bsd-endorse"][0], "BSD-3-Clause-text"),
    (ls.SENTENCES["bsd-source"][0] + " " + ls.SENTENCES["bsd-grant"][0], ""),
    ("All rights reserved.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0;All-rights-reserved"),
    ("Licensed under CC BY-NC 4.", ""),
    ("Licensed under CC BY-NC 4.0. " * 20_000, "CC-BY-NC-4.0"),
    ("", ""),
    (None, ""),
    ("\x01\n\x01. ;", ""),
    (MIT_FILE, "MIT-text"),
    ("The MIT License (MIT)\n\n" + MIT_FILE, "MIT;MIT-text"),
    (MIT_FILE.replace("\n", "\r\n"), "MIT-text"),
    ("".join(f" * {line}\n" for line in MIT_FILE.split("\n")), "MIT-text"),
    (BSD_FILE, "BSD-3-Clause-text"),
    (APACHE_HEADER, "Apache-2.0-header"),
    (LGPL_HEADER, "LGPL-2.1-or-later-header"),
    (MPL_HEADER, "MPL-2.0-header"),
    (ISC_FILE, "ISC-text"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0-text"),
    ("// SPDX-License-Identifier: MIT\npackage a;", "tag:MIT"),
    ("/* SPDX-License-Identifier:  GPL-2.0-only */ int a;\nx", ""),
    ("/* SPDX-License-Identifier: GPL-2.0-only */\nx", "tag:GPL-2.0-only"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "tag:MIT OR Apache-2.0"),
    ("\n" * 30_000 + "MIT License" + "\n# \n" * 30_000, "MIT"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    df = df.withColumn("a", F.lit("clash")).withColumn("licenses", F.lit("clash"))
    got = {r["doc_id"]: r for r in ls.scan_licenses(df).collect()}
    assert [got[i]["licenses"] for i in range(len(CASES))] == [want for _, want in CASES]
    assert got[8]["n_sentences"] == 20_000 and got[10]["sentence_ids"] == ""
    assert got[6]["sentence_ids"] == "all-rights;cc-by-nc-4-notice"


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, CASES[0][0]), (1, CASES[0][0]), (None, None)], "doc_id bigint, text string")
    assert sorted(r["licenses"] for r in ls.scan_licenses(df).collect()) == ["", "Apache-2.0", "Apache-2.0"]
    assert ls.scan_licenses(df.limit(0)).count() == 0


def test_known_sentences_are_normal_and_distinct():
    known = ls.known_sentences()
    assert len(known) == sum(len(forms) for forms in ls.SENTENCES.values()) + len(ls.TAGS)
    assert all(name in ls.SENTENCES for _, rule in ls.RULES for name in rule)
    assert len({name for name, _ in ls.all_rules()}) == len(ls.all_rules())


def test_every_form_is_one_sentence_in_either_reading(spark):
    forms = [(name, f"Words before.\n\n{s}\n\nwords after") for name, forms in ls.SENTENCES.items() for s in forms]
    df = spark.createDataFrame(forms, "name string, text string")
    both = df.select("name", ls.identifiers(df["text"], True).alias("a"), ls.identifiers(df["text"], False).alias("b"))
    assert [(r["name"], r["a"], r["b"]) for r in both.collect() if not [r["name"]] == r["a"] == r["b"]] == []


def test_sql_gives_the_same_rows(spark):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = [tuple(r) for r in con.execute(ls.SQL + " ORDER BY doc_id").fetchall()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    assert [tuple(r) for r in ls.scan_licenses(df).orderBy("doc_id").collect()] == want
