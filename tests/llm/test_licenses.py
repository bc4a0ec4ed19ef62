"""License rules on notices as files have them, and which hits hide others."""

import pytest
from pyspark.sql import functions as F

from urlsight.llm import licenses, queries

SCANNER = licenses.Scanner()


def hits(text):
    return [(h["label"], h["rule"]) for h in SCANNER.scan(text.encode())[2]]


def labels(text):
    return {label for label, _ in hits(text)}


@pytest.mark.parametrize("text, expected", [
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance "
     "with the License.\n# Unless required by applicable law, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,",
     {"apache-2.0"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     {"gpl", "gpl-3.0-or-later"}),
    ("GNU Lesser General Public License as published; either version 2.1 of the License, or (at your option) any later version",
     {"lgpl-2.1-or-later"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the "
     "Foo Project nor the names of its contributors may be used to endorse or promote products derived from this software",
     {"bsd", "bsd-3-clause"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights", {"cc0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-4.0"}),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", {"proprietary"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("THE BEER-WARE LICENSE: if we meet some day, and you think this stuff is worth it, you can buy me a beer", {"beerware"}),
    # What is no license.
    ("Copyright 2020 Foo. All rights reserved.", set()),
    ("he passed the MIT exam and took the bus; the general public has a license to drive", set()),
    ("a business source of income, and a server on the other side", set()),
])
def test_notices(text, expected):
    assert labels(text) == expected


def test_a_tag_and_a_version_hide_the_bare_name_inside_them():
    assert hits("Released under the terms of the Apache License 2.0") == [("apache-2.0", "notice")]
    assert hits("the Apache License") == [("apache", "name")]
    # Beside each other both stand.
    assert hits("the Apache License 2.0 and the Apache License") == [("apache-2.0", "name"), ("apache", "name")]
    assert hits("SPDX-License-Identifier: Apache-2.0 MIT license") == [("apache-2.0", "tag"), ("mit", "name")]


def test_every_notice_is_found_by_its_keyword():
    for label, keyword, notice in licenses.NOTICES:
        assert keyword in notice, label
    assert len(licenses.rules()) > 400


def test_the_query_joins_base_labels_and_those_of_the_rules(spark, tmp_path):
    rows = [(1, "SPDX-License-Identifier: MPL-2.0. See the MIT license"), (2, "The GNU General Public License, version 3"), (3, None),
            (4, "All rights reserved")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_license_scan"](spark, str(tmp_path)).collect()}
    shown = {k: (r["n_base"], r["first_word"], r["base_labels"], r["labels"], r["score"]) for k, r in got.items()}
    assert shown == {
        1: (1, 8, "mit", "mit,mpl-2.0", 1.0), 2: (1, 1, "gpl", "gpl,gpl-3.0", 0.7),
        3: (0, None, "", "", 0.0), 4: (0, None, "", "", 0.0),
    }


def test_clean_documents_have_no_labels(spark, sf_dir):
    """Only documents with a base phrase are labelled: the others of the table name no license."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = licenses.scan(docs.select("doc_id", "text"))
    assert found.filter((F.size("base_places") == 0) & (F.size("hits") > 0)).count() <= 0.01 * docs.count()
