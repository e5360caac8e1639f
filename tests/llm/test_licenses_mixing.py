"""Licence sentences and rules; hierarchical budgets against a plain water-filling."""

import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from trackweave.llm import licenses, mixing


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [r["licenses"] for r in rows]


def test_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Code here. This file is released under the MIT License. More code.": "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MIT",
        "Licensed under CC BY-SA 4.0. Distributed under the GNU General Public License, version 3": "CC-BY-SA-4.0,GPL-3.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.\nNeither the name of X may be used to endorse or promote products derived from this software.": "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.": "BSD-2-Clause",
        "The licensed driver had permission to park.": "",
        "": "",
    }
    assert found(spark, list(cases)) == list(cases.values())
    assert found(spark, ["word " * 300_000 + ". Licensed under the Apache License, Version 2.0. " + "word " * 10]) == ["Apache-2.0"]


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}
WRAPPED_IDS = ["MITPermission,MITCondition,AsIs", "BSDRedist,BSDEndorse", "GPL3Free", "ApacheVer,ApacheNotice,ApacheCopy,ApacheAsIs"]


def test_sentences_over_lines(spark):
    for leader in ("", "// ", " * ", "# ", ";; ", "dnl "):
        for end in ("\n", "\r\n"):
            texts = [end.join(f"{leader}{line}" for line in t.split("\n")) for t in WRAPPED.values()]
            rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
            assert [r["licenses"] for r in rows] == list(WRAPPED)
            assert [r["sentence_ids"] for r in rows] == WRAPPED_IDS


def test_further_licenses_and_declared_ones(spark):
    cases = {
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed": "MPL-2.0",
        "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that": "ISC",
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it": "Zlib",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Licensed under the terms of the GNU Affero General Public License version 3": "AGPL-3.0",
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "SPDX-License-Identifier: Apache-2.0\nLicensed under the MIT license": "MIT,apache-2.0",
    }
    assert found(spark, list(cases)) == list(cases.values())


GNU = """This {0} is free software{1} you can redistribute it and/or
modify it under the terms of the GNU {2}General Public
License as published by the Free Software Foundation{3} either
version {4} of the License, or (at your option) any later version."""


def test_versions_and_expressions(spark):
    cases = {
        GNU.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1",
        GNU.format("program", ";", "", ";", "2"): "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.": "GPL",
        GNU.format("program", ":", "", ",", "3"): "GPL-3.0",
        GNU.format("program", ":", "Affero ", ",", "3"): "AGPL-3.0",
        GNU.format("library", ":", "Lesser ", ",", "3"): "LGPL-3.0",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit",
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND " + " AND ".join(f"LicenseRef-{k:03}" for k in range(40)): ",".join(["classpath-exception-2.0", "gpl-2.0-or-later", *(f"licenseref-{k:03}" for k in range(40))]),
        "SPDX-License-Identifier: OR": "",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
        "This library is distributed under the Artistic License 2.0.": "Artistic-2.0",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that\n\nAll advertising materials mentioning features or use of this software\nmust display the following acknowledgement:": "BSD-4-Clause",
    }
    got = dict(zip(cases, found(spark, list(cases)), strict=True))
    assert got == cases


def test_lines_that_are_sentences_stay_apart(spark):
    cases = {
        "Neither the name of\nLicensed under the MIT license\nmay be used to endorse or promote products derived from this software": "MIT",
        "SPDX-License-Identifier:\nLicensed under the MIT license": "MIT",
        "Licensed under the\n\nMIT license": "",
        "Some title\nCopyright 2020 X\nLicensed under the MIT license\nmore words\nReleased under the\nGNU General Public License\nversion 2": "GPL-2.0,MIT",
    }
    assert found(spark, list(cases)) == list(cases.values())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = licenses.scan(odd_docs.withColumns({"licenses": F.lit("own"), "_rest": F.lit("own"), "sentence_ids": F.lit("own")})).collect()
    assert len(rows) == odd_docs.count() and all(r["licenses"] == r["sentence_ids"] == "" for r in rows)
    assert licenses.scan(no_docs).collect() == []


def water(budget, children):
    """{name: share} of children (capacity, weight), the emptiest first."""
    out, left, weights = {}, budget, sum(w for _, w in children.values())
    for name, (capacity, weight) in sorted(children.items(), key=lambda c: (Fraction(c[1][0], c[1][1]), c[0])):
        if capacity <= left * weight // weights:
            out[name] = capacity
            left, weights = left - capacity, weights - weight
        else:
            rest = {n: c for n, c in children.items() if n not in out}
            return out | {n: min(c, left * w // weights) for n, (c, w) in rest.items()}
    return out


def brute(rows, plan):
    import re

    leaves, docs = {}, []
    for i, text, lang, source in rows:
        s, g = source or "unknown", lang or "unknown"
        d = next((n for n, p in plan.domains if re.search(p, s)), plan.other_domain)
        tokens = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves[d, g, s] = leaves.get((d, g, s), 0) + tokens
        docs.append((i, (d, g, s), tokens))
    weigh = lambda w, n: w.get(n, plan.default_weight)
    cap = lambda keys: sum(leaves[k] for k in keys) * plan.max_epochs
    budgets = {}
    by_domain = water(sum(leaves.values()) * plan.budget_percent // 100, {d: (cap([k for k in leaves if k[0] == d]), weigh(plan.domain_weights, d)) for d in {k[0] for k in leaves}})
    for d, b in by_domain.items():
        by_lang = water(b, {g: (cap([k for k in leaves if k[:2] == (d, g)]), weigh(plan.lang_weights, g)) for g in {k[1] for k in leaves if k[0] == d}})
        for g, c in by_lang.items():
            for s, x in water(c, {k[2]: (cap([k]), weigh(plan.source_weights, k[2])) for k in leaves if k[:2] == (d, g)}).items():
                budgets[d, g, s] = x
    out = []
    for leaf, supply in leaves.items():
        epochs, rest = divmod(budgets[leaf], supply) if supply else (0, 0)
        order = sorted((hashlib.md5(f"{plan.seed}:{epochs}:{'' if i is None else i}".encode()).hexdigest(), i or 0, t, i) for i, where, t in docs if where == leaf)
        upto = 0
        for _, _, t, i in order:
            upto += t
            copies = epochs + (upto <= rest)
            if copies:
                out.append((i, *leaf, t, copies))
    return sorted(out, key=str)


def test_budgets(spark):
    rows = [(k, "w " * (k * 7 % 40), ("en", "de", None)[k % 3], ("src1", "src2", "src12", "src17", None, "other")[k * k % 6]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for plan in (mixing.MixPlan(), mixing.MixPlan(budget_percent=250, max_epochs=4), mixing.MixPlan(budget_percent=900), mixing.MixPlan(budget_percent=5, bucket_digits=1, domain_weights={"forum": 90, "web": 1})):
        got = sorted(((r["doc_id"], r["domain"], r["lang"], r["source"], r["tokens"], r["copies"]) for r in mixing.mix(df, plan).collect()), key=str)
        assert got == brute(rows, plan)


def test_odd_tables(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert {r["lang"] for r in got} <= {"en", "de", "fr", "unknown"}
    assert mixing.mix(no_docs).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None), (2, "", "en", "src1")], "doc_id long, text string, lang string, source string")
    assert all(r["tokens"] == 0 for r in mixing.mix(nothing).collect())


def test_many_leaves_join_by_salt(spark):
    """Beyond broadcast_leaves the same documents come out of the shuffled join."""
    rows = [(k if k % 9 else None, "w " * (k * 5 % 30), ("en", "de")[k % 2], ("src1", "src2", None)[k % 3]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    key = lambda plan: sorted(map(str, mixing.mix(df, plan).collect()))
    assert key(mixing.MixPlan(broadcast_leaves=0)) == key(mixing.MixPlan())


def test_rows_of_one_key(spark):
    """20,000 rows without an id, three tokens each, budget for 16,000 of them."""
    df = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'one two three' text", "'en' lang", "'src1' source")
    for few in (100_000, 0):
        got = mixing.mix(df, mixing.MixPlan(max_epochs=1, broadcast_leaves=few), keep=("text",))
        assert got.count() == 16_000 and got.filter("text = 'one two three' and copies = 1").count() == 16_000
    rows = [(None if k % 3 else k, "w " * (k % 5), "en", "src1") for k in range(600)] * 3
    plan = mixing.MixPlan(bucket_digits=1)
    got = sorted(((r["doc_id"], r["domain"], r["lang"], r["source"], r["tokens"], r["copies"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), plan).collect()), key=str)
    assert got == brute(rows, plan)
