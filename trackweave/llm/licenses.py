"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other than letters, digits and
full stops inside numbers become one space) and mapped to the identifier of a known licence
sentence. A sentence may go on over line breaks and comment leaders, up to a full stop, a blank line or a line that
is a known sentence by itself. The identifiers in order of appearance then run through ordered rules; the first rule whose
sequence occurs, adjacent, names the licence, its identifiers are consumed, and the rest is matched again
by the later rules. A line that declares an SPDX expression has the identifier `SPDX:` and a licence for each licence that the expression joins by `or`, `and` or `with`; these name the licences by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: How the notices of the GNU licences begin and go on; the part before a semicolon is a sentence of its own.
FREE = r"(this \S+ is free software )?you can redistribute it and or modify it under the terms of the "
FSF = r" as published by the free software foundation,? (either )?"
#: Identifier and pattern of a whole normalised sentence. The alternatives of a pattern start with a trigger word's sentence.
SENTENCES = (
    ("ApacheVer", r"(this \S+ is )?licensed under the apache license,? version 2(\.0)?( the license)?"),
    ("ApacheNotice", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at( http.*)?"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("MITRelease", r"(this \S+ is )?(released|licensed|distributed) under the (terms of the )?mit license"),
    ("MITPermission", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITCondition", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("AsIs", r"the software is provided as is without warranty of any kind.*"),
    ("GPLv3", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? version 3(\.0)?( or any later version)?"),
    ("GPLv2", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? version 2(\.0)?( or any later version)?"),
    ("LGPL3Free", rf"{FREE}gnu lesser general public license{FSF}version 3.*"),
    ("LGPL21Free", rf"{FREE}gnu lesser general public license{FSF}version 2\.1.*"),
    ("LGPL2Free", rf"{FREE}gnu (lesser|library) general public license{FSF}version 2.*"),
    ("AGPL3Free", rf"{FREE}gnu affero general public license{FSF}version 3.*"),
    ("GPL3Free", rf"{FREE}gnu general public license{FSF}version 3.*"),
    ("GPL2Free", rf"{FREE}gnu general public license{FSF}version 2.*"),
    ("LGPLFree", rf"{FREE}gnu (lesser|library) general public license( as published by the free software foundation)?"),
    ("AGPLFree", rf"{FREE}gnu affero general public license( as published by the free software foundation)?"),
    ("GPLOnly", rf"{FREE}gnu general public license( as published by the free software foundation)?"),
    ("Either3", r"either version 3 of the license.*"),
    ("Either21", r"either version 2\.1 of the license.*"),
    ("Either2", r"either version 2 of the license.*"),
    ("GPLFree", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("LGPL", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?gnu (lesser|library) general public license.*"),
    ("CCBYNC4", r"(this \S+ is )?licensed under (a )?(cc by nc|creative commons attribution noncommercial) 4\.0( international)?( license)?"),
    ("CCBYSA4", r"(this \S+ is )?licensed under (a )?(cc by sa|creative commons attribution sharealike) 4\.0( international)?( license)?"),
    ("CCBY4", r"(this \S+ is )?licensed under (a )?(cc by|creative commons attribution) 4\.0( international)?( license)?"),
    ("CCBYSA3", r"(this \S+ is )?licensed under (a |the )?(cc by sa|creative commons attribution share ?alike) 3\.0( unported)?( license)?"),
    ("CCBY3", r"(this \S+ is )?licensed under (a |the )?(cc by|creative commons attribution) 3\.0( unported)?( license)?"),
    ("Artistic2", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?(artistic license,? (version )?2\.0|the artistic license 2\.0)"),
    ("BSDAdvert", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("BSDRedist", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSDEndorse", r"neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("AGPLv3", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?gnu affero general public license.*"),
    ("MPL2", r"this source code form is subject to the terms of the mozilla public license( v| v\.? ?2(\.0)?)?"),
    ("MPL2Under", r"(this \S+ is )?(licensed|released|distributed) under the (terms of the )?mozilla public license,? (v|version)\.? ?2(\.0)?"),
    ("EPL2", r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (v|v |version )?2(\.0)?.*"),
    ("ISCPermission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ZlibPermission", r"permission is granted to anyone to use this software for any purpose including commercial applications.*"),
    ("BSLPermission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software.*"),
    ("UnlicenseDomain", r"this is free and unencumbered software released into the public domain"),
    ("CC0", r"(this \S+ is )?(licensed|released|dedicated) (under|to the public domain under) (the )?cc0 1\.0( universal)?( license)?"),
    ("SPDX", r"spdx license identifier .*"),
    ("Copyright", r"(copyright|all rights reserved).*"),
)
#: What stands before a declared identifier, normalised.
DECLARED = "spdx license identifier "
#: Between the licences of an expression.
JOINS = "(?:^| +)(?:or|and|with)(?: +|$)"
#: Licence and its sequence of identifiers, the longest and most specific first.
RULES = (
    ("Apache-2.0", ("ApacheVer", "ApacheNotice", "ApacheCopy", "ApacheAsIs")),
    ("MIT", ("MITPermission", "MITCondition", "AsIs")),
    ("BSD-4-Clause", ("BSDRedist", "BSDAdvert", "BSDEndorse")),
    ("BSD-4-Clause", ("BSDRedist", "BSDAdvert")),
    ("BSD-3-Clause", ("BSDRedist", "BSDEndorse")),
    ("Apache-2.0", ("ApacheVer",)),
    ("MIT", ("MITRelease",)),
    ("MIT", ("MITPermission",)),
    ("GPL-3.0", ("GPLv3",)),
    ("GPL-2.0", ("GPLv2",)),
    ("LGPL-3.0", ("LGPL3Free",)),
    ("LGPL-2.1", ("LGPL21Free",)),
    ("LGPL-2.0", ("LGPL2Free",)),
    ("AGPL-3.0", ("AGPL3Free",)),
    ("GPL-3.0", ("GPL3Free",)),
    ("GPL-2.0", ("GPL2Free",)),
    ("LGPL-3.0", ("LGPLFree", "Either3")),
    ("LGPL-2.1", ("LGPLFree", "Either21")),
    ("LGPL-2.0", ("LGPLFree", "Either2")),
    ("AGPL-3.0", ("AGPLFree", "Either3")),
    ("GPL-3.0", ("GPLOnly", "Either3")),
    ("GPL-2.0", ("GPLOnly", "Either2")),
    ("LGPL", ("LGPLFree",)),
    ("AGPL-3.0", ("AGPLFree",)),
    ("GPL", ("GPLOnly",)),
    ("GPL", ("GPLFree",)),
    ("LGPL", ("LGPL",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC-BY-SA-3.0", ("CCBYSA3",)),
    ("CC-BY-3.0", ("CCBY3",)),
    ("Artistic-2.0", ("Artistic2",)),
    ("BSD-2-Clause", ("BSDRedist",)),
    ("AGPL-3.0", ("AGPLv3",)),
    ("MPL-2.0", ("MPL2",)),
    ("MPL-2.0", ("MPL2Under",)),
    ("EPL-2.0", ("EPL2",)),
    ("ISC", ("ISCPermission",)),
    ("Zlib", ("ZlibPermission",)),
    ("BSL-1.0", ("BSLPermission",)),
    ("Unlicense", ("UnlicenseDomain",)),
    ("CC0-1.0", ("CC0",)),
)
#: A sentence ends at a full stop, question or exclamation mark or semicolon before white space or the end, and at a blank line.
END = r"[.!?;]+(?=\s|$)"
#: Every pattern of SENTENCES has one of these in any sentence that it matches.
TRIGGER = r"licens|public domain|permission|warranty|redistribut|copyright|all rights reserved|endorse"


#: Starts of lines that are no text: punctuation, and the words that begin a comment in m4 and in batch files.
LEADER = r"(?md)^[^a-z0-9\n]*(?:(?:dnl|rem)\b[^a-z0-9\n]*)?"
#: A later line of a sentence may begin so; it is no copyright line.
GOES_ON = r"(?<![|])copyright[ \n](?:notice|holder|owner|law|licen[cs]e|protection|interest|statement|permission)"


def _over_lines(pattern: str) -> str:
    """The pattern of a sentence in text() that may go on over line breaks; its last .* ends with a line."""
    body, tail = (pattern[:-2], r"[^\n|\x01]*") if pattern.endswith(".*") else (pattern, "")
    return body.replace(".*)", r"[^\n|]*)").replace(".*", "[^|\x01]*").replace(r"\S", r"[^\s|\x01]").replace(" ", r"[ \n]") + tail


#: Known sentences on a line of their own, and over lines.
LINE = "|".join(p.replace(".*", r"[^\n|]*").replace(r"\S", r"[^\s|]") for i, p in SENTENCES if i != "Copyright")
KNOWN = rf"(?<=[\n|\x01])(?!{GOES_ON})({'|'.join(_over_lines(p) for _, p in SENTENCES)})(?=[\n|])"


def normalised(text: Column) -> Column:
    """The text's words with one space, one line feed or, where a sentence ends, | between them; \\x01 stands before a line that is a known sentence."""
    for pattern, by in (
        (r"\r\n?", "\n"), (LEADER, ""), (END, "\n\n"), (r"[^a-z0-9.\n]+", " "), (r"\.(?![0-9])|(?<![0-9])\.", ""), (r" *\n *", "\n"), (r"\n\n+|^\n?|\n?\z", "|"),
        (rf"(?<=[\n|])(?=(?:{LINE})[\n|])", "\x01"),
    ):
        text = F.regexp_replace(F.lower(text) if pattern == r"\r\n?" else text, pattern, by)
    return text


def declared(sentence: Column) -> Column:
    """SPDX:a,SPDX:b of a normalised line that declares an expression of a and b, its words joined by hyphens; null if none is left."""
    names = F.split(F.trim(F.replace(F.substring(sentence, F.lit(len(DECLARED) + 1), F.length(sentence)), F.lit(" or later"), F.lit("-or-later"))), JOINS)
    names = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("SPDX:"), F.replace(n, F.lit(" "), F.lit("-"))))
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def sentence_id(sentence: Column) -> Column:
    """Identifier of a normalised sentence, or null; the first pattern wins."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        value = F.lit(name) if name != "SPDX" else declared(sentence)
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), value).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids ("a,b,..." in order of appearance) and licenses (sorted, distinct, comma-joined) of every row.

    Null, empty and unlicensed texts: both columns are ''. Repeated rows are kept. Texts are read whole;
    a text without any trigger word has no known sentence and is not cut up. Extra columns are ignored.
    """
    hits = F.transform(F.regexp_extract_all(normalised(F.col("text")), F.lit(KNOWN), F.lit(1)), lambda s: sentence_id(F.translate(s, "\n", " ")))
    ids = F.when(F.lower(F.col("text")).rlike(TRIGGER.replace(" ", "[^a-z0-9]+")), F.array_join(F.filter(hits, lambda x: x.isNotNull()), ",")).otherwise("")
    x = docs.select("doc_id", F.coalesce(ids, F.lit("")).alias("sentence_ids"))
    x = x.withColumn("_rest", F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(",")))
    found = []
    for i, (name, sequence) in enumerate(RULES):
        key = ",," .join(sequence)
        x = x.withColumn(f"_r{i}", F.when(F.col("_rest").contains(f",{key},"), F.lit(name)))
        x = x.withColumn("_rest", F.replace("_rest", F.lit(f",{key},"), F.lit("|")))
        found.append(f"_r{i}")
    spdx = F.regexp_extract_all("sentence_ids", F.lit("SPDX:([^,]+)"), F.lit(1))
    return x.select("doc_id", "sentence_ids", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*found), spdx)))), ",").alias("licenses"))


#: declared() of n in DuckDB.
DECLARED_SQL = f"nullif(array_to_string(list_transform(list_filter(string_split_regex(trim(replace(substr(n, {len(DECLARED) + 1}), ' or later', '-or-later')), '{JOINS}'), lambda x: x <> ''), lambda x: 'SPDX:' || replace(x, ' ', '-')), ','), '')"


def scan_sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    norm = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.([^0-9]|$)', '\1', 'g'), '(^|[^0-9])\.', '\1', 'g'))"
    case = "case " + " ".join(f"when regexp_full_match(n, '{quoted(p)}') then " + (f"'{i}'" if i != "SPDX" else DECLARED_SQL) for i, p in SENTENCES) + " end"
    rest, steps = "r0", []
    for i, (_name, sequence) in enumerate(RULES):
        key = "," + ",,".join(sequence) + ","
        steps.append(f"t{i + 1} as (select *, contains(r{i}, '{key}') h{i}, replace(r{i}, '{key}', '|') r{i + 1} from t{i})")
    found = ", ".join(f"case when h{i} then '{name}' end" for i, (name, _) in enumerate(RULES))
    return f"""
    with q as (select row_number() over () rid, doc_id, coalesce(text, '') txt from documents),
    s as (select rid, unnest(string_split_regex(regexp_replace(txt, '[.!?;]+(\\s|$)', chr(10), 'g'), '[\\r\\n]+')) s, generate_subscripts(string_split_regex(regexp_replace(txt, '[.!?;]+(\\s|$)', chr(10), 'g'), '[\\r\\n]+'), 1) k from q where regexp_matches(lower(txt), '{TRIGGER}')),
    n as (select rid, k, {norm} n from s where regexp_matches(lower(s), '{TRIGGER}')),
    i as (select rid, string_agg(id, ',' order by k) ids from (select rid, k, {case} id from n) where id is not null group by rid),
    t0 as (select doc_id, coalesce(ids, '') sentence_ids, ',' || replace(coalesce(ids, ''), ',', ',,') || ',' r0 from q left join i using (rid)),
    {', '.join(steps)}
    select doc_id, sentence_ids, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat([{found}], regexp_extract_all(sentence_ids, 'SPDX:([^,]+)', 1)), lambda x: x is not null))), ','), '') licenses from t{len(RULES)}"""
