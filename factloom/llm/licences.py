"""Licence scans by sentence rules.

A text is cut into sentences, each normalised to its lower-case letters and digits. Sentences that are known get
an identifier; a licence is recognised where the identifiers follow the order of one of its rules, with a bounded number of other
sentences between. Texts are cut twice, with line ends as sentence ends and as spaces, so both notices on
a line of their own and hard-wrapped licence texts are read; a rule that either reading meets counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import id_and_text

# Sentences of public licences and of their usual notices, as they are published.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-notice-full": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-short": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0",
    "ccbync4-notice-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ccby4-notice": "Licensed under CC BY 4.0",
    "ccby4-notice-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense-head": "This is free and unencumbered software released into the public domain",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
#: Licence: the ordered sequences of sentences, any of which recognises it.
RULES = {
    "Apache-2.0": [["apache2-notice"], ["apache2-notice-full", "apache2-comply"], ["apache2-as-is", "apache2-see"]],
    "BSD-2-Clause": [["bsd-head", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "CC-BY-4.0": [["ccby4-notice"], ["ccby4-notice-long"]],
    "CC-BY-NC-4.0": [["ccbync4-notice"], ["ccbync4-notice-long"]],
    "CC-BY-SA-4.0": [["ccbysa4-notice"]],
    "GPL-2.0-or-later": [["gpl-free", "gpl2-terms"]],
    "GPL-3.0": [["gpl3-notice"], ["gpl3-notice-short"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl3-terms"]],
    "ISC": [["isc-grant"]],
    "MIT": [["mit-notice"], ["mit-notice-licensed"], ["mit-title", "mit-grant"], ["mit-grant", "mit-keep"]],
    "MPL-2.0": [["mpl2-notice"]],
    "Unlicense": [["unlicense-head", "unlicense-grant"]],
}
#: A licence is not reported beside one that includes its rule.
INCLUDED = {"BSD-2-Clause": "BSD-3-Clause"}
#: Other sentences that may stand between two of a rule.
GAP = 3
END = r"[.!?:;]+[\x22')\]]*[\x20\x09-\x0D]+"
MARK = "|"


def plain(sentence: str) -> str:
    return " ".join("".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in sentence.lower()).split())


#: Normalised sentence: a letter that stands for its identifier in a text's sequence.
CODES = {plain(v): chr(ord("A") + i) if i < 26 else chr(ord("a") + i - 26) for i, v in enumerate(SENTENCES.values())}
LETTER = {k: CODES[plain(v)] for k, v in SENTENCES.items()}


def rule_pattern(licence: str) -> str:
    return "|".join(f".{{0,{GAP}}}".join(LETTER[s] for s in rule) for rule in RULES[licence])


def sequences(text: Column) -> list[Column]:
    """A letter for each known sentence of the text, - for each other one: with line ends as sentence ends, and as spaces."""
    cut = F.regexp_replace(F.concat(F.lower(F.replace(text, F.lit(MARK), F.lit(" "))), F.lit(".\n")), END, MARK)
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    out = []
    for t in (F.regexp_replace(cut, r"[\x0A\x0D]+", MARK), cut):
        sentences = F.split(F.regexp_replace(t, f"[^a-z0-9{MARK}]+", " "), r"\x20*\|\x20*")
        out.append(F.array_join(F.transform(sentences, lambda s: F.coalesce(F.try_element_at(known, F.ltrim(s)), F.lit("-"))), ""))
    return out


def licences(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, licenses (names in order, comma-joined), n_licenses, sentence_ids (identifiers as they occur, comma-joined).

    A null text counts as empty: no licence. A very long text is read whole, by its task. Rows that repeat a doc_id are separate documents. Only doc_id and
    text are read, so no column can clash. An empty table gives no rows.
    """
    rows = id_and_text(docs)
    by_line, by_stop = sequences(F.col("text"))
    rows = rows.select("doc_id", by_line.alias("a"), by_stop.alias("b"))
    met = {k: F.col("a").rlike(rule_pattern(k)) | F.col("b").rlike(rule_pattern(k)) for k in sorted(RULES)}
    shown = [F.when(met[k] & ~met[INCLUDED[k]] if k in INCLUDED else met[k], F.lit(k)) for k in sorted(RULES)]
    names = F.create_map(*[F.lit(x) for k, v in LETTER.items() for x in (v, k)])
    ids = F.array_join(F.transform(F.filter(F.split(F.when(F.col("a").rlike("[A-Za-z]"), F.col("a")).otherwise(F.col("b")), ""), lambda x: x.rlike("[A-Za-z]")), lambda x: F.element_at(names, x)), ",")
    found = F.array_compact(F.array(*shown))
    return rows.select("doc_id", F.array_join(found, ",").alias("licenses"), F.size(found).cast("long").alias("n_licenses"), ids.alias("sentence_ids"))


def oracle() -> str:
    """DuckDB SQL for licences()."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in CODES.items()) + "}"
    names = "MAP {" + ", ".join(f"{q(v)}: {q(k)}" for k, v in LETTER.items()) + "}"
    letters = lambda t: f"array_to_string(list_transform(regexp_split_to_array(regexp_replace({t}, '[^a-z0-9|]+', ' ', 'g'), ' *[|] *'), lambda s: coalesce({known}[ltrim(s)], '-')), '')"
    met = {k: f"(regexp_matches(a, {q(rule_pattern(k))}) OR regexp_matches(b, {q(rule_pattern(k))}))" for k in RULES}
    cases = ", ".join(f"CASE WHEN {met[k]}" + (f" AND NOT {met[INCLUDED[k]]}" if k in INCLUDED else "") + f" THEN {q(k)} END" for k in sorted(RULES))
    return f"""
WITH c AS (SELECT doc_id, regexp_replace(concat(lower(replace(coalesce(text, ''), '|', ' ')), '.' || chr(10)), {q(END)}, '|', 'g') AS cut FROM documents),
s AS (SELECT doc_id, {letters("regexp_replace(cut, '[\\x0A\\x0D]+', '|', 'g')")} AS a, {letters("cut")} AS b FROM c),
f AS (SELECT doc_id, list_filter([{cases}], lambda x: x IS NOT NULL) AS found, CASE WHEN regexp_matches(a, '[A-Za-z]') THEN a ELSE b END AS seq FROM s)
SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string(found, ',') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses,
       array_to_string(list_transform(list_filter(string_split(seq, ''), lambda x: regexp_matches(x, '[A-Za-z]')), lambda x: {names}[x]), ',') AS sentence_ids
FROM f
"""
