"""License scans by sentence rules.

Sentences are normalised (lower case, runs of other than a-z and 0-9 as one
space) and looked up among known licence sentences. Sentences end at a stop before
white space, at a blank line, and before a numbered or bulleted clause. The identifiers found in a
text, in order, are matched against ordered rules: each rule is a sequence of
identifiers, and what an earlier rule has matched is not open to later ones. A
text is read twice, by lines and by sentences that may run over lines; the larger
count of a rule is its result. JVM expressions only.

Edge cases: null and empty texts, and texts without a known sentence, have no
licence and empty strings; repeated rows each get their row; extra columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

# Sentences of public licences and usual notices.
SENTENCES = {
    "mit_notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit_keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as_is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache_notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0"],
    "apache_comply": ["you may not use this file except in compliance with the License."],
    "apache_basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl3_notice": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl_free": ["This program is free software"],
    "gpl3_terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2_terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "mpl_notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ccbync_notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ccby_notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ccbysa_notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "apache_head": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache_copyright": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "gpl_everyone": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3_free": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2_terms_apply": ["This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."],
    "lgpl_free": ["This library is free software"],
    "lgpl21_terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3_adds": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "lgpl_notice": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl3_terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3_free": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "agpl_notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "mpl_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl_grant": ["Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license"],
    "epl_accept": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")."],
    "epl_notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"],
    "zlib_as_is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib_origin": ["The origin of this software must not be misrepresented"],
    "cc0_dedicate": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "cc0_notice": ["SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0."],
    "bsl_grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: In order: whole licences before notices.
RULES = [
    ("MIT", ["mit_grant", "mit_keep", "as_is"]),
    ("MIT", ["mit_grant", "mit_keep"]),
    ("MIT", ["mit_notice"]),
    ("ISC", ["isc_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache_notice", "apache_comply", "apache_basis"]),
    ("Apache-2.0", ["apache_head", "apache_copyright"]),
    ("Apache-2.0", ["apache_notice"]),
    ("AGPL-3.0", ["gpl_everyone", "agpl3_free"]),
    ("AGPL-3.0", ["gpl_free", "agpl3_terms"]),
    ("AGPL-3.0", ["agpl_notice"]),
    ("LGPL-2.1", ["lgpl_free", "lgpl21_terms"]),
    ("LGPL-2.1", ["lgpl_notice"]),
    ("LGPL-3.0", ["gpl_everyone", "lgpl3_adds"]),
    ("GPL-3.0", ["gpl_everyone", "gpl3_free"]),
    ("GPL-2.0", ["gpl_everyone", "gpl2_terms_apply"]),
    ("GPL-3.0", ["gpl_free", "gpl3_terms"]),
    ("GPL-2.0", ["gpl_free", "gpl2_terms"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("MPL-2.0", ["mpl_notice", "mpl_copy"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("MPL-2.0", ["mpl_grant"]),
    ("EPL-2.0", ["epl_accept"]),
    ("EPL-2.0", ["epl_notice"]),
    ("Zlib", ["zlib_as_is", "zlib_grant", "zlib_origin"]),
    ("CC0-1.0", ["cc0_dedicate"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("CC-BY-NC-4.0", ["ccbync_notice"]),
    ("CC-BY-4.0", ["ccby_notice"]),
    ("CC-BY-SA-4.0", ["ccbysa_notice"]),
    ("Unlicense", ["unlicense"]),
]
#: Every known sentence contains one of these, so other texts aren't split at all.
ANCHORS = "[Ll][Ii][Cc][Ee][Nn][Ss]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Ss][Oo][Ff][Tt][Ww][Aa][Rr][Ee]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb][Uu][Tt]|[Ee][Nn][Dd][Oo][Rr][Ss][Ee]|[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|[Rr][Ee][Pp][Rr][Oo][Dd][Uu][Cc][Tt][Ii][Oo][Nn]|MPL|mpl"
BREAKS = {"line": r"[\r\n]+", "sentence": r"[.!?;:][ \t\r\n\f]+|\r?\n[ \t]*\r?\n[ \t\r\n\f]*|\n[ \t]*(?:[*-]|[0-9]+[.)])[ \t]+"}


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces() -> dict[str, str]:
    """Normalised sentence to identifier. A sentence with inner breaks is listed by its parts too, its last part unnamed."""
    out = {}
    for name, forms in SENTENCES.items():
        for form in forms:
            parts = [normal(x) for x in re.split(BREAKS["sentence"], form)]
            if len(parts) == 1 or len(parts[0].split()) >= 4:
                out[parts[0]] = name
            out[normal(form)] = name
    return out


def _sequence(text: Column, at: str) -> Column:
    """' id id id ' of the known sentences of a text."""
    known = F.create_map(*(F.lit(x) for kv in pieces().items() for x in kv))
    parts = F.transform(F.split(text, at, -1), lambda s: F.element_at(known, F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))))
    # two spaces between identifiers, so that neighbouring matches of one rule don't share one
    return F.concat(F.lit(" "), F.array_join(F.filter(parts, lambda x: x.isNotNull()), "  "), F.lit(" "))


def _pattern(ids: list[str]) -> str:
    return " " + "  ".join(ids) + " "


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids_line, ids_sentence, licences, unmatched): licences as name:count in order of the rules, unmatched the identifiers no rule took."""
    named = docs.select(id_col, text_or_empty(text_col).alias("text"))
    has = F.col("text").rlike(ANCHORS)
    df = named.select(id_col, *(F.when(has, _sequence(F.col("text"), rx)).otherwise(F.lit("  ")).alias(f"ids_{k}") for k, rx in BREAKS.items()))
    left = {k: F.col(f"ids_{k}") for k in BREAKS}
    counts: dict[str, Column] = {}
    for i, (name, ids) in enumerate(RULES):
        rx = _pattern(ids)
        n = F.greatest(*(F.size(F.regexp_extract_all(f"left_{k}", F.lit(rx), F.lit(0))) for k in BREAKS)) if i else F.greatest(*(F.size(F.regexp_extract_all(left[k], F.lit(rx), F.lit(0))) for k in BREAKS))
        df = df.withColumns({f"n_{i}": n} | {f"left_{k}": F.regexp_replace(f"left_{k}" if i else f"ids_{k}", rx, "") for k in BREAKS})
        counts[name] = counts[name] + F.col(f"n_{i}") if name in counts else F.col(f"n_{i}")
    said = F.concat_ws(",", *(F.when(c > 0, F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in counts.items()))
    tidy = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    return df.select(id_col, *(tidy(f"ids_{k}").alias(f"ids_{k}") for k in BREAKS), said.alias("licences"), tidy("left_sentence").alias("unmatched"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in pieces().items())
    seqs = []
    for k, rx in BREAKS.items():
        e = rx.replace("\\", "\\")
        seqs.append(f"""s_{k} as (select doc_id, string_agg(id, '  ' order by i) as ids from (
          select doc_id, i, trim(regexp_replace(lower(parts[i]), '[^a-z0-9]+', ' ', 'g')) as s from (
            select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split_regex(t, '{e}') as parts from d))) x
          join known on known.s = x.s group by doc_id)""")
    steps, last = [], "r0"
    steps.append(f"r0 as (select d.doc_id, {', '.join(f"' ' || coalesce(s_{k}.ids, '') || ' ' as ids_{k}, ' ' || coalesce(s_{k}.ids, '') || ' ' as left_{k}" for k in BREAKS)} from d {' '.join(f'left join s_{k} on s_{k}.doc_id = d.doc_id' for k in BREAKS)})")
    terms: dict[str, list[str]] = {}
    for i, (name, ids) in enumerate(RULES):
        rx = _pattern(ids)
        n = ", ".join(f"len(regexp_extract_all(left_{k}, '{rx}', 0))" for k in BREAKS)
        steps.append(f"r{i + 1} as (select * exclude ({', '.join(f'left_{k}' for k in BREAKS)}), greatest({n}) as n_{i}, {', '.join(f"regexp_replace(left_{k}, '{rx}', '', 'g') as left_{k}" for k in BREAKS)} from {last})")
        last = f"r{i + 1}"
        terms.setdefault(name, []).append(f"n_{i}")
    said = ", ".join(f"case when {' + '.join(t)} > 0 then '{name}:' || cast({' + '.join(t)} as varchar) end" for name, t in terms.items())
    tidy = lambda c: f"trim(regexp_replace({c}, ' +', ' ', 'g'))"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), known(s, id) as (values {known}), {', '.join(seqs)}, {', '.join(steps)}
    select doc_id, {', '.join(f'{tidy(f"ids_{k}")} as ids_{k}' for k in BREAKS)}, concat_ws(',', {said}) as licences, {tidy('left_sentence')} as unmatched from {last}"""


ORACLE_SQL = _sql()
