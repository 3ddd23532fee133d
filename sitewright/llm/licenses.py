"""License scans by sentence rules.

Known licence sentences have identifiers; a licence is recognised by identifiers in a given order, whatever
stands between them. A text is cut at line ends and after full stops, semicolons and colons, lower-cased and
reduced to letters and digits. A known sentence is a run of its words that begins and ends where the text is
cut; cuts within it do not count, so wrapping at any column, marks of comments and punctuation do not hide it.
The sentences of a text are found by one pattern, from left to right, the longest first; the text's identifiers
are then matched against the rules. A rule whose identifiers all lie within a longer rule that matched counts
only if they occur once more.

Each row is scanned by itself: no row moves, and nothing is gathered. Only texts that contain one of the CUES
(each known sentence does) are cut at all. Null text counts as empty. Rows repeated with equal ids are scanned
each. Texts without a rule's sequence give no rows. Of an empty table the result is empty. Other columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled

# Sentences of public licences and references to them, and the sequences that identify one.
SENTENCES = {
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-ref": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref-short": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-terms": "This project is licensed under the terms of the Apache License 2.0.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-ref": "Released under the BSD License.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-ref": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-ref": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-ref": "Licensed under CC BY-ND 4.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-ref": "Licensed under CC0 1.0.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "cddl": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-free": "This program is free software:",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-long": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl-free": "This library is free software;",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-ref": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-ref": "Released under the MIT License.",
    "mit-ref-licensed": "Licensed under the MIT License.",
    "mit-terms": "This project is licensed under the terms of the MIT license.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mpl11": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
}
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
RULES = (
    ("AGPL-3.0", ("agpl3-ref",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-redistribute")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-ref-short", "apache-may-not", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-terms",)),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-style", ("bsd-ref",)),
    ("BSD-style", ("bsd-style",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CDDL", ("cddl",)),
    ("EPL-1.0", ("epl1",)),
    ("EPL-2.0", ("epl2",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only-long")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-redistribute")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-redistribute")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-old",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-redistribute")),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-redistribute")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-redistribute")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("MIT", ("mit-terms",)),
    ("MPL-1.1", ("mpl11",)),
    ("MPL-2.0", ("mpl2",)),
    ("OFL-1.1", ("ofl",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    *((x, (f"spdx-{x.lower()}",)) for x in SPDX),
)
CUES = ("license", "permission", "redistribut", "software", "copyright", "warrant", "licence")


def known() -> dict[str, str]:
    """The words of each known sentence, joined by spaces, and its identifier; the longest first."""
    every = SENTENCES | {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
    words = {" ".join(re.findall("[a-z0-9]+", text.lower())): name for name, text in every.items()}
    return dict(sorted(words.items(), key=lambda x: (-len(x[0]), x[0])))


#: What cuts a text, and what is no word; SQL uses the same patterns.
CUT, LINES, OTHER, EDGE = r"([.;:])[ \t\n\x0B\f\r]+", r"[\n\r]+", r"[^\p{L}\p{N}\n]+", r" *\n[ \n]*"


def lines(text: Column) -> Column:
    """The words of a text, a line end where it is cut, else a space between two."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), CUT, "$1\n"), LINES, "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, OTHER, " "), EDGE, "\n"), F.lit(" \n"))


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order, each in angle brackets."""
    names = known()
    pattern = "(?<![^\n])(?:" + "|".join(x.replace(" ", "[ \n]") for x in names) + ")(?![^\n])"
    of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.regexp_extract_all(lines(text), F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), F.element_at(of, F.translate(x, "\n", " ")), F.lit(">"))), "")


def within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def outer(name: str, seq: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The rules of other licences that a rule lies within, the longest first."""
    return sorted((long for other, long in RULES if other != name and within(seq, long)), key=lambda x: (-len(x), x))


def like(seq: tuple[str, ...]) -> str:
    return "%" + "".join(f"<{x}>%" for x in seq)


def spans(seq: tuple[str, ...], group: str) -> tuple[str, str]:
    """A pattern for the identifiers of a rule with what stands between, and what is left without them."""
    return "(.*?)".join(f"<{x}>" for x in seq), "".join(group + str(i) for i in range(1, len(seq)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, sentences (identifiers of the text, in order) for each licence of each row."""
    text = filled(F.col(text_col).cast("string"))
    some = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.col("text").rlike("(?i)" + "|".join(CUES)))
    found = some.select("id", identifiers(F.col("text")).alias("line")).where("line <> ''")
    hits = []
    for name, seq in RULES:
        line = F.col("line")
        for long in outer(name, seq):
            line = F.regexp_replace(line, *spans(long, "$"))
        hits.append(F.when(line.like(like(seq)), F.lit(name)))
    names = F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    shown = F.trim(F.replace(F.translate("line", "<", " "), F.lit(">"), F.lit("")))
    return found.select(F.col("id").alias(id_col), F.explode(names).alias("license"), shown.alias("sentences"))


def sql(table: str = "documents") -> str:
    """The same for `scan` over a table, for an engine whose patterns look neither ahead nor back: line ends are
    doubled, so that a sentence can take one on each side."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = known()
    gap = r"(?: |\n\n)"
    pattern = r"\n(?:" + "|".join(x.replace(" ", gap) for x in names) + r")\n"
    of = "MAP {" + ", ".join(f"{quote(words)}: {quote(name)}" for words, name in names.items()) + "}"
    hits = []
    for name, seq in RULES:
        line = "line"
        for long in outer(name, seq):
            at, left = spans(long, "\\")
            line = f"regexp_replace({line}, {quote(at)}, {quote(left)}, 'g')"
        hits.append(f"CASE WHEN {line} LIKE {quote(like(seq))} THEN {quote(name)} END")
    return f"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), {quote(CUT)}, '\\1' || chr(10), 'g'), {quote(LINES)}, chr(10), 'g') AS t FROM {table}),
        w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, {quote(OTHER)}, ' ', 'g'), {quote(EDGE)}, chr(10), 'g'), ' ' || chr(10)) AS w FROM t),
        f AS (SELECT doc_id, regexp_extract_all(chr(10) || replace(w, chr(10), chr(10) || chr(10)) || chr(10), {quote(pattern)}) AS found FROM w),
        n AS (SELECT doc_id, [{of}[trim(regexp_replace(x, '\\n+', ' ', 'g'))] for x in found] AS names FROM f WHERE len(found) > 0),
        l AS (SELECT doc_id, array_to_string(names, ' ') AS sentences, array_to_string(['<' || x || '>' for x in names], '') AS line FROM n)
        SELECT doc_id, unnest(list_distinct([x for x in [{", ".join(hits)}] if x IS NOT NULL])) AS license, sentences FROM l"""
