"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into sentences (at line ends, and after full stops and the like before white space).
A sentence is normalised to its lower-case ASCII letters and digits in single spaces.  Known
sentences and headings have an identifier and are matched whole, also where they hold such an end
themselves or are wrapped, in comments too; a sentence that speaks of licences and is not known is
`unknown`, and where it is wrapped, each of its lines that does.
Where an SPDX expression names several licences, each is a sentence of its own.
The identifiers of a text in order are then matched with the licence rules in order: a rule is a
sequence of identifiers, and what it matches is taken, so longer rules stand first.

Everything happens within a row, so nothing is shuffled.

Defined results: null and empty texts have no sentences and no licences; a licence that is matched
again is listed once; repeated rows are rows of their own; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of notices that name them, as published, with
# an identifier each.  Their spelling is normalised below.
SENTENCES = {
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "The MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd3-ref": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "agpl3-ref": ["This work is licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "lgpl3-ref": ["This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc0-ref": ["Licensed under CC0 1.0", "This work is licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released into the public domain"],
    "reserved": ["All rights reserved"],
}

# Headings of licence files and further identifiers, which are known as sentences are.
HEADINGS = {
    "apache-ref": ["Apache License Version 2.0, January 2004"],
    "mit-ref": ["MIT License"],
    "isc-ref": ["ISC License", "The ISC License", "SPDX-License-Identifier: ISC"],
    "gpl2-later-ref": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-later-ref": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "cc-by-ref": ["SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-ref": ["SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-ref": ["SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd-ref": ["SPDX-License-Identifier: CC-BY-ND-4.0"],
    "unlicense": ["SPDX-License-Identifier: Unlicense"],
    "bsd2-ref": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "bsd3-ref": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "gpl2-ref": ["GNU General Public License Version 2, June 1991"],
    "gpl3-ref": ["GNU General Public License Version 3, 29 June 2007"],
    "agpl3-ref": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "lgpl3-ref": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "mpl2-ref": ["Mozilla Public License Version 2.0"],
}

# The licence rules, matched in this order.
RULES = [
    ("Apache-2.0", ["apache-ref", "apache-use", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-ref", "apache-use", "apache-copy"]),
    ("MIT", ["mit-ref", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-ref"]), ("MIT", ["mit-ref"]), ("BSD-2-Clause", ["bsd2-ref"]), ("BSD-3-Clause", ["bsd3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]), ("GPL-3.0", ["gpl3-ref"]), ("AGPL-3.0", ["agpl3-ref"]), ("LGPL-3.0", ["lgpl3-ref"]),
    ("MPL-2.0", ["mpl2-ref"]), ("CC0-1.0", ["cc0-ref"]), ("CC-BY-4.0", ["cc-by-ref"]), ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]), ("CC-BY-ND-4.0", ["cc-by-nd-ref"]), ("Unlicense", ["unlicense"]),
    ("proprietary", ["reserved"]),
]
#: After them, the rules of names that only headings have.
HEADING_RULES = [("ISC", ["isc-ref"]), ("GPL-2.0-or-later", ["gpl2-later-ref"]), ("GPL-3.0-or-later", ["gpl3-later-ref"])]

#: Every known sentence holds one of these, and a sentence that holds one speaks of licences.
MARKS = ["licen", "copyright", "rights reserved", "permission", "redistribut", "permitted", "public domain", "warrant", "copy of the", "prior written"]

#: An identifier expression names several licences: each `A OR` and `A AND` of it ends a sentence.
TAG = "SPDX-License-Identifier:"
EXPRESSION = rf"(?i)(?:({TAG})|\G(?<!\A))([ \t(]*+[\w.+-]++(?:[ \t]++WITH[ \t]++[\w.-]++)?[ \t)]++)(?:OR|AND)(?=[ \t(])"
#: Ends of sentences, in two kinds.  At a pause a known sentence may go on; at a stop only where it has one itself.
#: A line's end is a pause, so that known sentences may be wrapped; a blank line is a stop.
STOP = r"(?<![.;:!?])(?=[:;]*[.!?])[.;:!?]++\s+|(?<!\s)[^\S\n]*\n[^\S\n]*\n\s*"
PAUSE = r"(?<![.;:!?])[:;]++\s+|(?<!\s)\s*\n\s*"
#: What stands for them in a normalised text.
STOPPED, PAUSED = "\x01", "\x02"


def normalised(sentence: str) -> str:
    """The same as `_normal`, for the fixed sentences."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def known_sentences() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    out = {}
    for name, own in [*SENTENCES.items(), *HEADINGS.items()]:
        for s in own:
            if out.setdefault(normalised(s), name) != name:
                raise ValueError(f"{s!r} has two identifiers")
    return out


def known_pattern() -> str:
    """Finds the known sentences, the longest first, and otherwise what stands between two ends."""
    every = {s for own in [*SENTENCES.values(), *HEADINGS.values()] for s in own}
    spelt = {f"[ {STOPPED}{PAUSED}]".join(f"[ {PAUSED}]".join(normalised(p).split()) for p in re.split(STOP, s)) for s in every}
    known = "|".join(sorted(spelt, key=lambda x: (-len(x), x)))
    return f"(?:{known})(?![^{STOPPED}{PAUSED}])|[^{STOPPED}{PAUSED}]+"


def marked(low: Column, marks: list[str] = MARKS) -> Column:
    """Whether a lower-case text speaks of licences."""
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m))
    return out


def _normal(text: Column) -> Column:
    """The lower-case letters and digits of a text, with its ends of sentences."""
    named = F.regexp_replace(F.translate(text, STOPPED + PAUSED, "  "), EXPRESSION, f"$1$2\n\n{TAG}")
    ends = F.regexp_replace(F.regexp_replace(named, STOP, STOPPED), PAUSE, PAUSED)
    spaced = F.regexp_replace(F.lower(ends), f"[^a-z0-9{STOPPED}{PAUSED}]+", " ")
    ends = F.regexp_replace(spaced, f" ?([{STOPPED}{PAUSED}]) ?", "$1")
    # Lines with signs only, as comments have them, are blank.
    return F.trim(F.regexp_replace(ends, f"{PAUSED}{{2,}}", STOPPED))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sentences (identifiers in order), licenses (in order of the rules), n_unknown."""
    text = F.col(text_col).cast("string")
    known = known_sentences()
    wanted = [x for x in known if not any(m in x for m in MARKS)]
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def speaks(s: Column) -> Column:
        return marked(s) | s.isin(wanted) if wanted else marked(s)

    pieces = F.regexp_extract_all(_normal(text), F.lit(known_pattern()), F.lit(0))
    normal = F.filter(F.transform(pieces, lambda s: F.translate(s, STOPPED + PAUSED, "  ")), speaks)
    found = F.transform(normal, lambda s: F.coalesce(F.try_element_at(names, s), F.lit("unknown")))
    empty = F.expr("cast(array() as array<string>)")
    # Most texts lack the marks' words, however these are spaced, and aren't cut up.
    words = sorted({max(m.split(" "), key=len) for m in MARKS})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.when(marked(F.lower(text), words), found).otherwise(empty).alias("sentences"))
    # <a><b> is a sequence of identifiers, =X= a licence that took its place.
    line = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    for name, rule in RULES + HEADING_RULES:
        line = F.replace(line, F.lit("".join(f"<{r}>" for r in rule)), F.lit(f"={name}="))
    rows = rows.withColumn("line", line)
    order = list(dict.fromkeys(name for name, _ in RULES))
    licenses = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f"={n}=")), F.lit(n)) for n in order]))
    return rows.select("id", "sentences", licenses.alias("licenses"), F.size(F.filter("sentences", lambda s: s == "unknown")).cast("long").alias("n_unknown"))
