"""Licence recognition by sentence rules.

A text is cut into fragments: comment marks and list numbers at the start of lines go; a blank line, or a full stop,
exclamation or question mark before white space, is a hard break; any other line break is a soft one. A fragment is
normalised to its lower-case ASCII words and digits. A known sentence is met where it equals a fragment, or fragments
that follow each other with soft breaks between them only, so a statement on a line of its own is found as well as a
sentence that is wrapped over lines (of several known sentences that begin at a fragment, the longest). A document
becomes its sequence of identifiers, with a gap wherever an unknown fragment stands between two known sentences, and
the ordered rules are matched against that sequence: an earlier rule takes its sentences first, a later one gets what
is left.

The known sentences and the rules are small fixed tables, so they are broadcast. Texts without any word of a set that
covers all known sentences are passed over. Grouping is by row only, and only DataFrame functions are used. Defined
cases: null and empty texts match nothing and give no row; one row per row of docs and licence, with the number of times
the licence's rules matched, so rows that repeat an id or have none are told apart by count only; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower, table

#: Identifiers of known licence sentences, as they read in public licence texts and notices. Sentences whose
#: names agree up to a # share an identifier.
SENTENCES = {
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-4": "See the License for the specific language governing permissions and limitations under the License",
    "apache-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache-asf-1": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "mit-line": "Released under the MIT License",
    "mit-line-2": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-1": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "as-is-2": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-line": "This work is licensed under the GNU General Public License, version 2",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-3": "See the GNU General Public License for more details",
    "gpl-4": "You should have received a copy of the GNU General Public License along with this program",
    "gpl-4-url": "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-3": "See the GNU Lesser General Public License for more details",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3",
    "agpl-3": "See the GNU Affero General Public License for more details",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-4-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-5": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-2h": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2-short": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "boost-1": "Distributed under the Boost Software License, Version 1.0",
    "boost-2": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic-1": "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "artistic-2": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "perl-1": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    "cc0-1": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-2": "This software is distributed without any warranty",
    "cc0-line": "Licensed under CC0 1.0",
    "cc0-line-2": "This work is dedicated to the public domain under CC0 1.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-2": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-1": "This program is free software. It comes without any warranty, to the extent permitted by applicable law",
    "wtfpl-2": "You just DO WHAT THE FUCK YOU WANT TO",
    "reserved": "All rights reserved",
}
#: Licences that are also stated by a short machine-readable line.
SPDX = ["Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT-0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Artistic-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "ISC", "0BSD", "Unlicense"]
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Heads of licence files.
HEADS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC0-1.0": "CC0 1.0 Universal",
}
#: Names that readme files give to licences, and what they say of them.
NAMES = {"MIT": ["MIT"], "Apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0"], "BSD-3-Clause": ["BSD 3-Clause"], "BSD-2-Clause": ["BSD 2-Clause"], "ISC": ["ISC"], "MPL-2.0": ["MPL 2.0"], "GPL-3.0": ["GPL-3.0", "GPLv3", "GNU GPLv3"], "GPL-2.0": ["GPL-2.0", "GPLv2"], "AGPL-3.0": ["AGPL-3.0", "AGPLv3"], "LGPL-3.0": ["LGPL-3.0", "LGPLv3"]}
SAID = ["This project is licensed under the {}", "This project is licensed under the {} - see the LICENSE file for details", "This project is licensed under the {} - see the [LICENSE](LICENSE) file for details", "This project is licensed under the {} - see the [LICENSE.md](LICENSE.md) file for details"]
SENTENCES |= {f"head-{x}": head for x, head in HEADS.items()}
SENTENCES |= {f"said-{x}#{n}-{k}{tail}": said.format(name + tail) for x, names in NAMES.items() for n, name in enumerate(names) for k, said in enumerate(SAID) for tail in ("", " License")}
#: Ordered rules, licence and the identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ["apache-asf-1", "apache-2", "apache-3", "apache-4"]),
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4"]),
    ("Apache-2.0", ["apache-1", "apache-2s", "apache-3", "apache-4"]),
    ("MIT", ["mit-1", "mit-2", "as-is-1", "as-is-2"]),
    ("MIT", ["mit-1", "mit-2", "as-is-1"]),
    ("MIT-0", ["mit-0", "as-is-1"]),
    ("GPL-3.0-or-later", ["gpl-1", "gpl-2", "gpl-3"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-2", "gpl-3"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-2", "lgpl-3"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-2", "lgpl-3"]),
    ("AGPL-3.0-or-later", ["agpl-1", "gpl-2", "agpl-3"]),
    ("BSD-4-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-ads"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4-university"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-5"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("MPL-2.0", ["mpl-1", "mpl-2"]),
    ("MPL-2.0", ["mpl-1", "mpl-2h"]),
    ("MPL-2.0", ["mpl-1", "mpl-2-short"]),
    ("Zlib", ["zlib-1", "zlib-2", "zlib-3"]),
    ("ISC", ["isc-1", "isc-2"]),
    ("0BSD", ["0bsd-1", "isc-2"]),
    ("CC0-1.0", ["cc0-1", "cc0-2"]),
    ("Unlicense", ["unlicense-1", "unlicense-2"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("Apache-2.0", ["apache-1"]),
    ("Apache-2.0", ["apache-asf-1"]),
    ("Apache-2.0", ["apache-line"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-line-2"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-1"]),
    ("GPL-3.0-or-later", ["gpl-1"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-2"]),
    ("GPL-3.0", ["gpl3-line"]),
    ("GPL-2.0", ["gpl2-line"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-program"]),
    ("AGPL-3.0-or-later", ["agpl-1"]),
    ("AGPL-3.0-only", ["agpl-only"]),
    ("BSD", ["bsd-1"]),
    ("BSD", ["bsd-line"]),
    ("MPL-2.0", ["mpl-1"]),
    ("EPL-2.0", ["epl-1"]),
    ("EPL-1.0", ["epl1-1"]),
    ("BSL-1.0", ["boost-2"]),
    ("BSL-1.0", ["boost-1"]),
    ("Zlib", ["zlib-3"]),
    ("Artistic-2.0", ["artistic-1"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ["perl-1"]),
    ("CC0-1.0", ["cc0-1"]),
    ("CC0-1.0", ["cc0-line"]),
    ("CC0-1.0", ["cc0-line-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-long"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-long"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-long"]),
    ("ISC", ["isc-1"]),
    ("Unlicense", ["unlicense-1"]),
    ("WTFPL", ["wtfpl-2"]),
    ("all-rights-reserved", ["reserved"]),
]
RULES += [(x, [f"spdx-{x}"]) for x in SPDX]
RULES += [(x, [f"head-{x}"]) for x in HEADS]
RULES += [(x, [f"said-{x}"]) for x in NAMES]
#: Regular expressions and what replaces each match, in order, on lower-case text: 1 is a hard break, 2 a soft one.
CUTS = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+!?|;+|--+|<!--|\"\"\"|'''|%+|rem\b|dnl\b)+[ \t]*", ""),
    (r"(?m)^[ \t]*\(?(?:[0-9]{1,2}|[a-h]|[ivx]{1,4})[.)][ \t]+", ""),
    (r"\bv\.[ \t]+", "v."),
    (r"\n[ \t]*\n[ \t\n]*", "\x01"),
    (r"[.!?][\"')\]]*(?:[ \t\n]+|$)", "\x01"),
    (r"\n", "\x02"),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r"[ \x02]*\x01[ \x01\x02]*", "\x01"),
    (r" *\x02[ \x02]*", "\x02"),
    (r"^[ \x01\x02]+|[ \x01\x02]+$", ""),
    (r"\x01", "\x02\x01"),
]
#: Words at the head of a sentence that a fragment and the next must share for a closer look.
HEAD = 2


def normal_form(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: How a fragment with an SPDX expression begins, and its operators; `or later` is part of an identifier.
EXPRESSION, OPERATORS, LATER = "spdx license identifier ", " (?:and|or|with) ", (" or later", " orlater")


def fragments(text: str) -> list[str]:
    """The plain version of the cut: normal forms of a text's fragments, with \\x01 before those behind a hard break. An SPDX
    expression is as many fragments as it has identifiers, each behind the words of the first."""
    for pattern, new in CUTS:
        text = re.sub(pattern, new, text)
    out = []
    for x in text.split("\x02") if text else []:
        mark = "\x01" if x.startswith("\x01") else ""
        if x.startswith(mark + EXPRESSION):
            terms = re.split(OPERATORS, x[len(mark + EXPRESSION) :].replace(*LATER))
            out += [(mark if not k else "") + EXPRESSION + t.replace(*LATER[::-1]) for k, t in enumerate(terms)]
        else:
            out.append(x)
    return out


def cover(sentences: list[str]) -> list[str]:
    """A few words of which every sentence has one, those of most sentences first."""
    left, out = [set(s.split()) for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s}, key=lambda w: (-sum(w in s for s in left), -len(w), w))
        best = next((w for w in words if len(w) > 4), words[0])
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def lexicon_rows(known: dict[str, str]) -> list[tuple[str, str, int]]:
    """(head, sentence, number) of each known sentence; its inner stops make no break."""
    number = numbers(known)
    return [(" ".join(s.split()[:HEAD]), s, number[name.split("#")[0]]) for name, s in ((name, normal_form(s)) for name, s in known.items())]


def numbers(known: dict[str, str]) -> dict[str, int]:
    """The number of each identifier."""
    return {name: k for k, name in enumerate(dict.fromkeys(name.split("#")[0] for name in known))}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, license, matches, first_fragment): a row per row of docs and licence that its sentences state."""
    spark, known, rules = docs.sparkSession, sentences or SENTENCES, rules or RULES
    assert len(known) < 10_000, "the lexicon is a small fixed table"
    number = numbers(known)
    rows = lexicon_rows(known)
    lexicon = spark.createDataFrame(rows, "head string, sentence string, sid int")
    longest = max(len(s) for _, s, _ in rows)
    low, some = F.lower(text_col), F.lit(False)
    for word in cover([s for _, s, _ in rows]):
        some = some | F.contains(low, F.lit(word))
    text = ascii_lower(F.col(text_col))
    for pattern, new in CUTS:
        text = F.regexp_replace(text, pattern, new)
    bare = lambda x: F.ltrim(x, F.lit("\x01"))
    terms = lambda x: F.split(F.replace(F.substring(bare(x), F.lit(len(EXPRESSION) + 1), F.length(x)), F.lit(LATER[0]), F.lit(LATER[1])), OPERATORS)
    term = lambda x, t, k: F.concat(F.when((k == 0) & F.startswith(x, F.lit("\x01")), F.lit("\x01")).otherwise(F.lit("")), F.lit(EXPRESSION), F.replace(t, F.lit(LATER[1]), F.lit(LATER[0])))
    each = lambda x: F.when(F.startswith(bare(x), F.lit(EXPRESSION)), F.transform(terms(x), lambda t, k: term(x, t, k))).otherwise(F.array(x))
    texts = docs.where(some).select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.split(text, "\x02").alias("parts"), F.contains(low, F.lit("spdx")).alias("_spdx"))
    texts = texts.withColumn("parts", F.when(F.col("_spdx"), F.flatten(F.transform("parts", each))).otherwise(F.col("parts")))
    # behind a fragment come those that a sentence may go on with, up to the next hard break
    ahead = lambda x, i: F.struct(i.alias("at"), F.substring_index(F.array_join(F.slice("parts", i + 2, F.lit(longest // 2)), "\x02"), "\x01", 1).alias("ahead"), F.ltrim(x, F.lit("\x01")).alias("x"))
    heads = F.array(*[F.lit(h) for h in sorted({h for h, _, _ in rows})])
    two = lambda x, i: F.substring_index(F.concat_ws(" ", F.ltrim(x, F.lit("\x01")), F.coalesce(F.get("parts", i + 1), F.lit(""))), " ", HEAD)
    at = F.transform("parts", lambda x, i: F.when(F.array_contains(heads, two(x, i)), ahead(x, i)))
    found = texts.select("doc_id", "_row", F.inline(F.filter(at, lambda s: s.isNotNull())))
    found = found.withColumn("line", F.substring(F.rtrim(F.concat(F.col("x"), F.lit("\x02"), F.col("ahead")), F.lit("\x02")), 1, longest + 1))
    found = found.withColumn("flat", F.translate("line", "\x02", " ")).withColumn("head", F.substring_index("flat", " ", HEAD)).join(F.broadcast(lexicon), "head")
    size = F.length("sentence")
    ends = (F.length("line") == size) | (F.substring(F.col("line"), size + 1, F.lit(1)) == "\x02")
    taken = F.substring(F.col("line"), F.lit(1), size)
    found = found.where(F.startswith("flat", "sentence") & ends).select("doc_id", "_row", "at", size.alias("size"), "sid", (F.length(taken) - F.length(F.replace(taken, F.lit("\x02"))) + 1).alias("parts"))
    best = found.groupBy("_row", "at").agg(F.max(F.struct("size", "sid", "parts", "doc_id")).alias("b")).select("_row", "at", "b.sid", "b.parts", "b.doc_id")
    seq = best.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "sid", "parts"))).alias("s"), F.min("at").alias("first_fragment"))
    gap = lambda x, i: (i > 0) & (F.get("s", i - 1)["at"] + F.get("s", i - 1)["parts"] != x["at"])
    marks = F.array_join(F.transform("s", lambda x, i: F.concat(F.when(gap(x, i), F.lit("|")).otherwise(F.lit("")), F.lit("<"), x["sid"].cast("string"), F.lit(">"))), "")
    patterns = ["".join(f"<{number[n]}>" for n in names) for _, names in rules]
    steps = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(len(p) - 1).alias("shorter")) for p in patterns])
    start = F.struct(marks.alias("left"), F.array().cast("array<bigint>").alias("n"))

    def matched(so_far, rule):
        left = F.replace(so_far["left"], rule["pattern"], F.lit("|"))
        n = F.floor((F.length(so_far["left"]) - F.length(left)) / rule["shorter"]).cast("long")
        return F.struct(left.alias("left"), F.array_append(so_far["n"], n).alias("n"))

    seq = seq.select("doc_id", F.col("first_fragment").cast("long").alias("first_fragment"), F.aggregate(steps, start, matched, lambda x: x["n"]).alias("n"))
    licences = list(dict.fromkeys(name for name, _ in rules))
    of = lambda name: sum((F.get("n", F.lit(k)) for k, (x, _) in enumerate(rules) if x == name), F.lit(0)).cast("long")
    totals = F.array(*[F.struct(F.lit(name).alias("license"), of(name).alias("matches")) for name in licences])
    return seq.select("doc_id", "first_fragment", F.inline(F.filter(totals, lambda x: x["matches"] > 0))).select("doc_id", "license", "matches", "first_fragment")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    number = numbers(SENTENCES)
    quote = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{head}', '{sentence}', {sid})" for head, sentence, sid in lexicon_rows(SENTENCES))
    longest = max(len(s) for _, s, _ in lexicon_rows(SENTENCES))
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, new in CUTS:
        text = f"regexp_replace({text}, '{quote(pattern)}', {' || '.join(f'chr({ord(c)})' for c in new) if new else chr(39) * 2}, 'g')"
    steps, left = [], "t"
    for k, (_, names) in enumerate(RULES):
        pattern = "".join(f"<{number[n]}>" for n in names)
        kept = ", ".join(["doc_id", "first_fragment", *[f"n_{j}" for j in range(k)]])
        steps.append(f"r{k} AS (SELECT {kept}, (length(left_{k}) - length(replace(left_{k}, '{pattern}', '|'))) // {len(pattern) - 1} AS n_{k}, replace(left_{k}, '{pattern}', '|') AS left_{k + 1} FROM {left})")
        left = f"r{k}"
    totals = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS license, CAST({' + '.join(f'n_{k}' for k, (x, _) in enumerate(RULES) if x == name)} AS BIGINT) AS matches, first_fragment FROM {left}" for name in dict.fromkeys(x for x, _ in RULES))
    return f"""
WITH lex(head, sentence, sid) AS (VALUES {values}),
d0 AS (SELECT row_number() OVER () AS rid, doc_id, string_split({text}, chr(2)) AS parts FROM documents WHERE text IS NOT NULL),
d AS (SELECT rid, doc_id, flatten(list_transform(parts, lambda x: CASE WHEN starts_with(ltrim(x, chr(1)), '{EXPRESSION}')
    THEN list_transform(string_split_regex(replace(substr(ltrim(x, chr(1)), {len(EXPRESSION) + 1}), '{LATER[0]}', '{LATER[1]}'), '{OPERATORS}'), lambda t, k: CASE WHEN k = 1 AND starts_with(x, chr(1)) THEN chr(1) ELSE '' END || '{EXPRESSION}' || replace(t, '{LATER[1]}', '{LATER[0]}')) ELSE [x] END)) AS parts FROM d0),
p AS (SELECT rid, doc_id, unnest(range(len(parts))) AS pos, parts FROM d),
q AS (SELECT rid, doc_id, pos, left(ltrim(parts[pos + 1], chr(1)) || CASE WHEN len(parts) > pos + 1 THEN chr(2) || string_split(array_to_string(parts[pos + 2 : pos + {1 + longest // 2}], chr(2)), chr(1))[1] ELSE '' END, {longest + 1}) AS line0 FROM p),
l AS (SELECT rid, doc_id, pos, rtrim(line0, chr(2)) AS line, replace(rtrim(line0, chr(2)), chr(2), ' ') AS flat FROM q),
f AS (SELECT rid, doc_id, pos, length(sentence) AS size, sid, length(left(line, length(sentence))) - length(replace(left(line, length(sentence)), chr(2), '')) + 1 AS n
      FROM l JOIN lex ON head = array_to_string(string_split(flat, ' ')[1:{HEAD}], ' ') AND starts_with(flat, sentence) AND (length(line) = length(sentence) OR line[length(sentence) + 1] = chr(2))),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rid, pos ORDER BY size DESC, sid DESC) = 1),
g AS (SELECT *, lag(pos + n) OVER (PARTITION BY rid ORDER BY pos) AS after FROM b),
t AS (SELECT any_value(doc_id) AS doc_id, CAST(min(pos) AS BIGINT) AS first_fragment, string_agg(CASE WHEN after <> pos THEN '|' ELSE '' END || '<' || sid || '>', '' ORDER BY pos) AS left_0 FROM g GROUP BY rid),
{", ".join(steps)}
SELECT * FROM ({totals}) WHERE matches > 0
"""


ORACLE = {"op2_license_scan": _oracle()}
