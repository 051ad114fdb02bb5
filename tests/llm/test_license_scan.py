import random
import textwrap

import duckdb
import pandas as pd


from tessera.llm import license_scan as M

S = M.SENTENCES
MIT = S["mit-1"] + "\n" + S["mit-2"] + ". " + S["as-is-1"] + "."
APACHE = ".\n".join(S[f"apache-{k}"] for k in (1, 2, 3, 4)) + "."
GPL2 = ". ".join(S[x] for x in ("gpl2-later", "gpl-2", "gpl-3")) + "."
BSD = S["bsd-1"] + "\n\n1. " + S["bsd-2"] + ".\n2. " + S["bsd-3"] + ".\n"


def plain(text):
    """The definition, fragment by fragment."""
    known = {s: k for _, s, k in M.lexicon_rows(S)}
    names = list(M.numbers(S))
    parts = M.fragments("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    seq, at, after = [], 0, None
    for at in range(len(parts)):
        best = None
        for end in range(at + 1, len(parts) + 1):
            if end - 1 > at and parts[end - 1].startswith("\x01"):
                break
            joined = " ".join(p.lstrip("\x01") for p in parts[at:end])
            if joined in known:
                best = (known[joined], end)
        if best:
            if after is not None and after != at:
                seq.append("|")
            seq.append(names[best[0]])
            after = best[1]
    found = {}
    for name, rule in M.RULES:
        at = 0
        while at + len(rule) <= len(seq):
            if seq[at : at + len(rule)] == rule:
                found[name] = found.get(name, 0) + 1
                seq[at : at + len(rule)] = ["|"]
            at += 1
    return found


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for block in text.split("\n") for line in (textwrap.wrap(block, width) or [""]))


TEXTS = [
    None, "", "Nothing here.", "Released under the MIT License.", "  released under the mit license!! \n\nAll rights reserved.", MIT, MIT.replace("\n", "\nSomething else.\n"), APACHE,
    "\n".join(S[f"gpl-{k}"] for k in (1, 2)), "All rights reserved.\nAll rights reserved.", "words " * 30_000 + "\nLicensed under CC BY 4.0", "This is free and unencumbered software released into the public domain.",
    wrapped(MIT, 76), wrapped(APACHE, 60, " * "), "/*\n" + wrapped(APACHE, 71, " * ") + "\n */\nint main;", wrapped(GPL2, 50, "# "), "Copyright (c) 2020 Somebody\n" + wrapped(MIT, 65), wrapped(MIT, 65).replace("\n", "\r\n"),
    wrapped(BSD, 70), wrapped(BSD + "3. " + S["bsd-4"] + ".\n\n" + S["bsd-5"] + ".", 70, "// "), wrapped(BSD + S["bsd-5"] + ".", 70), wrapped(S["mpl-1"] + ". " + S["mpl-2"], 60, "-- "),
    "// SPDX-License-Identifier: GPL-2.0-or-later\ncode();", "Licensed under the Apache License,\n\nVersion 2.0", wrapped(S["lgpl21-later"] + ".\n\n" + S["lgpl-2"] + ". " + S["lgpl-3"] + ".", 72, "    "), "Licensed under the Apache License, Version 2.0\nand more of it",
    "one\ntwo licensed\nunder the MIT License\nthree", "Licensed\nunder\nthe\nMIT\nLicense", wrapped(S["cc0-1"] + ". " + S["cc0-2"] + ".", 40),
    "# SPDX-License-Identifier: Apache-2.0 OR MIT\ncode", "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND (MIT OR ISC OR Zlib)", "spdx-license-identifier: mit or later",
    "This project is licensed under the MIT License - see the LICENSE file for details", "Text. This project is licensed under the Apache 2.0 license - see the\n[LICENSE.md](LICENSE.md) file for details.", "This project is licensed under the GPLv3.",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n",
]


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, {})[r.license] = r.matches
    return out


def test_sequences_match_rules(make_docs):
    got = found(M.license_scan(make_docs(list(enumerate(TEXTS)))).collect())
    assert got == {k: x for k, t in enumerate(TEXTS) if (x := plain(t))}
    assert got[5] == got[12] == got[16] == got[17] == {"MIT": 1} and got[7] == got[13] == got[14] == {"Apache-2.0": 1}
    assert got[15] == {"GPL-2.0-or-later": 1} and got[18] == {"BSD-2-Clause": 1} and got[19] == {"BSD-3-Clause": 1} and got[20] == {"BSD-2-Clause": 1}
    assert got[21] == {"MPL-2.0": 1} and got[22] == {"GPL-2.0-or-later": 1} and got[24] == {"LGPL-2.1-or-later": 1} and got[28] == {"CC0-1.0": 1}
    assert 23 not in got and got[25] == {"Apache-2.0": 1} and 26 not in got and got[27] == {"MIT": 1}


def test_every_known_sentence_is_met_alone_and_wrapped(make_docs):
    for width in (300, 45):
        texts = [wrapped(s, width) for s in S.values()]
        assert all(" ".join(x.lstrip("\x01") for x in M.fragments(t.lower())).strip() for t in texts)
        got = found(M.license_scan(make_docs(list(enumerate(texts)))).collect())
        assert got == {k: x for k, t in enumerate(texts) if (x := plain(t))}


def test_rows_that_repeat_an_id_are_counted_apart(make_docs):
    rows = [(1, GPL2), (1, "x. " + GPL2), (1, MIT), (None, MIT), (None, MIT)]
    got = sorted(map(str, M.license_scan(make_docs(rows)).collect()))
    assert len(got) == 5 and sum("MIT" in r for r in got) == 3


def test_empty_table(make_docs):
    assert M.license_scan(make_docs([])).collect() == []


def test_its_sql(make_docs):
    rng = random.Random(3)
    texts = TEXTS + [wrapped(" ".join(rng.choice(list(S.values())) + rng.choice((".", "!", "\n\n", "\n", " more.")) for _ in range(6)), rng.choice((40, 72, 500)), rng.choice(("", "# ", "// "))) for _ in range(60)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = duckdb.sql(M.ORACLE["op2_license_scan"])
    want = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in M.license_scan(make_docs(list(enumerate(texts)))).collect()]
    order = lambda r: (r["doc_id"], r["license"])
    assert sorted(got, key=order) == sorted(want, key=order) and len(got) > 60




def test_the_forms_that_most_repositories_carry(spark, make_docs):
    said = {"# SPDX-License-Identifier: Apache-2.0 OR MIT": {"Apache-2.0", "MIT"}, "This project is licensed under the MIT License - see the LICENSE file for details": {"MIT"}, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": {"GPL-3.0"}, "Apache License\n   Version 2.0, January 2004\n": {"Apache-2.0"}, "SPDX-License-Identifier: MIT AND (ISC OR GPL-3.0-or-later)": {"MIT", "ISC", "GPL-3.0-or-later"}}
    got = M.license_scan(make_docs(list(enumerate(said)))).collect()
    assert {(r.doc_id, r.license) for r in got} == {(k, x) for k, v in enumerate(said.values()) for x in v}
