import random
import re

import duckdb
import pytest

from tamperscope.llm import license_scan as ls


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text):
    words = words_of(text)
    joined = "".join(f"<{w}>" for w in words)
    base = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    matched = {label for label, ms in ls.TEMPLATES.items() for m in ms if re.search(ls._pattern(ls.parse(m)), joined)}
    names = {x for _, x in base}
    at = [i for i, _ in base]
    labels = names | matched
    backed = sum(any(m.startswith(x) for m in matched) for x in labels)
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)),
            ",".join(sorted(labels)), 0.5 + 0.5 * backed / len(labels) if labels else 0.0)


def corpus():
    rnd = random.Random(4)
    bits = sorted({w for ms in ls.TEMPLATES.values() for m in ms for w in re.sub("<<[^>]*>>", " ", m).split()})
    frequent = ["licensed", "under", "the", "cc", "by", "nc", "4", "0", "general", "public", "license", "gnu", "version", "3", "all",
                "rights", "reserved", "mit", "apache", "no", "part", "of", "this", "work", "may", "be", "reproduced", "é"]
    texts = [None, "", "...", "CC-BY", "cc by cc by", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
             "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "Released under the MIT Licence.", "All rights reserved.", "ccé by", "cc\x00by", "filler " * 30_000 + "all rights reserved",
             "All rights reserved by A. No part of this work may be reproduced", ls._MIT_GRANT.replace("<<opt>>", "").replace("<<end>>", ""),
             re.sub("<<opt>>.*?<<end>>", "", ls._MIT_GRANT, flags=re.S), ls._MIT_GRANT.replace("free of charge", "for a charge")]
    for _ in range(500):
        texts.append(rnd.choice([" ", "-", ", "]).join(rnd.choice(rnd.choice([bits, frequent, frequent])) for _ in range(rnd.randint(1, 60))))
    for label, ms in ls.TEMPLATES.items():
        for m in ms:  # an accepted text of each template, then one with a mandatory word changed
            full = re.sub(r"<<any:(\d+),\d+>>", lambda k: " x" * int(k[1]), re.sub(r"<<var:([^|>]*)[^>]*>>", r"\1", m))
            full = re.sub("<<opt>>|<<end>>", "", full)
            texts += [f"before {full} after", re.sub(r"\b(license|copyright|under|this|4)\b", "other", full)]
    return texts


def test_query_against_expressions(make_docs):
    rows = list(enumerate(corpus())) + [(None, "cc by"), (4, "cc by cc by")]
    got = {}
    for r in ls.scan(make_docs(rows)).collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    for doc_id, text in rows:
        assert got[doc_id] == {plain(text)}, text
    assert "mit" in next(iter(got[15]))[5] and "mit" in next(iter(got[16]))[5] and "mit" not in next(iter(got[17]))[5]
    assert ls.scan(make_docs(rows).limit(0)).count() == 0


def test_sql_twin(make_docs):
    rows = list(enumerate(corpus()))
    docs = make_docs(rows).select("doc_id", "text").toPandas()  # noqa: F841  read by name
    want = duckdb.sql(ls.scan_sql("docs")).fetchall()
    assert sorted(want) == sorted((i, *plain(t)) for i, t in rows)


def test_markup_errors():
    with pytest.raises(ValueError):
        ls.parse("a <<opt>> b")
    with pytest.raises(ValueError):
        ls.parse("a <<other>> b")


@pytest.mark.parametrize(("text", "label"), [
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2.", "gpl-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("# SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("MIT License\n\nCopyright (c) 2020 A. Person", "mit"), ("BSD 3-Clause License\n\nCopyright (c) 2019", "bsd-3-clause"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
])
def test_own_notices_of_licenses(text, label):
    words = ls._WORDS.findall(text.lower().encode())
    assert ls.Automaton(ls.TEMPLATES).accepted(words) == {label}
