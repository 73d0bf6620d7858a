import random
import re
from collections import Counter

import duckdb
import pandas as pd

from tamperscope.llm import line_frequency as lf

STRIP = " \t\n\x0b\x0c\r"


def plain(rows):
    def tokens(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]

    hosts, holders = {}, {}
    for i, (_, text, source) in enumerate(rows):
        lines = [x.strip(STRIP) for x in (text or "").lower().split("\n") if x.strip(STRIP)]
        if lines:
            hosts.setdefault(source, set()).add(i)
        for x in lines:
            holders.setdefault((source, x), set()).add(i)
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        w = tokens(t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        many = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(STRIP)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        low = [x.strip(STRIP) for x in t.lower().split("\n") if x.strip(STRIP)]
        left = sum(len(x) for x in low if not (
            len(holders[source, x]) > lf.MAX_DOCUMENTS and len(holders[source, x]) > lf.MAX_SHARE * len(hosts[source])))
        depleted = left < lf.MIN_LEFT * sum(map(len, low))
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
                    failed, not failed and not depleted))
    return out


def corpus():
    rnd = random.Random(12)
    vocab = [f"wörd{i}" for i in range(90)]
    common = " ".join(vocab[:60])
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n", None), (4, "# * $ % & | < > ok", "a"), (5, "a b c a b c", "a")]
    for i in range(150):
        body = "\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 4)))
        if i % 3 == 0:
            body = rnd.choice([common, common.upper(), f"  {common}\t"]) + "\n" + (body if i % 2 else f"tail {i}")
        rows.append((10 + i, body, rnd.choice(["h1", "h1", "h2", None])))
    rows += [(500 + i, common + "\nsame copy", "h3") for i in range(60)]
    rows += [(None, "x " * 80, "h1"), (5, "a b c a b c", "a"), (900, "y z " * 8_000, "h2")]
    return rows


def test_query_and_sql_against_brute_force(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    want = sorted(map(repr, plain(rows)))
    assert any(r[7] for r in plain(rows)) and any(not r[6] and not r[7] for r in plain(rows))
    got = lf.quality_rules(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  read by name
    assert sorted(repr(tuple(r)) for r in duckdb.sql(lf.quality_sql("frame")).fetchall()) == want
    assert lf.quality_rules(docs.limit(0)).count() == 0


def test_copies_are_documents_and_frequent_lines_go(make_docs):
    footer = " ".join(f"all{i} pages" for i in range(40))
    copies = [(i, f"{footer}\nrest of the page " + "w " * 5, "h") for i in range(500)]
    own = [(1000 + i, " ".join(f"own{i}x{j}" for j in range(60)) + f"\n  {footer.upper()} \nlast", "h") for i in range(5)]
    docs = make_docs(copies + own + [(2000, None, "h"), (2001, "", "h")])
    kept = {r.doc_id: r.kept for r in lf.quality_rules(docs).collect()}
    assert not any(kept[i] for i in range(500)) and all(kept[1000 + i] for i in range(5))
    texts = {r.row.doc_id: (r.text, r.n_removed) for r in lf.without_frequent_lines(docs).collect()}
    assert texts[3] == ("", 2) and texts[2000] == (None, 0) and texts[2001] == ("", 0)
    assert texts[1002] == (" ".join(f"own2x{j}" for j in range(60)) + "\nlast", 1)
