import random

import pytest
from pyspark.sql import functions as F

from tamperscope.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(line, rnd, edits):
    for _ in range(edits):
        i, c = rnd.randrange(len(line)), rnd.choice("xyzé")
        line = rnd.choice([line[:i] + c + line[i:], line[:i] + line[i + 1:], line[:i] + c + line[i + 1:]])
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_distance(spark, edits):
    rnd = random.Random(edits)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.within(F.col("a"), F.col("b"), edits).alias("w"))
    for a, b, w in got.collect():
        assert w == (distance(a, b) <= edits), (a, b)


@pytest.mark.parametrize("edits, crowd", [(1, ld.CROWD), (2, ld.CROWD), (1, 0), (2, 1), (3, 1)])
def test_join_finds_every_near_pair(spark, edits, crowd):
    rnd = random.Random(7 + edits)
    lines = ["".join(rnd.choice("ab cdé") for _ in range(rnd.randint(6, 40))) for _ in range(40)]
    lines += [edited(x, rnd, rnd.randint(1, 4)) for x in lines for _ in range(4)]
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = sorted((r.a, r.b) for r in ld.similar_pairs(df, edits, crowd).collect())
    want = sorted((i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if distance(a, b) <= edits)
    assert got == want


def test_crowd_of_variants(spark):
    """Many lines that share segments: whole words changed, and some letters."""
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(14)]
    lines = set()
    for _ in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = "".join(rnd.choice("abcdéh") for _ in range(rnd.randint(2, 6)))
        lines.add(edited(" ".join(words), rnd, rnd.choice([0, 0, 1])))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = sorted((r.a, r.b) for r in ld.similar_pairs(df, 2, 8).collect())
    assert got == sorted((i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if distance(a, b) <= 2)


def plain_dedup(rows, edits, min_chars):
    """Texts without repeated lines, by comparing all lines."""
    strip = " \t\n\x0b\x0c\r"
    lines = sorted({x.strip(strip) for _, t in rows for x in (t or "").split("\n") if x.strip(strip)})
    label = list(range(len(lines)))
    near = [(i, j) for i in range(len(lines)) for j in range(i)
            if min(len(lines[i]), len(lines[j])) >= min_chars and abs(len(lines[i]) - len(lines[j])) <= edits and distance(lines[i], lines[j]) <= edits]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    group = dict(zip(lines, label, strict=True))
    owner = {}
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            g = group.get(x.strip(strip))
            if g is not None:
                owner[g] = min(owner.get(g, (True, 0)), (doc_id is None, doc_id or 0))
    return group, owner


def test_query_against_brute_force(make_docs):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choice(["one", "twö", "three", "four", "five"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 9)))
            for _ in range(60)]
    rows = [(5, None), (6, ""), (7, "\n\n"), (8, "short\nshort")]
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(1, 8))]
        lines = [edited(x, rnd, rnd.choice([0, 0, 0, 1, 2, 5])) if len(x) > 5 else x for x in lines]
        rows.append((100 + 3 * i, rnd.choice(["\n", " \n\t"]).join(lines)))
    rows += [(None, rows[10][1]), (None, "a line that stands in no other document"), (900, rows[20][1]), (103, "x" * 50)]
    docs = make_docs(rows)
    group, owner = plain_dedup(rows, ld.EDITS, ld.MIN_CHARS)
    strip = " \t\n\x0b\x0c\r"
    got = [(r["row"]["doc_id"], r["row"]["text"], r["text"], r["n_removed"]) for r in ld.dedup_lines(docs).collect()]
    assert sorted(map(repr, ((g[0], g[1]) for g in got))) == sorted(map(repr, rows))
    kept, report = {}, []
    for doc_id, before, after, n_removed in got:
        if before is None:
            assert after is None and n_removed == 0
            report.append((doc_id, 0, 0, 0, ""))
            continue
        lines, seen, gone = before.split("\n"), set(), []
        for k, x in enumerate(lines):
            line = x.strip(strip)
            g = group.get(line)
            if g is None:
                continue
            if owner[g] == (doc_id is None, doc_id or 0) and line not in seen and (g not in kept or kept[g] == (doc_id, line)):
                # one line of a class stays: whichever, it is the first of its kind in the owner
                if line in after.split("\n") or any(y.strip(strip) == line for y in after.split("\n")):
                    kept[g] = (doc_id, line)
                    seen.add(line)
                    continue
            gone.append(k)
        assert after == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert n_removed == len(gone)
        report.append((doc_id, len(lines), len(gone), sum(len(lines[k]) for k in gone), ",".join(map(str, gone))))
    assert set(kept) == set(group.values())
    assert sorted(map(repr, map(tuple, ld.line_report(docs).collect()))) == sorted(map(repr, report))
    assert ld.line_report(docs.limit(0)).count() == 0


def test_stage_keeps_columns_and_drops_emptied(make_docs):
    line = "a line of more than twenty-four characters"
    docs = make_docs([(1, line), (2, line), (3, line + "\nand more of it, long enough to count"), (4, ""), (5, None), (2, line)])
    out = ld.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [
        (1, line, len(line)), (3, "and more of it, long enough to count", 36), (4, "", 0)]
    assert ld.drop_repeated_lines(docs.limit(0)).count() == 0
