"""Near-duplicate lines: a segment-partition edit join, on DataFrame functions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import SPACES, let
from tamperscope.llm.components import components
from tamperscope.session import materialize

#: Edits between lines of one class; lines below MIN_CHARS must be equal.
EDITS = 2
MIN_CHARS = 24
#: Lines filed under one segment beyond which they are told apart by their
#: characters too, before they meet. Either way finds the same pairs.
CROWD = 32


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of an even partition
    into edits + 1 segments; the last ones take the remainder."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    longer = F.greatest(length % parts - (parts - i), F.lit(0))  # longer segments before this one
    extra = F.when(length % parts >= parts - i, 1).otherwise(0)
    return short * i + longer + 1, short + extra


def _windows(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where a segment of a line shorter by so
    much can lie in a line within the edits. Edits before the segment and
    after it bound its shift, and together they are at most ``edits``."""
    found = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            after = edits - i
            for shift in range(max(-i, less - after), min(i, less + after) + 1):
                found.append((less, i, shift))
    return found


def _keys(line: Column, length: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """Keys under which a line is filed, and keys that it probes, one per window."""
    filed = []
    for i in range(edits + 1):
        start, size = _segment(length, i, edits)
        filed.append(F.xxhash64(F.lit(i), length, F.substring(line, start, size)))
    probed = []
    for less, i, shift in _windows(edits):
        start, size = _segment(length - less, i, edits)
        probed.append(F.xxhash64(F.lit(i), length - less, F.substring(line, start + shift, size)))
    return filed, probed


def _blocks(line: Column, edits: int) -> Column:
    """Hashes of the characters of a line, without their order, in
    2 * edits + 3 blocks of code points. An edit changes at most two blocks,
    so lines within the edits agree in three blocks or more."""
    n = 2 * edits + 3

    def held(chars: Column, k: int) -> Column:
        return F.hash(F.filter(chars, lambda c: F.ascii(c) * 5 % 31 % n == k))

    return let(F.array_sort(F.split(line, "")), lambda chars: F.array(*[held(chars, k) for k in range(n)]))


def _couples(edits: int) -> list[tuple[int, int]]:
    """Pairs of blocks, one of which any three blocks contain: those within
    either half."""
    n = 2 * edits + 3
    return [*combinations(range(n // 2), 2), *combinations(range(n // 2, n), 2)]


def _by_blocks(crowd: DataFrame, edits: int) -> DataFrame:
    """Each row of ``crowd`` once per couple of blocks, with its number and hash."""
    couples = [F.struct(F.lit(c).alias("couple"), F.hash(F.get("blocks", F.lit(i)), F.get("blocks", F.lit(j))).alias("part"))
               for c, (i, j) in enumerate(_couples(edits))]
    return crowd.select("*", F.explode(F.array(*couples)).alias("by")).select(*crowd.columns, "by.couple", "by.part")


def _agree(a: Column, b: Column, couple: Column, edits: int) -> Column:
    """Whether three blocks agree, and ``couple`` is the first couple to do so."""
    same = [F.get(a, F.lit(i)) == F.get(b, F.lit(i)) for i in range(2 * edits + 3)]
    first = F.coalesce(*[F.when(same[i] & same[j], F.lit(c)) for c, (i, j) in enumerate(_couples(edits))])
    return (sum((x.cast("int") for x in same[1:]), same[0].cast("int")) >= 3) & (first == couple)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``edits``.

    State d is a word whose bit o stands for "the first j characters of b
    become the first j + o - edits of a with d edits"; only this band of
    2 * edits + 1 diagonals can matter. Each character of b moves all bits of
    a word at once: a match keeps the diagonal, a replacement keeps it in the
    next word, an insertion and a deletion go one diagonal down and up.
    """
    width = 2 * edits + 1
    band = (1 << width) - 1
    names = [f"d{d}" for d in range(edits + 1)]

    def closed(rows: list[Column]) -> Column:
        for d in range(1, edits + 1):  # fewer edits, and deletions from a
            rows[d] = rows[d].bitwiseOR(rows[d - 1]).bitwiseOR(F.shiftleft(rows[d - 1], 1)).bitwiseAND(F.lit(band))
        return F.struct(*[r.cast("int").alias(n) for r, n in zip(rows, names, strict=True)])

    start = closed([F.lit(1 << edits)] + [F.lit(0)] * edits)

    def run(ca: Column, cb: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            match = None
            for o in range(width):
                bit = F.when(F.get(ca, j + (o - edits)) == F.get(cb, j), 1 << o).otherwise(0)
                match = bit if match is None else match + bit
            old = [state[n] for n in names]
            rows = [old[0].bitwiseAND(match)]
            for d in range(1, edits + 1):
                rows.append(old[d].bitwiseAND(match).bitwiseOR(old[d - 1]).bitwiseOR(F.shiftright(old[d - 1], 1)))
            # Where nothing is left, nothing comes back.
            return F.when(state[names[-1]] == 0, state).otherwise(closed(rows))

        end = F.get(F.array(*[F.lit(1 << o) for o in range(width)]), F.size(ca) - F.size(cb) + edits)
        last = F.aggregate(F.sequence(F.lit(0), F.size(cb) - 1), start, step, lambda s: s[names[-1]])
        last = F.when(F.size(cb) == 0, start[names[-1]]).otherwise(last)
        return (F.abs(F.size(ca) - F.size(cb)) <= edits) & (last.bitwiseAND(end) != 0)

    def chars(x: Column) -> Column:
        return F.filter(F.split(x, ""), lambda c: c != "")

    return F.when(a == b, True).otherwise(let(chars(a), lambda x: let(chars(b), lambda y: run(x, y))))


def _line_id(line: Column) -> Column:
    return F.xxhash64(line)


#: Characters whose counts are compared before two lines are.
LETTERS = " etaoinsrhldcumfpgwybvkxjqz0123456789"


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS stands in a line."""
    size = F.char_length(line)
    return F.array(*[size - F.char_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def like_letters(a: Column, b: Column, edits: int) -> Column:
    """A bound for lines within so many edits, by their ``letter_counts``: an
    edit changes the counts of at most two letters, by one each."""
    gaps = [F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(len(LETTERS))]
    return sum(gaps[1:], gaps[0]) <= 2 * edits


def line_places(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, id, line) of every line of at least ``min_chars`` characters
    without its outer white space."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split("text", "\n")).alias("raw"))
    lines = each.select("doc_id", F.btrim("raw", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    return lines.select("doc_id", _line_id(F.col("line")).alias("id"), "line")


def _keyed(places: DataFrame, edits: int, min_chars: int = 0) -> DataFrame:
    """One row per id of ``places`` (id, line, others), written: the smallest
    of each other column, the keys ``filed``, and the keys ``probed`` with
    whether they look for lines as long (``same``); lines below ``min_chars``
    have no keys. Only numbers are shuffled."""
    filed, probed = _keys(F.col("line"), F.char_length("line"), edits)
    keys = {f"f{k}": x for k, x in enumerate(filed)} | {f"p{k}": x for k, x in enumerate(probed)}
    others = [c for c in places.columns if c not in ("id", "line")]
    each = places.select("id", *others, F.char_length("line").alias("chars"), *[x.alias(c) for c, x in keys.items()])
    each = each.groupBy("id").agg(*[F.min(c).alias(c) for c in [*others, "chars", *keys]])
    windows = [F.struct(F.col(f"p{k}").alias("key"), F.lit(less == 0).alias("same")) for k, (less, _, _) in enumerate(_windows(edits))]
    long = F.col("chars") >= min_chars
    return materialize(each.select("id", *others, F.when(long, F.array(*[f"f{k}" for k in range(len(filed))])).alias("filed"),
                                   F.when(long, F.array(*windows)).alias("probed")), "line-keys")


def _pairs(keyed: DataFrame, places: DataFrame, edits: int, crowd: int) -> DataFrame:
    """``similar_pairs`` of lines whose keys are written already; ids of
    ``places`` may repeat."""
    index = keyed.select(F.col("id").alias("b"), F.explode("filed").alias("key"))
    probe = keyed.select(F.col("id").alias("a"), F.explode("probed").alias("p")).select("a", "p.*")
    crowded = materialize(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "line-crowds")
    # A crowded key stands once, without a line, and so names those that probe it.
    filed = index.join(crowded, "key", "left_anti").unionByName(crowded.select(F.lit(None).cast("long").alias("b"), "key"))
    # Equally long lines meet both ways round: one way is enough.
    once = "a <> b AND (NOT same OR a > b)"
    met = materialize(probe.join(filed, "key").where(f"b IS NULL OR ({once})"), "line-met")
    few = met.where("b IS NOT NULL").select("a", "b")
    here = index.join(crowded, "key", "left_semi")
    there = met.where("b IS NULL").select("a", "same", "key")

    needed = met.select(F.col("a").alias("id")).union(few.select("b")).union(here.select("b")).distinct()
    # Texts of lines that met another, or a crowd; the rest aren't shuffled.
    found = places.select("id", "line").join(needed, "id", "left_semi")
    texts = found.groupBy("id").agg(F.first("line").alias("line"))
    texts = materialize(texts.select("*", letter_counts(F.col("line")).alias("letters")), "line-texts")

    in_crowds = there.select(F.col("a").alias("id")).union(here.select("b")).distinct()
    blocks = materialize(texts.join(in_crowds, "id", "left_semi").select("id", _blocks(F.col("line"), edits).alias("blocks"), "letters"), "line-blocks")
    left = _by_blocks(there.join(blocks, there["a"] == blocks["id"]).select("a", "same", "key", "blocks", "letters"), edits)
    right = _by_blocks(here.join(blocks, here["b"] == blocks["id"]).select("b", "key", "blocks", "letters"), edits)
    right = right.withColumnRenamed("blocks", "others").withColumnRenamed("letters", "counts")
    many = left.join(right, ["key", "couple", "part"]).where(
        F.expr(once) & _agree(F.col("blocks"), F.col("others"), F.col("couple"), edits)
        & like_letters(F.col("letters"), F.col("counts"), edits)).select("a", "b")

    pairs = few.union(many).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("letters").alias("na")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("letters").alias("nb")), "b")
    alike = like_letters(F.col("na"), F.col("nb"), edits)
    return pairs.where(F.when(alike, within(F.col("la"), F.col("lb"), edits)).otherwise(False)).select("a", "b")


def similar_pairs(lines: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """(a, b) ids of all pairs of different lines (id, line; ids are unique)
    within ``edits`` edits, each pair once.

    A line is filed under the hashes of its edits + 1 segments, with their
    number and its length; so many edits leave one segment whole, and a line
    probes the substrings where a segment of a line as long or shorter can
    lie. Where more than ``crowd`` lines are filed under one segment, lines
    meet only if they also agree in three blocks of characters, which edits
    leave, and nearly in the counts of all letters. Lines that meet are compared once, in full.
    """
    return _pairs(_keyed(lines, edits), lines, edits, crowd)


def kept_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, kept): ids of the lines that a document keeps, for documents
    that keep any. Of each class of lines that chains of ``edits`` edits join,
    one line stays, in the document with the smallest doc_id (null last);
    lines below ``min_chars`` are of one class only where they are equal."""
    places = line_places(docs)
    keyed = _keyed(places, edits, min_chars)
    owners = keyed.select("id", F.col("doc_id").alias("owner"))
    classes = components(materialize(_pairs(keyed, places, edits, CROWD), "line-pairs"))
    members = classes.join(owners, classes["node"] == owners["id"]).select(
        "root", F.struct(F.col("owner").isNull().alias("n"), "owner", "id").alias("line"))
    best = members.groupBy("root").agg(F.min("line").alias("best"))
    dropped = members.join(best, "root").where("line.id <> best.id").select("line.id")
    return owners.join(dropped, "id", "left_anti").groupBy("owner").agg(F.collect_list("id").alias("kept")).select(
        F.struct(F.col("owner").alias("doc_id")).alias("doc"), "kept")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _ids(lines: Column) -> Column:
    """Id of each line, null for blank ones."""
    return F.transform(lines, lambda x: F.when(_trimmed(x) != "", _line_id(_trimmed(x))))


def _stays(ids: Column, k: Column) -> Column:
    """Whether line k stays: blank, or kept here and for the first time."""
    held = F.coalesce(F.array_contains(F.col("kept"), F.get(ids, k)), F.lit(False))
    return F.get(ids, k).isNull() | (held & (F.array_position(ids, F.get(ids, k)) == k + 1))


def _doc() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc")


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, removed) per row of ``docs``: ``removed`` lists the
    repeated lines as (line number from 0, characters), in order.

    Lines are compared without their outer white space. A line is repeated if
    a line of its class stands in a document with a smaller doc_id (null last)
    or earlier in its own; of lines below ``min_chars`` characters only equal
    ones are of one class, and blank lines always stay. Rows of one doc_id count as one document, and so do those without one. A
    null text has no lines, an empty one has one; an empty table gives no
    rows. Lines are told apart by 64-bit hashes. Texts are not shuffled, only
    their line ids.
    """
    kept = kept_lines(docs, edits, min_chars)
    lines = F.split("text", "\n")
    slim = docs.select(_doc(), _ids(lines).alias("ids"), F.transform(lines, F.char_length).alias("sizes"))
    joined = slim.join(kept, "doc", "left")
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    gone = F.filter(places, lambda k: ~_stays(F.col("ids"), k))
    spans = F.transform(gone, lambda k: F.struct(k.alias("line"), F.get("sizes", k).alias("chars")))
    return joined.select("doc.doc_id", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(spans, F.array().cast("array<struct<line:int,chars:int>>")).alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, text, n_removed) per row of ``docs``: ``row`` holds its columns
    as they were, ``text`` the text without its repeated lines (see
    ``removed_lines``); a null text stays null."""
    kept = kept_lines(docs, edits, min_chars)
    joined = docs.select(F.struct("*").alias("row"), _doc()).join(kept, "doc", "left")

    def choose(lines: Column) -> Column:
        return let(_ids(lines), lambda ids: F.filter(lines, lambda _, k: _stays(ids, k)))

    lines = F.split("row.text", "\n")
    done = joined.select("row", F.size(lines).alias("n"), let(lines, choose).alias("left"))
    return done.select("row", F.when(F.col("row.text").isNotNull(), F.array_join("left", "\n")).alias("text"),
                       F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n") - F.size("left")).alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """Numbers and places of the repeated lines of each document."""
    removed = F.col("removed")
    return removed_lines(docs).select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("removed_chars"),
        F.array_join(F.transform(removed, lambda x: x["line"].cast("string")), ",").alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, n_chars brought in
    line, and without documents that lose all their words by it."""
    done = dedup_lines(docs)
    blank = F.btrim(F.col("text"), F.lit(SPACES)) == ""
    left = done.where(F.col("text").isNull() | ~blank | (F.col("n_removed") == 0))
    changed = {"text": F.col("text"), "n_chars": F.when(
        F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[
        changed[c].cast(docs.schema[c].dataType).alias(c) if changed.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])
