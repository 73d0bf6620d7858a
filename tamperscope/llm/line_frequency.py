"""Quality rules with cross-document line frequency, on DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import SPACES, let, text_hash, words
from tamperscope.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50
#: A line is frequent in a host if more documents than this hold it ...
MAX_DOCUMENTS = 20
#: ... and more than this share of the host's documents.
MAX_SHARE = 0.01
#: A document keeps at least this share of its characters, or is rejected.
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"


def _repeat_words(tokens: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Window hashes are
    sorted with their positions only where one occurs again."""

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda g, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == g["h"]))
                         | F.coalesce(F.get(ordered, k + 1)["h"] == g["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda g: F.array(g["i"], g["i"] + 1, g["i"] + 2)))))

    def windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, covered))

    def hashed(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(tokens) < 3, 0).otherwise(let(hashed(tokens), windows))


def text_measures(text: Column) -> Column:
    """Struct of the base counts of a text; a null text has none of anything."""
    plain = F.coalesce(text, F.lit(""))

    def left_by(chars: str) -> Column:
        return F.char_length(F.translate(plain, chars, ""))

    lines = F.filter(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        left_by(SPACES).cast("long").alias("word_chars"),
        (F.char_length(plain) - left_by(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))


def _key() -> Column:
    return F.struct(F.col("source").cast("string").alias("host"), text_hash(F.col("text")).alias("text_key")).alias("doc")


def _line_hash(raw: Column) -> Column:
    """Hash of a line in lower case without outer white space; null where no word is left."""
    return let(F.btrim(F.lower(raw), F.lit(SPACES)), lambda x: F.when(x != "", F.xxhash64(x)))


def host_lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, line, chars, copies): hashes of the lines with a word of each
    different text of a host, in lower case and without outer white space, and
    how many documents of the host have the text."""
    each = docs.select(_key(), F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "raw"))
    trimmed = each.select("doc", "pos", F.btrim("raw", F.lit(SPACES)).alias("x")).where("x <> ''")
    hashed = trimmed.select("doc", "pos", F.xxhash64("x").alias("line"), F.char_length("x").alias("chars"))
    # Counted before the shuffle: copies of a text are one row per task.
    return hashed.groupBy("doc", "pos", "line", "chars").agg(F.count(F.lit(1)).alias("copies"))


def marked_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host_lines`` with a mark on those that more than ``max_documents``
    documents, and more than ``max_share`` of those with a line, of their host hold."""
    lines = materialize(host_lines(docs), "host-lines")
    # (host, line, text) first, so that a line of a third of all documents is
    # counted by many tasks.
    seen = lines.groupBy("doc.host", "line", "doc.text_key").agg(F.max("copies").alias("copies"))
    counts = seen.groupBy("host", "line").agg(F.sum("copies").alias("n")).where(F.col("n") > max_documents)
    texts = lines.groupBy("doc").agg(F.max("copies").alias("copies"))
    hosts = texts.groupBy("doc.host").agg(F.sum("copies").alias("documents"))
    keyed_hosts = hosts.select(F.struct("host").alias("h"), "documents")
    frequent = counts.withColumn("h", F.struct("host")).join(keyed_hosts, "h").where(F.col("n") > max_share * F.col("documents"))
    frequent = frequent.select(F.struct("host", "line").alias("at"), F.lit(True).alias("frequent"))
    return lines.withColumn("at", F.struct("doc.host", "line")).join(frequent, "at", "left").drop("at")


def depleted_documents(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE,
                       min_left: float = MIN_LEFT) -> DataFrame:
    """(doc, removed_chars, line_chars): documents, by host and text, whose
    lines hold less than ``min_left`` of their characters once the frequent
    lines of their host are removed."""
    marked = marked_lines(docs, max_documents, max_share)
    sums = marked.groupBy("doc").agg(F.sum(F.when(F.col("frequent"), F.col("chars")).otherwise(0)).alias("removed_chars"),
                                     F.sum("chars").alias("line_chars"))
    return sums.where(F.col("line_chars") - F.col("removed_chars") < min_left * F.col("line_chars"))


def without_frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(row, text, n_removed) per row of ``docs``: ``row`` holds its columns as
    they were, ``text`` the text without the frequent lines of its host, other
    lines as they stand; a null text stays null."""
    gone = marked_lines(docs, max_documents, max_share).where("frequent").groupBy("doc").agg(F.collect_set("line").alias("gone"))
    joined = docs.select(F.struct("*").alias("row"), _key()).join(gone, "doc", "left")
    lines = F.split("row.text", "\n")
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("gone", _line_hash(x)), F.lit(False)))
    kept = joined.select("row", F.size(lines).alias("n"), F.when(F.col("gone").isNull(), lines).otherwise(stays).alias("left"))
    return kept.select("row", F.when(F.col("row.text").isNotNull(), F.array_join("left", "\n")).alias("text"),
                       F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n") - F.size("left")).alias("n_removed"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict of every whole text of ``docs``.

    ``base_failed`` marks texts of few words or of mostly repeated words.
    Others are kept unless frequent lines deplete them: a line is frequent
    where more than MAX_DOCUMENTS documents, and more than MAX_SHARE of all
    with a line, of one host (``source``; null is a host of its own) hold it;
    copies of a text are documents of their own. On a host of a million
    documents the share decides: a line is frequent from 10,000 on. Null and blank texts have no words and fail; a null
    doc_id and repeated rows are documents like others; other columns are not read.
    """
    gone = depleted_documents(docs).select("doc", "removed_chars")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), text_measures(F.col("text")).alias("m"))
    flat = base.select("doc_id", "doc", "m.*").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return flat.join(gone, "doc", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("removed_chars").isNull()).alias("kept"))


def quality_sql(table: str = "documents") -> str:
    """The rules as SQL, on strings instead of hashes."""
    space = "[\\x20\\x09-\\x0D]+"
    trim = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    spaces = f"({trim})"
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, source, text, coalesce(text, '') t FROM {table}),
w AS (SELECT *, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') ws FROM d),
tok AS (SELECT rid, i, x, lead(x, 1) OVER (PARTITION BY rid ORDER BY i) y, lead(x, 2) OVER (PARTITION BY rid ORDER BY i) z
  FROM (SELECT rid, unnest(ws) x, generate_subscripts(ws, 1) i FROM w)),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) c FROM tok WHERE z IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) p FROM win WHERE c > 1) GROUP BY rid),
base AS (SELECT w.rid, doc_id, source, text, CAST(len(ws) AS BIGINT) n_words,
  CAST(length(translate(t, {spaces}, '')) AS BIGINT) word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {spaces}) <> '') ls, coalesce(rep.n, 0) n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
ln AS (SELECT rid, source, trim(x, {spaces}) line FROM (SELECT rid, source, unnest(string_split(lower(text), chr(10))) x FROM d)
  WHERE trim(x, {spaces}) <> ''),
hosts AS (SELECT source, count(DISTINCT rid) n FROM ln GROUP BY source),
freq AS (SELECT ln.source, line FROM ln JOIN hosts h ON ln.source IS NOT DISTINCT FROM h.source GROUP BY ln.source, line, h.n
  HAVING count(DISTINCT rid) > {MAX_DOCUMENTS} AND count(DISTINCT rid) > {MAX_SHARE} * h.n),
gone AS (SELECT rid FROM ln LEFT JOIN freq f ON ln.source IS NOT DISTINCT FROM f.source AND ln.line = f.line GROUP BY rid
  HAVING sum(CASE WHEN f.line IS NULL THEN length(ln.line) ELSE 0 END) < {MIN_LEFT} * sum(length(ln.line)))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines,
  CAST(n_repeat_words AS BIGINT) n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND g.rid IS NULL kept
FROM base b LEFT JOIN gone g ON b.rid = g.rid"""
