"""Quality rules: statistics of a text, and cross-document line frequency.

Lines are normalised and hashed; a line that stands in more documents of one host than a limit is boilerplate there and
is removed; a document of which too little is left is rejected. Every row is a document and counts once for a line, however
often the line stands in it. So a text with more copies on a host than the limit is boilerplate as a whole; where such texts
are to stay, copies are removed first.

All of it is DataFrame code. Inside a row, arrays and higher-order functions do the work, so no text is ever exploded
into windows; across rows only line hashes are shuffled, summed up in the map tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, stage, table, text_of

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line may stand in so many documents of a host; a document must keep this share of its words.
MAX_DOCUMENTS_PER_HOST, MIN_KEPT_SHARE = 20, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur at least twice in the text.

    Windows are compared by 64-bit hash. Most texts have no repeated window, which one hash set tells; only the others
    sort their windows to find the places.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(hs: Column) -> Column:
        found = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k, step: F.coalesce(F.get(s, k + step)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(twin(x, k, -1) | twin(x, k, 1), x["i"])), lambda p: p.isNotNull()))

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

        return let(let(found, places), union)

    total = lambda w: let(hashes(w), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(0))
    return F.when(F.size(words) > window, total(words)).otherwise(0).cast("long")


def text_stats(text: Column) -> Column:
    """A struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")

    def stats(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), stats)


def normalised_lines(text: Column) -> Column:
    """The lines that hold a word, as structs of hash ``h`` and word count ``w``; case, spacing and digits don't count."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " "), "[0-9]", "0"))
    one = lambda x: let(clean(x), lambda y: F.struct(F.xxhash64(y).alias("h"), (F.length(y) - F.length(F.replace(y, F.lit(" "))) + 1).alias("w")))
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), one)


def text_key(text: Column) -> list[Column]:
    """128 hash bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")]


def removed_words(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS_PER_HOST) -> DataFrame:
    """``host, k1, k2, removed``: for each text of each host that has boilerplate lines, the words in them."""
    rows = docs.select(F.col(host).cast("string").alias("host"), *text_key(text_of()), normalised_lines(text_of()).alias("lines"))
    texts = stage(rows.groupBy("host", "k1", "k2").agg(F.any_value("lines").alias("lines"), F.count(F.lit(1)).alias("copies")), "lines")
    once = texts.select("host", "copies", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    hot = once.groupBy("host", "h").agg(F.sum("copies").alias("n")).where(F.col("n") > max_documents).drop("n")
    each = texts.select("host", "k1", "k2", F.inline("lines")).alias("e")
    hot = hot.alias("t")
    found = each.join(hot, F.col("e.host").eqNullSafe(F.col("t.host")) & (F.col("e.h") == F.col("t.h"))).select("e.*")
    return found.groupBy("host", "k1", "k2").agg(F.sum("w").cast("long").alias("removed"))


def judge(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS_PER_HOST, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """Statistics and verdict for each row of ``docs``.

    Gives ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept``.
    ``kept`` is false for texts under 20 words, for texts with over 30 % of their words in repeated windows, and for
    texts that keep less than ``min_kept_share`` of their words once the host's boilerplate lines are gone.

    Null and empty texts have no words and fail the base. A null host is a host of its own. Repeated rows are judged
    one by one and alike. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), *text_key(text_of()), text_stats(text_of()).alias("s")).alias("d")
    gone = removed_words(docs, host, max_documents).alias("g")
    same = F.col("d.host").eqNullSafe(F.col("g.host")) & (F.col("d.k1") == F.col("g.k1")) & (F.col("d.k2") == F.col("g.k2"))
    out = rows.join(gone, same, "left").select("doc_id", "s.*", F.coalesce("removed", F.lit(0)).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = F.col("n_words") - F.col("removed_words") >= min_kept_share * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM docs),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM parts)),
places AS (
  SELECT r, i, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, sum(n)::BIGINT AS n FROM places GROUP BY r),
lines AS (
  SELECT source, text, count(*) AS copies, trim(regexp_replace(regexp_replace(lower(unnest(any_value(lines))), '[{SPACE}]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line
  FROM parts GROUP BY source, text),
hot AS (
  SELECT source, line FROM (SELECT DISTINCT source, text, copies, line FROM lines) GROUP BY source, line HAVING sum(copies) > {MAX_DOCUMENTS_PER_HOST}),
gone AS (
  SELECT lines.source, text, sum(len(lines.line) - len(replace(lines.line, ' ', '')) + 1)::BIGINT AS n
  FROM lines JOIN hot ON lines.line = hot.line AND lines.source IS NOT DISTINCT FROM hot.source GROUP BY lines.source, text),
stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(parts.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM parts LEFT JOIN repeats USING (r) LEFT JOIN gone ON gone.text = parts.text AND gone.source IS NOT DISTINCT FROM parts.source)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= {MIN_KEPT_SHARE} * n_words AS kept
FROM stats
"""
