"""Quality rules with host verdicts, in DataFrame functions only.

Counts of each text stay in its row: words, windows and lines are arrays there, so
nothing is exploded or shuffled but one row per host and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import written

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 8
#: A document fails a rule beyond these: words at least; percent of words in repeated
#: windows, of symbols to letters, of repeated lines among lines.
MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_LINES = 20, 30, 10, 30
#: A host is rejected if its shrunk failure rate, less so many standard deviations of it, is above the mean of all hosts.
HOST_BOUND = 1.0
#: Bounds of the prior's weight in documents; hosts that don't vary give the upper one.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0


def _shifted(x: Column, by: int) -> Column:
    """Elements from ``by`` on, without the last ``by`` of the other side."""
    return F.slice(x, F.lit(by + 1), F.greatest(F.size(x) - by, F.lit(0)))


def _paired(x: Column, by: int) -> Column:
    """Hash of every element with the one ``by`` later."""
    head = F.slice(x, F.lit(1), F.greatest(F.size(x) - by, F.lit(0)))
    return F.zip_with(head, _shifted(x, by), lambda a, b: F.xxhash64(a, b))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Null texts count as empty. Columns of those names are replaced. Windows are compared by
    64-bit hashes of their eight words.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    own = [c for c in docs.columns if c not in names]
    t = F.col("_t")
    rows = docs.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = rows.select(
        *(F.col(f"`{c}`") for c in own),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \t-\r]")).alias("_lines"),
        F.transform(F.array_remove(F.split(t, "[ \t-\r]+"), ""), lambda w: F.xxhash64(w)).alias("_words"),
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_pairs": _paired(F.col("_words"), 1),
        }
    ).drop("_lines", "_words")
    rows = rows.withColumn("_fours", _paired(F.col("_pairs"), 2)).drop("_pairs")
    rows = rows.withColumn("_windows", _paired(F.col("_fours"), 4)).drop("_fours")
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    beside = "(k > 0 and _sorted[k - 1].h = e.h) or (k < size(_sorted) - 1 and _sorted[k + 1].h = e.h)"
    rows = rows.withColumn(
        "_at", F.expr(f"case when _sorted is not null then sort_array(transform(filter(_sorted, (e, k) -> {beside}), e -> e.i)) end")
    ).drop("_sorted")
    covered = f"case when k + 1 < size(_at) then least({WINDOW}, _at[k + 1] - x) else {WINDOW} end"
    return rows.withColumn(
        "n_repeat_words",
        F.expr(f"coalesce(aggregate(transform(_at, (x, k) -> {covered}), 0L, (s, x) -> s + x), 0L)"),
    ).drop("_at", "_t")


def with_rules(counts: DataFrame) -> DataFrame:
    """``base_failed`` and ``n_failed``, the number of rules that a document fails."""
    few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_LINES * F.col("n_lines")
    failed = sum((x.cast("int") for x in (few, repeats, symbols, lines)), F.lit(0))
    return counts.withColumns({"base_failed": few | repeats, "n_failed": failed})


def host_rates(ruled: DataFrame, host: str) -> DataFrame:
    """``host, n_docs, n_bad, rate, rejected``: failure rates shrunk to all hosts' mean.

    The beta prior has the mean and, by the method of moments, the weight that the
    hosts' own rates show. A host whose posterior lies above the prior's mean, by
    :data:`HOST_BOUND` deviations, is rejected; where hosts hardly vary, the prior weighs much and
    none is. Documents without a host are a host of their own.
    """
    hosts = ruled.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("n_failed") > 0).alias("n_bad")
    )
    hosts = written(hosts, "hosts")
    own = F.col("n_bad") / F.col("n_docs")
    prior = hosts.agg(F.avg(own).alias("m"), F.var_pop(own).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(PRIOR_MOST).alias("w")
    )
    prior = prior.select("m", F.least(F.greatest("w", F.lit(PRIOR_LEAST)), F.lit(PRIOR_MOST)).alias("w")).first()
    m, w = (prior["m"] or 0.0, prior["w"] or PRIOR_MOST) if prior else (0.0, PRIOR_MOST)
    hosts = hosts.withColumn("rate", (F.col("n_bad") + F.lit(m) * w) / (F.col("n_docs") + F.lit(w)))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.lit(w) + 1))
    return hosts.withColumn("rejected", F.col("rate") - HOST_BOUND * deviation > F.lit(m))


def judged(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts, ``base_failed``, ``n_failed``, ``host_rejected`` and ``kept``.

    A document is kept unless it fails a base rule, or fails any rule on a rejected host (see
    :func:`host_rates`); one that fails none is kept on any host. Null and empty texts
    have no words and so fail. Repeated rows count and give results each; an empty table gives
    none. A kept column with the name of an output gives way.
    The counts are written once and read for both the hosts and the result.
    """
    # On the way kept columns have names of their own, so that none clashes.
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed", "host_rejected", "kept")
    keep = tuple(c for c in keep if c not in made)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]
    counts = text_counts(docs.select(*own, F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text")), "_text").drop("_text")
    ruled = written(with_rules(counts), "rules")
    rejected = written(host_rates(ruled, "_host").where("rejected").select(F.col("host").alias("_rejected")), "verdicts")
    joined = ruled.join(
        rejected.withColumn("_hit", F.lit(True)), F.col("_host").eqNullSafe(F.col("_rejected")), "left"
    )
    host_rejected = F.coalesce(F.col("_hit"), F.lit(False))
    done = joined.withColumns({"host_rejected": host_rejected, "kept": ~F.col("base_failed") & ~(host_rejected & (F.col("n_failed") > 0))})
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), *made)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), r AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT rid, sum(CASE WHEN next IS NULL THEN 8 ELSE least(8, next - i) END) AS n FROM r GROUP BY rid
), c AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars
           OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM f GROUP BY source
), p AS (
  SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h
), q AS (
  SELECT m, least(1000.0, greatest(1.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS s FROM p
), y AS (
  SELECT source, m, n + s + 1 AS size, (bad + m * s) / (n + s) AS rate FROM h, q
), x AS (
  SELECT source, rate - 1.0 * sqrt(rate * (1 - rate) / size) > m AS rejected FROM y
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (x.rejected AND failed) AS kept, x.rejected AS host_rejected
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""
