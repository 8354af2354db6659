"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash, whole_rows

SPACE = r"[\\x20\\x09-\\x0D]"


def document_counts(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with ``text``.

    A 3-word window is known by a 64-bit hash of its words. Windows that recur are looked for in the sorted hashes, so
    the work for a document is n log n, also for one that repeats itself throughout. Null texts have no words.
    Each array that a later step reads more than once is a column of its own, which keeps Spark from evaluating it
    again for every element.
    """
    own = docs.columns
    d = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumn("_w", F.expr(f"filter(split(_t, '{SPACE}+'), x -> x != '')"))
    d = d.withColumn("_l", F.expr(rf"filter(split(_t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.select(
        *own, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("_h", F.expr("if(n_words < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))")).drop("_w")
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<bigint>), sort_array(_h))"))
    d = d.withColumn("_d", F.expr("if(size(_s) = 0, _s, array_distinct(filter(_s, (x, k) -> k > 0 and x = _s[k - 1])))"))
    d = d.withColumn("_o", F.expr("if(size(_d) > 32, sort_array(transform(_h, (h, i) -> struct(h as h, i as i))), null)"))
    d = d.withColumn("_p", F.expr(
        "case when size(_d) = 0 then cast(array() as array<int>) "
        "when size(_d) <= 32 then filter(sequence(0, size(_h) - 1), i -> array_contains(_d, _h[i])) "
        "else sort_array(transform(filter(_o, (x, k) -> (k > 0 and x.h = _o[k - 1].h) or (k < size(_o) - 1 and x.h = _o[k + 1].h)), x -> x.i)) end"))
    d = d.withColumn("n_repeat_words", F.expr("if(size(_p) = 0, 0L, cast(aggregate(transform(_p, (p, k) -> least(3, coalesce(get(_p, k + 1), p + 3) - p)), 0, (a, x) -> a + x) as bigint))"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return d.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_rules(docs: DataFrame, host: str = "source", line_limit: int = 20, depleted_percent: int = 80) -> DataFrame:
    """doc_id, the counts, n_removed_words and kept for each row with doc_id, text and a host column.

    A line, lower-cased and with its white space evened, is removed from a host's documents if more than ``line_limit``
    different texts of that host hold it; the host's first document (smallest doc_id) with that line keeps it. Copies
    of a text count as one document, so that a document isn't lost for having been copied. kept is false if base_failed, or if over
    ``depleted_percent`` of the words stood in removed lines. A null host is a host of its own. Null and empty texts have no
    words and fail; a very long text is judged whole; null ids are ids like others. Repeated rows are
    judged alike; other columns, whatever their names, aren't read; an empty table gives no rows.

    Both sums over lines combine before they shuffle, so a line that every document holds is one row per task.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(host).cast("string").alias("_host"))
    lines = F.expr(
        rf"transform(filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'), x -> struct(xxhash64(lower(regexp_replace(trim(BOTH ' \t\r' FROM x), '{SPACE}+', ' '))) as h, "
        rf"size(filter(split(x, '{SPACE}+'), y -> y != '')) as n))")
    d = d.withColumn("_lines", F.coalesce(lines, F.expr("array(struct(0L as h, 0 as n))")))
    d = document_counts(d.withColumn("_text", F.xxhash64("text")))
    d = stash(d.drop("text"))
    rows = d.select("doc_id", "_host", "_text", F.explode("_lines").alias("_x")).select("doc_id", F.xxhash64("_host", F.col("_host").isNull()).alias("_host"), "_text", "_x.h", "_x.n").where("n > 0")
    each = rows.groupBy("_host", "h", "_text").agg(F.min("doc_id").alias("first"))
    many = each.groupBy("_host", "h").agg(F.count("*").alias("texts"), F.min("first").alias("first")).where(F.col("texts") > line_limit).drop("texts")
    mine = rows.groupBy("doc_id", "_host", "_text", "h").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    removed = mine.join(many, ["_host", "h"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    # rows that repeat hold their lines once each, so the words found in removed lines are divided among them
    same = d.groupBy("doc_id", F.xxhash64("_host", F.col("_host").isNull()).alias("_host"), "_text").agg(F.count("*").alias("rows")).where("rows > 1")
    removed = removed.groupBy("doc_id", "_host", "_text").agg(F.sum(F.col("n") * F.col("times")).alias("words"))
    same = same.select(F.col("doc_id").alias("_d"), F.col("_host").alias("_o"), F.col("_text").alias("_x"), "rows")
    removed = removed.join(same, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_host") == F.col("_o")) & (F.col("_text") == F.col("_x")), "left").select(F.col("doc_id").alias("_i"), F.col("_host").alias("_j"), F.col("_text").alias("_k"), (F.col("words") / F.coalesce("rows", F.lit(1))).cast("long").alias("words"))
    key = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("_host", F.col("_host").isNull()) == F.col("_j")) & (F.col("_text") == F.col("_k"))
    d = d.drop("_lines").join(removed, key, "left").withColumn("n_removed_words", F.coalesce("words", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("n_removed_words") <= depleted_percent * F.col("n_words"))
    return d.select("doc_id", *COUNTS, kept.alias("kept"), "n_removed_words", "_text")


#: The same in DuckDB SQL over whole documents, with the defaults of ``quality_rules``.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, text from documents),
w as (select r, doc_id, source, t, text, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
win as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
win2 as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from win),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win2) where c > 1),
cov as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
ln as (select r, doc_id, source, text, unnest(string_split(t, chr(10))) as l from d),
lw as (select *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
    lower(regexp_replace(trim(l, ' ' || chr(9) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) as k from ln where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct l) as n from lw group by r),
many as (select source, k, min(doc_id) as first from lw group by source, k having count(distinct text) > 20),
rem as (select lw.r, sum(lw.n) as n from lw join many on lw.source is not distinct from many.source and lw.k = many.k and lw.doc_id <> many.first group by lw.r),
c as (select w.r, w.doc_id, cast(len(w.w) as bigint) as n_words, cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(rem.n, 0) as bigint) as n_removed_words
    from w left join dup using (r) left join cov using (r) left join rem using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_removed_words <= 80 * n_words as kept, n_removed_words
from c
"""


def quality_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns."""
    judged = quality_rules(docs, **settings).where("kept").select(F.col("doc_id").alias("_i"), F.col("_text").alias("_k")).distinct()
    return whole_rows(docs).join(judged, F.col("row.doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("row.text") == F.col("_k")), "left_semi").select("row.*")
