"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each measure of a document is an integer. A mergeable quantile sketch counts, for each language and source,
how many documents fall in each of log-linear buckets (32 to each doubling, so quantiles are right to one part
in 32). Sketches add up: the same counts rolled up give the sketch of a language and of the whole corpus. Every
source's quartiles are its own sketch's, drawn to its language's as PRIOR more documents would draw them, and those
to the corpus's alike: a small source leans on its language, a large one hardly. Quartiles set the thresholds
(Tukey's fences), and a join on language and source filters the documents. Counts are order-free, so a lost executor or
another partitioning never changes a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import NO_ID, drop, fresh, let, words_column, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A source's quartiles count as if so many documents had its language's, and a language's as if so many had the corpus's.
PRIOR = 20
#: Quartiles and fences are integers in such parts of a measure's unit.
UNIT = 1000
#: Fences stand this many quartile ranges beyond the quartiles.
REACH = 3
#: For each measure: the least quartile range that counts, and whether low values are suspect too. REACH times the range
#: must leave room beyond the fence: repeats end at 300 after the base rules, word_length begins at 100.
MEASURES = {
    "symbols": (30, False),  # symbols for 1000 words
    "capitals": (60, False),  # A-Z for 1000 characters of words
    "dup_lines": (100, False),  # of 1000 lines, those equal to an earlier one
    "repeats": (50, False),  # of 1000 words, those in windows found twice
    "word_length": (60, True),  # characters for 100 words
}


def _repeat_words(words) -> F.Column:
    """Words in windows of WINDOW words that the text has twice or more. Linear but for one sort, and that only where some window repeats."""
    last = F.size(words) - WINDOW + 1

    def of(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), found)
        )

    def found(ordered):
        def same(k, j):
            p, q = F.get(ordered, k), F.get(ordered, j)
            words_at = lambda x: F.slice(words, x["i"] + 1, F.lit(WINDOW))
            return F.coalesce((p["h"] == q["h"]) & (words_at(p) == words_at(q)), F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return let(F.sort_array(F.transform(twice, lambda k: F.get(ordered, k)["i"])), covered)

    def covered(at):
        step = lambda _, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda s, x: s + x)

    def windows(hashed):
        at = lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WINDOW)])
        return let(F.transform(F.sequence(F.lit(0), last - 1), at), of)

    return F.when(last < 2, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, lang, source and the counts of each row's whole text; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", F.xxhash64("text").alias("mark"), "lang", "source", text.alias("text"), words_column(F.col("text")).alias("words"))
    words, text = F.col("words"), F.col("text")
    without_any = lambda chars: F.char_length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return held.select(
        "doc_id",
        "mark",
        "lang",
        "source",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - without_any(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(text) - without_any(CAPITALS)).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
    ).select("*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines")).drop("lines")


def _bucket(v: str) -> str:
    """SQL for the sketch's bucket of a count v: v itself below 64, then 32 buckets to a doubling."""
    return f"case when {v} < 64 then {v} else 32 * (length(bin({v})) - 6) + shiftright({v}, length(bin({v})) - 6) end"


def _edge(b: str) -> str:
    """SQL for the least value in bucket b."""
    return f"case when {b} < 64 then {b} else shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 as int)) end"


def _judged(docs: DataFrame) -> DataFrame:
    """judged() with mark, a hash of the text."""
    counts = measured(docs)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = counts.withColumn("base_failed", base)
    rate = lambda n, of, d: F.expr(f"coalesce({n} * {of} div {d}, 0)")
    counts = written(
        counts.withColumns(
            {
                "symbols": rate("n_symbols", 1000, "nullif(n_words, 0)"),
                "capitals": rate("n_capitals", 1000, "nullif(word_chars, 0)"),
                "dup_lines": rate("n_dup_lines", 1000, "nullif(n_lines, 0)"),
                "repeats": rate("n_repeat_words", 1000, "nullif(n_words, 0)"),
                "word_length": rate("word_chars", 100, "nullif(n_words, 0)"),
            }
        ),
        "measures",
    )
    named = ", ".join(f"'{m}', {m}" for m in MEASURES)
    each = counts.where("not base_failed").select("lang", "source", F.expr(f"stack({len(MEASURES)}, {named}) as (measure, value)"))
    sketch = each.groupBy("lang", "source", "measure", F.expr(_bucket("value")).alias("bucket")).count()
    limits = written(fences(sketch), "fences")
    own = limits.select(*[F.col(c).alias(f"own_{c}") for c in limits.columns])
    out = counts.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    good = F.lit(True)
    for m in MEASURES:
        good = good & (F.col(m) * UNIT).between(F.col(f"own_{m}_lo"), F.col(f"own_{m}_hi"))
    return out.select("doc_id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & good, F.lit(False)).alias("kept"))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed and every
    measure within the fences of the row's language and source. Null text: no words, so base_failed. Null
    language or source: a group like any other. Repeated rows count and are judged each. An empty table gives an
    empty one. Columns other than doc_id, text, lang and source are ignored.
    """
    return _judged(docs).drop("mark")


def fences(sketch: DataFrame) -> DataFrame:
    """sketch (lang, source, measure, bucket, count) -> (lang, source, m_lo and m_hi of each measure m), in parts of UNIT, a row for each source in a language."""
    source, lang, every = (_quartiles(sketch, *keys) for keys in (("lang", "source"), ("lang",), ()))
    every = every.select("measure", F.col("q1").alias("e1"), F.col("q3").alias("e3"))
    drawn = lambda n, q, to: F.expr(f"({n} * {q} + {PRIOR} * {to}) div ({n} + {PRIOR})")
    lang = lang.join(every, "measure").select(F.col("lang").alias("of"), F.col("measure").alias("what"), drawn("docs", "q1", "e1").alias("l1"), drawn("docs", "q3", "e3").alias("l3"))
    both = source.join(lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("what")))
    both = both.select("lang", "source", "measure", drawn("docs", "q1", "l1").alias("q1"), drawn("docs", "q3", "l3").alias("q3"))
    least = F.create_map(*[x for m, (s, _) in MEASURES.items() for x in (F.lit(m), F.lit(s * UNIT))])
    low = F.create_map(*[x for m, (_, two) in MEASURES.items() for x in (F.lit(m), F.lit(two))])
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")])
    limit = both.select("lang", "source", "measure", F.when(low[F.col("measure")], F.col("q1") - spread).otherwise(F.lit(0)).alias("lo"), (F.col("q3") + spread).alias("hi"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return limit.groupBy("lang", "source").agg(*[pick(m, c) for m in MEASURES for c in ("lo", "hi")])


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(*keys, measure, docs, q1, q3) of the sketches added up by the keys; quartiles are the least values of their buckets, in parts of UNIT."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("count").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # as many rows as a sketch has buckets
    ordered = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    at = lambda q: (F.min(F.when(F.col("below") * 4 >= F.col("docs") * q, F.expr(_edge("bucket")))) * UNIT).alias(f"q{q}")
    return ordered.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(1), at(3))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that judged() rejects; columns are those of docs.

    Rows that share a doc_id, or have none, are told apart by their texts; of repeated rows in several sources all stay
    if one is kept. Null, empty and short texts go. An empty table gives an empty one.
    """
    id_, mark = fresh(docs, "_id", "_mark")
    verdict = _judged(docs).groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col("mark").alias(mark)).agg(F.max("kept").alias("kept"))
    gone = verdict.where("not kept").drop("kept")
    rows = docs.withColumns({id_: F.coalesce("doc_id", F.lit(NO_ID)), mark: F.xxhash64("text")})
    return rows.join(gone, [id_, mark], "left_anti").select(*docs.columns)


_SPACED = r"[^\x20\x09-\x0D]"
_BUCKET_SQL = "case when {v} < 64 then {v} else 32 * (length(to_base({v}, 2)) - 6) + ({v} >> (length(to_base({v}, 2)) - 6)) end"
_EDGE_SQL = "case when {b} < 64 then {b} else ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1)::int end"


def _quartiles_sql(*keys: str) -> str:
    part = ", ".join([*keys, "measure"])
    at = lambda q: f"{UNIT} * min(case when below * 4 >= docs * {q} then {_EDGE_SQL.format(b='bucket')} end) as q{q}"
    return f"""select {part}, max(docs) as docs, {at(1)}, {at(3)} from (
            select *, sum(n) over (partition by {part} order by bucket) as below, sum(n) over (partition by {part}) as docs
            from (select {part}, bucket, cast(count(*) as bigint) as n from bucketed group by {part}, bucket)) group by {part}"""


def _drawn(n: str, q: str, to: str) -> str:
    return f"cast(({n} * {q} + {PRIOR} * {to}) // ({n} + {PRIOR}) as bigint)"


#: The rows of judged(), for DuckDB.
SQL = f"""
    with rows_ as (
        select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_SPACED}+') as w,
            [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_SPACED}')] as lines
        from documents
    ), windows as (
        select r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as x from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from rows_)
    ), twice as (
        select r, i from (select r, i, count(*) over (partition by r, x) as n from windows) where n > 1
    ), repeated as (
        select r, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) as n from (select r, i, lead(i) over (partition by r order by i) as after from twice) group by r
    ), counts as (
        select rows_.r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
            cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
            cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words
        from rows_ left join repeated on rows_.r = repeated.r
    ), rates as (
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
            coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) as symbols, coalesce(n_capitals * 1000 // nullif(word_chars, 0), 0) as capitals,
            coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) as dup_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) as repeats,
            coalesce(word_chars * 100 // nullif(n_words, 0), 0) as word_length
        from counts
    ), each as (
        {" union all ".join(f"select lang, source, '{m}' as measure, {m} as v from rates where not base_failed" for m in MEASURES)}
    ), bucketed as (
        select lang, source, measure, cast({_BUCKET_SQL.format(v="v")} as bigint) as bucket from each
    ), of_source as ({_quartiles_sql("lang", "source")}
    ), of_lang as ({_quartiles_sql("lang")}
    ), of_all as ({_quartiles_sql()}
    ), drawn_lang as (
        select l.lang, l.measure, {_drawn("l.docs", "l.q1", "e.q1")} as q1, {_drawn("l.docs", "l.q3", "e.q3")} as q3 from of_lang l join of_all e on l.measure = e.measure
    ), drawn as (
        select s.lang, s.source, s.measure, {_drawn("s.docs", "s.q1", "l.q1")} as q1, {_drawn("s.docs", "s.q3", "l.q3")} as q3
        from of_source s join drawn_lang l on s.lang is not distinct from l.lang and s.measure = l.measure
    ), limits as (
        select lang, source, measure, case when low then q1 - {REACH} * greatest(q3 - q1, least_range) else 0 end as lo, q3 + {REACH} * greatest(q3 - q1, least_range) as hi
        from drawn join (values {", ".join(f"('{m}', {s * UNIT}, {str(two).lower()})" for m, (s, two) in MEASURES.items())}) k(name, least_range, low) on measure = name
    ), fine as (
        select r, bool_and({UNIT} * v between lo and hi) as good
        from ({" union all ".join(f"select r, lang, source, '{m}' as measure, {m} as v from rates where not base_failed" for m in MEASURES)}) x
        join limits on x.lang is not distinct from limits.lang and x.source is not distinct from limits.source and x.measure = limits.measure group by r
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(good, false) as kept
    from rates left join fine on rates.r = fine.r
"""
