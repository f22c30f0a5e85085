"""Quality rules whose cutoffs follow the data: quantile sketches for each language and source.

1. Measures of each document, from whole texts: words, symbols, repeated lines, words in repeated windows.
2. A sketch of each measure for each language and source: counts of buckets that are at most
   1/32 of their value wide. Sketches of parts merge by adding counts, whatever the order, so
   those of a language and of all documents are sums of the others.
3. Cutoffs lie ``REACH`` quartile distances outside of the quartiles, as for outliers in a box plot. A group with
   few documents takes those of its language, a language with few those of all.
4. Cutoffs are joined to the documents, which stay if every measure is inside of them.

DataFrame functions only, and whole numbers only, so results hang on no order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import table, text_of, written
from siftwell.operators.running import join_null_safe

SPACE = r"[\x20\x09-\x0D]"
#: Words of a window.
WINDOW = 5
#: Base rules: fewest words, and most words of a hundred in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Values below this have a bucket each; above, each power of two is cut in so many.
FINE = 32
#: Quartile distances from a quartile to a cutoff.
REACH = 3
#: Documents that a group needs for cutoffs of its own.
LEAST_DOCUMENTS = 100
#: Measures: (name, numerator, factor, denominator, least quartile distance, whether small values are odd too).
MEASURES = (
    ("word_length", "word_chars", 100, "n_words", 60, True),
    ("symbols", "n_symbols", 1000, "word_chars", 20, False),
    ("dup_lines", "n_dup_lines", 1000, "n_lines", 150, False),
    ("repeat_words", "n_repeat_words", 1000, "n_words", 60, False),
)
NAMES = [m[0] for m in MEASURES]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, whatever number of times it is used."""
    return F.transform(F.array(value), use)[0]


def _pairs(x: Column, combine) -> Column:
    """``combine`` of each two neighbours."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), combine)


def _covered(keys: Column, width: int) -> Column:
    """Places in windows of ``width`` whose key occurs twice or more; ``keys``: a window's key at each place."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    none = F.array().cast("array<int>")
    twice = lambda p: F.array_distinct(F.flatten(_pairs(p, lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(none))))
    reach = lambda q: F.aggregate(_pairs(q, lambda a, b: F.least(b - a, F.lit(width))), F.lit(width), lambda s, d: s + d)
    return let(let(placed, lambda p: F.sort_array(twice(p))), lambda q: F.when(F.size(q) == 0, 0).otherwise(reach(q)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each whole text.

    A null text is empty: all 0. Windows are told apart by 64-bit hashes, of which two of one document of n words are
    equal by chance with a probability of n * n / 2^65.
    """
    text = text_of()
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("words").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # Keys of two, of four and of five neighbouring words.
    rows = rows.withColumn("two", _pairs(F.col("h"), lambda a, b: F.xxhash64(a, b)))
    n = F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))
    four = F.zip_with(F.slice("two", 1, n), F.slice("two", 3, n), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("keys", F.zip_with(four, F.slice("h", WINDOW, n), lambda a, b: F.xxhash64(a, b)))
    again = F.when(F.size(F.array_distinct("keys")) == F.size("keys"), 0).otherwise(_covered(F.col("keys"), WINDOW))
    long = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    return rows.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in long], again.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bucket(v: Column) -> Column:
    """The bucket of a whole number from 0 on: itself below ``FINE``, then ``FINE`` for each power of two."""
    shift = F.length(F.bin(v)) - (FINE.bit_length())
    return F.when(v < FINE, v).otherwise(shift * FINE + F.call_function("shiftright", v, shift)).cast("int")


def bucket_ends(b: Column) -> tuple[Column, Column]:
    """(least, largest) number of a bucket."""
    shift = F.greatest(F.floor(b / FINE).cast("int") - 1, F.lit(0))
    first = (b - shift * FINE).cast("long")
    return F.call_function("shiftleft", first, shift), F.call_function("shiftleft", first + 1, shift) - 1


def _value(measure: tuple) -> Column:
    """A measure as a whole number: its numerator in parts of the denominator; 0 if that is 0."""
    _, top, factor, bottom, _, _ = measure
    return F.coalesce(F.floor(F.try_divide(F.col(top) * factor, F.col(bottom))), F.lit(0))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents in ``measures`` that pass the base rules."""
    each = F.array(*[F.struct(F.lit(i).alias("measure"), _value(m).alias("v")) for i, m in enumerate(MEASURES)])
    pairs = rows.where(~base_failed()).select("lang", "source", F.explode(each).alias("e"))
    return pairs.groupBy("lang", "source", F.col("e.measure").alias("measure"), bucket(F.col("e.v")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all rows with the same ``keys`` as one."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """(keys, n_docs, cuts): the documents of a sketch and an array of (low, high), by measure; low is -1 where small values aren't odd.

    A quartile is the end, away from the middle, of the bucket in which a quarter of the values is reached. A sketch
    has some hundred buckets at most, so a window over them is small.
    """
    w = Window.partitionBy(*keys, "measure")
    up_to = sketch.withColumns({"up": F.sum("n").over(w.orderBy("bucket")), "n_docs": F.sum("n").over(w)})
    quartile = lambda k: F.min(F.when(4 * F.col("up") >= k * F.col("n_docs"), F.col("bucket")))
    q = up_to.groupBy(*keys, "measure").agg(F.max("n_docs").alias("n_docs"), quartile(1).alias("b1"), quartile(3).alias("b3"))
    q = q.select(*keys, "measure", "n_docs", bucket_ends(F.col("b1"))[0].alias("q1"), bucket_ends(F.col("b3"))[1].alias("q3"))
    least = F.array(*[F.lit(m[4]) for m in MEASURES])[F.col("measure")]
    both = F.array(*[F.lit(m[5]) for m in MEASURES])[F.col("measure")]
    wide = F.greatest(F.col("q3") - F.col("q1"), least.cast("long")) * reach
    cut = F.struct("measure", F.when(both, F.col("q1") - wide).otherwise(F.lit(-1)).alias("low"), (F.col("q3") + wide).alias("high"))
    return q.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), F.array_sort(F.collect_list(cut)).alias("cuts"))


def adaptive_cutoffs(rows: DataFrame, *, reach: int = REACH, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, n_docs, level, cuts) of each language and source among the documents that pass the base rules.

    ``level``: whose cutoffs they are, ``source``, ``lang`` or ``all``: the first with ``least`` documents, or all.
    Nulls are a language and a source like others.
    """
    own = written(sketches(rows), "sketches")
    by_lang = merged(own, ["lang"])
    everything = cutoffs(merged(own, []), [], reach).select(F.col("cuts").alias("all_cuts"))  # one row
    langs = cutoffs(by_lang, ["lang"], reach).select("lang", F.col("n_docs").alias("lang_docs"), F.col("cuts").alias("lang_cuts"))
    out = join_null_safe(cutoffs(own, ["lang", "source"], reach), langs, ["lang"]).join(F.broadcast(everything))
    level = F.when(F.col("n_docs") >= least, "source").when(F.col("lang_docs") >= least, "lang").otherwise("all")
    cuts = F.when(level == "source", F.col("cuts")).when(level == "lang", F.col("lang_cuts")).otherwise(F.col("all_cuts"))
    return out.select("lang", "source", "n_docs", level.alias("level"), cuts.alias("cuts"))


def judged(docs: DataFrame, *, reach: int = REACH, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``measures`` of each document with base_failed, kept and failed (names of the measures outside of their cutoffs).

    Null, empty and blank texts have no words and fail the base rules; repeated rows are judged alike; columns of
    ``docs`` other than doc_id, text, lang and source don't count; an empty table gives an empty result.
    """
    rows = written(measures(docs), "measures")
    cuts = written(adaptive_cutoffs(rows, reach=reach, least=least), "cutoffs")
    out = join_null_safe(rows, cuts.select("lang", "source", "cuts"), ["lang", "source"], "left")
    odd = F.array(*[F.when(~_value(m).between(F.col("cuts")[i]["low"], F.col("cuts")[i]["high"]), F.lit(m[0])) for i, m in enumerate(MEASURES)])
    out = out.withColumn("base_failed", base_failed()).withColumn("failed", F.when(F.col("cuts").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(odd)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("cuts")


def op12_adaptive_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents by cutoffs of their language and source."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    value = "\n".join(f"UNION ALL SELECT doc_id, lang, source, {i} AS measure, coalesce({top} * {factor} // nullif({bottom}, 0), 0) AS v FROM m" for i, (_, top, factor, bottom, _, _) in enumerate(MEASURES))
    value = value.removeprefix("UNION ALL ")
    width = FINE.bit_length()

    def cuts(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        least = "CASE measure " + " ".join(f"WHEN {i} THEN {m[4]}" for i, m in enumerate(MEASURES)) + " END"
        two_sided = ", ".join(str(i) for i, m in enumerate(MEASURES) if m[5])
        end = lambda b, plus: f"(({b} - greatest({b} // {FINE} - 1, 0) * {FINE} + {plus}) << greatest({b} // {FINE} - 1, 0)) - {plus}"
        return f"""
{name}_s AS (SELECT {k}measure, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {k}measure ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY {k}measure) AS docs FROM {name}_s),
{name}_b AS (SELECT {k}measure, max(docs) AS docs, min(bucket) FILTER (4 * up >= docs) AS b1, min(bucket) FILTER (4 * up >= 3 * docs) AS b3 FROM {name}_w GROUP BY ALL),
{name}_q AS (SELECT {k}measure, docs, {end("b1", 0)} AS q1, {end("b3", 1)} AS q3 FROM {name}_b),
{name} AS MATERIALIZED (SELECT {k}measure, docs, CASE WHEN measure IN ({two_sided}) THEN q1 - {REACH} * greatest(q3 - q1, {least}) ELSE -1 END AS low, q3 + {REACH} * greatest(q3 - q1, {least}) AS high FROM {name}_q)"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win SEMI JOIN twice USING (doc_id, x)) GROUP BY doc_id),
m AS MATERIALIZED (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN covered c USING (doc_id)),
v AS MATERIALIZED ({value}),
base AS (SELECT doc_id, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
sk AS MATERIALIZED (SELECT lang, source, measure, (CASE WHEN v < {FINE} THEN v ELSE (length(bin(v)) - {width}) * {FINE} + (v >> (length(bin(v)) - {width})) END)::BIGINT AS bucket, count(*) AS n
  FROM v JOIN base USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
{cuts("own", "lang, source")}, {cuts("tongue", "lang")}, {cuts("every", "")},
verdict AS (SELECT doc_id, bool_and(CASE WHEN o.docs >= {LEAST_DOCUMENTS} THEN v.v BETWEEN o.low AND o.high WHEN t.docs >= {LEAST_DOCUMENTS} THEN v.v BETWEEN t.low AND t.high ELSE v.v BETWEEN e.low AND e.high END) AS inside
  FROM v JOIN own o ON v.measure = o.measure AND v.lang IS NOT DISTINCT FROM o.lang AND v.source IS NOT DISTINCT FROM o.source
  JOIN tongue t ON v.measure = t.measure AND v.lang IS NOT DISTINCT FROM t.lang JOIN every e ON v.measure = e.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept FROM m JOIN base USING (doc_id) LEFT JOIN verdict USING (doc_id)"""


QUERIES = {"op12_adaptive_quality_rules": op12_adaptive_quality_rules}
ORACLES = {"op12_adaptive_quality_rules": _oracle()}
