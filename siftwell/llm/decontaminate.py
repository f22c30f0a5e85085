"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose values were
changed still has the same template. Windows of five template words of all documents
meet those of the benchmark in a hash join; a document that holds enough of an item's
windows is then checked for slots: one value of the item must stand for one value of
the document throughout. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import table, text_of, written

WINDOW = 5
SIMILARITY = 0.8
#: A window says something only with this many words that are no placeholders.
LITERALS = 2
#: The scheme of items without a window.
WHOLE = 2
#: An item's figures, and what they go with.
SIZES = ["n_windows", "n_valued", "length"]
ITEM = ["item_id", "scheme"]
KEY = ["doc_id", *ITEM, *SIZES]
#: Benchmarks of up to so many windows are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
#: The same for ids of documents that may hold an item.
BROADCAST_IDS = 1_000_000

# Units of measure that may follow a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "yards", "miles", "mile", "mg", "g", "kg", "tons", "pounds", "ml", "l",
    "liters", "litres", "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "years",
    "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "kph", "mph",
]
#: Replacements in turn: (pattern, what stands before the slot, slot, group of the value).
NUMBER = r"([0-9]+(?:[.,:/][0-9]+)*)"
NAME = r"(\p{Lu}\p{Ll}+)"
RULES = [
    (r"([\p{Ll},;] )" + NAME, "name"),
    (r"(<name=[^>]*> )" + NAME, "name"),
    (r"()" + NUMBER, "num"),
    (r"(<num=[^>]*> ?)\b(" + "|".join(UNITS) + r")\b", "unit"),
]
# Words that open sentences and are no names.
OPENERS = [
    "The", "An", "This", "That", "These", "Those", "There", "Here", "Each", "Every", "Some", "Any", "All", "Both", "Many", "Most", "No", "One", "It", "He", "She", "We", "You",
    "They", "His", "Her", "Its", "My", "Our", "Your", "Their", "How", "What", "Who", "Whose", "Whom", "When", "Where", "Why", "Which", "If", "In", "On", "At", "By", "For", "From",
    "Of", "To", "With", "After", "Before", "During", "Until", "Since", "While", "As", "And", "But", "Or", "So", "Then", "Than", "Not", "Is", "Are", "Was", "Were", "Do", "Does",
    "Did", "Has", "Have", "Had", "Can", "Could", "Would", "Should", "Must", "Also", "Now", "Next", "Later", "Because", "Although", "However", "Let",
]
#: A name that opens a text or a sentence, where the rules have left a capital: also a slot, in a template of its own.
OPENING = r"(^|[^\p{L}=>])(?=\p{Lu})(?!(?:" + "|".join(OPENERS) + r")(?!\p{L}))(\p{Lu}\p{Ll}+)(?!\p{L})"
TOKEN = r"<[a-z]+=[^>]*>|\p{L}+"
#: Marks that would be taken for a slot's own.
RESERVED = r"[<>=]"


def _slotted(text: Column, value: str) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, RESERVED, " "), r"\s+", " ")
    for pattern, slot in RULES:
        out = F.regexp_replace(out, pattern, f"$1<{slot}={value}>")
    return out


def _tokens(slotted: Column) -> Column:
    return F.regexp_extract_all(F.lower(slotted), F.lit(TOKEN), F.lit(0))


def valued_tokens(text: Column) -> Column:
    """Lower-case words and slots such as ``<num=12>`` of a text, in order."""
    return _tokens(_slotted(text, "$2"))


def template_tokens(text: Column) -> Column:
    """The same without the values: ``<num=>``."""
    return _tokens(_slotted(text, ""))


def _with_tokens(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, v0 (tokens by the rules) and v1 (the same with opening names as slots)."""
    slotted = df.select(key, _slotted(text_of(), value).alias("s"))
    return slotted.select(key, _tokens(F.col("s")).alias("v0"), _tokens(F.regexp_replace("s", OPENING, f"$1<name={value}>")).alias("v1"))


def _both(df: DataFrame, key: str) -> DataFrame:
    """A row for each of the two templates: ``key``, scheme (0, 1), v, t."""
    two = df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), F.col(f"v{k}").alias("v")) for k in (0, 1)])).alias("e"))
    return two.select(key, "e.*").withColumn("t", without_values(F.col("v")))


def without_values(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, "=[^>]*>", "=>"))


def _windows(tokens: Column, make) -> Column:
    """``make(i)`` for each place where a window starts; none for fewer words than a window."""
    return F.when(F.size(tokens) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(tokens) - WINDOW + 1), make)).otherwise(F.array())


def _joint(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _window_hash(words: list[Column]) -> Column:
    """The hash of one window: of its words' hashes, two, four and all five of them."""
    h = [F.xxhash64(w) for w in words]
    return _joint(_joint(_joint(h[0], h[1]), _joint(h[2], h[3])), h[4])


def _hashes(tokens: str) -> Column:
    """``_window_hash`` of each window; a word is hashed once, and what two windows share is not hashed again."""
    t = F.col(tokens)
    n = F.greatest(F.size(t) - (WINDOW - 1), F.lit(0))
    let = lambda value, use: F.transform(F.array(value), use)[0]

    def of_words(h: Column) -> Column:
        two = F.zip_with(F.slice(h, 1, n + 2), F.slice(h, 2, n + 2), _joint)
        return let(two, lambda x: F.zip_with(F.zip_with(F.slice(x, 1, n), F.slice(x, 3, n), _joint), F.slice(h, WINDOW, n), _joint))

    return F.when(n > 0, let(F.transform(t, lambda w: F.xxhash64(w)), of_words)).otherwise(F.array().cast("array<bigint>"))


def _whole(template: Column) -> Column:
    """The hash of a whole text's template."""
    return F.xxhash64(F.array_join(template, " "))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, scheme, q (place), h, template, valued: the windows of items that hold enough literal words."""
    b = _both(_with_tokens(benchmark, "item_id", "$2"), "item_id")
    rows = b.select(
        "item_id",
        "scheme",
        F.explode(
            _windows(
                F.col("t"),
                lambda i: F.struct(
                    i.alias("q"),
                    _window_hash([F.get(F.col("t"), i + k - 1) for k in range(WINDOW)]).alias("h"),
                    F.slice("t", i, WINDOW).alias("template"),
                    F.slice("v", i, WINDOW).alias("valued"),
                ),
            )
        ).alias("w"),
    ).select("item_id", "scheme", "w.*")
    literal = F.size(F.filter("template", lambda t: ~t.startswith("<")))
    return rows.where(literal >= LITERALS)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item whose template windows it holds.

    Returns doc_id, item_id, n_windows (the item's distinct windows), n_found (those in
    the document), n_slots (slot pairs of found windows), n_consistent (those in which the
    item's value has its most frequent counterpart) and kind: ``exact`` if all pairs
    have equal values, else ``template``. Rows need n_found >= similarity * n_windows and
    n_consistent >= similarity * n_slots.

    The figures are those of the first that fulfils this: all pairings of equal windows in
    the document; the windows that are equal with their values, if they are as large a part of
    the item's valued windows; the best occurrence. An occurrence is a place where the item
    could start: each window of the item takes its nearest counterpart at most the item's
    length from there, so words may be put in or left out. Each comes first by the
    stated rules, then with names that open sentences as slots too (of document and item).

    Null and empty texts match nothing. An item without a window (too few words, or too few that are
    literal) is found only where a document is that item, token for token and with its values.
    Repeated rows of one doc_id count as one document; ties all are reported; other
    columns don't count. Empty tables give an empty result.
    """
    items = _item_windows(benchmark)
    sizes = items.groupBy(*ITEM).agg(
        F.countDistinct("template").cast("long").alias("n_windows"), F.countDistinct("valued").alias("n_valued"), (F.max("q") + WINDOW - 1).alias("length")
    )
    # Items without a window are known as a whole: scheme WHOLE, one window of all tokens.
    short = _with_tokens(benchmark, "item_id", "$2").where("size(v0) > 0").select("item_id", F.lit(WHOLE).alias("scheme"), "v0").distinct()
    short = short.join(items.select("item_id").distinct(), "item_id", "left_anti")
    one = F.lit(1).cast("long")
    sizes = sizes.unionByName(short.select(*ITEM, one.alias("n_windows"), one.alias("n_valued"), F.size("v0").alias("length")).distinct())
    keys = items.select(*ITEM, "h").union(short.select(*ITEM, _whole(without_values(F.col("v0"))))).distinct()
    # A benchmark is a stated set of questions, far smaller than the corpus; its size is checked all the same.
    small = keys.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hinted = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    tokens = _with_tokens(docs, "doc_id", "")
    found = (
        tokens.select("doc_id", F.explode(F.array_union(F.array_append(_hashes("v0"), _whole(F.col("v0"))), _hashes("v1"))).alias("h"))
        .join(hinted(keys), "h")
        .groupBy("doc_id", *ITEM)
        .agg(F.countDistinct("h").alias("n"))
        .join(hinted(sizes), ITEM)
        .where(F.col("n") >= F.lit(similarity) * F.col("n_windows"))
        .select("doc_id", *sizes.columns)
    )
    hits = written(found.distinct(), "hits")
    # Only documents that passed are read again, with their values; texts are not shuffled for it unless very many passed.
    passed = hits.select("doc_id").distinct()
    few = passed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(passed) if few else passed, "doc_id", "left_semi")
    inside = _both(_with_tokens(texts, "doc_id", "$2"), "doc_id").select(
        "doc_id",
        "scheme",
        F.explode(_windows(F.col("t"), lambda i: F.struct(i.alias("p"), F.slice("t", i, WINDOW).alias("template"), F.slice("v", i, WINDOW).alias("doc_valued")))).alias("w"),
    ).select("doc_id", "scheme", "w.*")
    placed = written(inside.join(hits, ["doc_id", "scheme"]).join(items.drop("h"), [*ITEM, "template"]).distinct(), "met")

    whole = _judged(placed.drop("p", "q").distinct(), KEY, similarity)
    verbatim = placed.where("valued = doc_valued").drop("p", "q").distinct()
    most = verbatim.groupBy(*KEY).agg(F.countDistinct("valued").alias("n")).where(F.col("n") >= F.lit(similarity) * F.col("n_valued"))
    equal = _judged(verbatim.join(most.select("doc_id", *ITEM), ["doc_id", *ITEM], "left_semi"), KEY, similarity)
    sure = written(whole.withColumn("way", 2 * F.col("scheme")).union(equal.withColumn("way", 2 * F.col("scheme") + 1)), "sure")

    rest = placed.join(sure.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti")
    best = _judged(_occurrences(rest), [*KEY, "start"], similarity)
    order = F.struct("n_found", (F.col("n_consistent") - F.col("n_slots")).alias("fit"), "same", (-F.col("start")).alias("first"), "n_slots", "n_consistent")
    best = best.groupBy(*KEY).agg(F.max(order).alias("m")).select(*KEY, "m.n_found", "m.n_slots", "m.n_consistent", "m.same", (4 + F.col("scheme")).alias("way"))

    values = ["n_windows", "n_found", "n_slots", "n_consistent", "same"]
    chosen = sure.select("doc_id", "item_id", "way", *values).union(best.select("doc_id", "item_id", "way", *values))
    chosen = chosen.groupBy("doc_id", "item_id").agg(F.min(F.struct("way", *values)).alias("m")).select("doc_id", "item_id", "m.*")
    kind = F.when(F.col("n_slots") == F.col("same"), "exact").otherwise("template")
    equal = _with_tokens(texts, "doc_id", "$2").select("doc_id", "v0").join(short, "v0").join(hits.select("doc_id", *ITEM), ["doc_id", *ITEM], "left_semi")
    slots = F.size(F.filter("v0", lambda t: t.startswith("<"))).cast("long")
    equal = equal.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_found"), slots.alias("n_slots"), slots.alias("n_consistent"), F.lit("exact").alias("kind")).distinct()
    return chosen.select("doc_id", "item_id", *values[:-1], kind.alias("kind")).unionByName(equal)


def _occurrences(placed: DataFrame) -> DataFrame:
    """For each place ``start`` where an item could start, the nearest counterpart of each of its windows.

    Starts and windows meet by stretches of the item's length, so their pairs grow with the document, not with its square.
    """
    at = F.col("p") - F.col("q")
    stretch = F.floor(at / F.col("length"))
    starts = placed.select("doc_id", *ITEM, at.alias("start"), stretch.alias("stretch")).distinct()
    near = placed.withColumn("at", at).withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    away = F.abs(F.col("at") - F.col("start"))
    first = F.min(F.struct(away.alias("away"), "at", "doc_valued")).alias("m")
    taken = near.join(starts, ["doc_id", *ITEM, "stretch"]).where(away <= F.col("length")).groupBy(*KEY, "start", "q", "template", "valued").agg(first)
    return taken.withColumn("doc_valued", F.col("m.doc_valued")).drop("m")


def _judged(met: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """``key``, n_found, n_slots, n_consistent and same of pairings (template, valued, doc_valued), where they suffice."""
    totals = met.groupBy(*key).agg(F.countDistinct("template").cast("long").alias("n_found")).where(F.col("n_found") >= F.lit(similarity) * F.col("n_windows"))
    names = [k for k in key if k not in SIZES]
    pairs = (
        met.select(*names, F.explode(F.arrays_zip("valued", "doc_valued")).alias("p"))
        .where(F.col("p.valued").startswith("<"))
        .groupBy(*names, F.col("p.valued").alias("own"), F.col("p.doc_valued").alias("other"))
        .agg(F.count("*").alias("c"))
        .groupBy(*names, "own")
        .agg(F.sum("c").alias("c"), F.max("c").alias("most"), F.sum(F.when(F.col("own") == F.col("other"), F.col("c")).otherwise(0)).alias("same"))
        .groupBy(*names)
        .agg(F.sum("c").alias("n_slots"), F.sum("most").alias("n_consistent"), F.sum("same").alias("same"))
    )
    joined = totals.join(pairs, names, "left").na.fill(0, ["n_slots", "n_consistent", "same"])
    return joined.where(F.col("n_consistent") >= F.lit(similarity) * F.col("n_slots")).select(*key, "n_found", "n_slots", "n_consistent", "same")


def op10_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    def valued(column: str) -> str:
        out = f"regexp_replace(regexp_replace(coalesce({column}, ''), '{RESERVED}', ' ', 'g'), '\\s+', ' ', 'g')"
        for pattern, slot in RULES:
            out = f"regexp_replace({out}, '{pattern}', '\\1<{slot}=\\2>', 'g')"
        return f"regexp_extract_all(lower({out}), '{TOKEN}')"

    def windows(source: str, key: str, name: str) -> str:
        return f"""
      SELECT {key}, template, {name} FROM (
        SELECT {key}, list_slice(t, i, i + {WINDOW - 1}) AS template, list_slice(v, i, i + {WINDOW - 1}) AS {name} FROM (
          SELECT {key}, v, t, unnest(range(1, len(t) - {WINDOW - 2})) AS i FROM (
            SELECT {key}, v, list_transform(v, lambda x: regexp_replace(x, '=[^>]*>', '=>')) AS t FROM (
              SELECT {key}, {valued("text")} AS v FROM {source}))))"""

    return f"""
    WITH items AS MATERIALIZED (SELECT * FROM ({windows("benchmark", "item_id", "valued")}) WHERE len(list_filter(template, lambda x: x[1] <> '<')) >= {LITERALS}),
    sizes AS (SELECT item_id, count(DISTINCT template) AS n_windows FROM items GROUP BY item_id),
    docs AS MATERIALIZED ({windows("documents", "doc_id", "doc_valued")}),
    met AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, template, valued, doc_valued FROM docs JOIN items USING (template)),
    totals AS (SELECT doc_id, item_id, count(DISTINCT template) AS n_found FROM met GROUP BY ALL),
    pairs AS (SELECT doc_id, item_id, own, other, count(*) AS c FROM (
        SELECT doc_id, item_id, unnest(valued) AS own, unnest(doc_valued) AS other FROM met) WHERE own[1] = '<' GROUP BY ALL),
    by_value AS (SELECT doc_id, item_id, own, sum(c) AS c, max(c) AS most, sum(CASE WHEN own = other THEN c ELSE 0 END) AS same FROM pairs GROUP BY ALL),
    slots AS (SELECT doc_id, item_id, sum(c) AS n_slots, sum(most) AS n_consistent, sum(same) AS same FROM by_value GROUP BY ALL)
    SELECT doc_id, item_id, n_windows::BIGINT AS n_windows, n_found::BIGINT AS n_found,
      coalesce(n_slots, 0)::BIGINT AS n_slots, coalesce(n_consistent, 0)::BIGINT AS n_consistent,
      CASE WHEN coalesce(n_slots, 0) = coalesce(same, 0) THEN 'exact' ELSE 'template' END AS kind
    FROM totals JOIN sizes USING (item_id) LEFT JOIN slots USING (doc_id, item_id)
    WHERE n_found >= {SIMILARITY}::DOUBLE * n_windows AND coalesce(n_consistent, 0) >= {SIMILARITY}::DOUBLE * coalesce(n_slots, 0)"""


QUERIES = {"op10_template_decontamination": op10_template_decontamination}
ORACLES = {"op10_template_decontamination": _oracle()}
