r"""Quality rules with adaptive thresholds; DataFrame functions only.

Every document gets counts over its whole text (``measure``): rates of symbols, repeated lines and
repeated three-word windows per thousand words or lines, and the mean length of its words in
hundredths. The distribution of each by language and source is kept as a histogram sketch: values
share a cell if their leading ``CELL_BITS`` bits agree, so cells are few however large values are,
sketches of parts merge by adding counts, and a quantile is off by less than one part in 64.

A rule's threshold is a fence beyond the upper (or lower) quartile of its group, so many times the
group's own spread away. The spread is the distance from median to quartile or, where that is less,
what one event makes in the group's median document: a rate that is nearly always 0 has no other
scale. Fences of a group are averaged with those of its language, which weighs as ``PRIOR``
documents: few documents lean on their language, many don't, and no group size is a switch. The
verdict joins documents with the fences of their group. All of it is in whole numbers.

Fixed base rules come first: under 50 words, or over half of the words in repeated three-word windows.

Edge cases: a null text has no words, so it fails the base; null lang or source is a group of its
own; a group without a document that passes the base has no fences, and needs none; repeated rows
count as often as they occur; long texts are measured whole, as arrays of their words; further
columns, of any names, are kept; an empty table gives an empty result. Equal windows are found by a
hash of over 40 bits that sorts them next to each other, then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, checked_broadcast, cut, fresh, let, table, whole, words, written

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules: how many spreads beyond the quartile a rate may lie.
REACH = {"symbol_rate": 16, "dup_line_rate": 3, "repeat_rate": 120, "word_length": 24}
#: What one event is measured against: words or lines of the median document.
PER = {"symbol_rate": "n_words", "dup_line_rate": "n_lines", "repeat_rate": "n_words", "word_length": "n_words"}
MEASURES = (*REACH, "n_words", "n_lines")
#: Leading bits that a cell of the sketch keeps of a value.
CELL_BITS = 7
#: Documents that the fences of a language weigh as in those of a group.
PRIOR = 25


def _repeated_words(w: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more."""
    n = F.size(w)
    low = F.length(F.bin(n.cast("long"))).cast("int")  # bits of a position

    def window_hash(i: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), low).bitwiseOR(i.cast("long"))

    def counted(keys: Column) -> Column:
        last = F.size(keys) - 1

        def at(v: Column) -> Column:
            return v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1).cast("int")

        def same(u: Column, v: Column) -> Column:
            a, b = at(u), at(v)
            return (F.call_function("shiftright", u, low) == F.call_function("shiftright", v, low)) & (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])

        twice = F.filter(keys, lambda v, j: F.when(j > 0, same(v, F.get(keys, j - 1))).otherwise(False) | F.when(j < last, same(v, F.get(keys, j + 1))).otherwise(False))
        starts = F.sort_array(F.transform(twice, at))
        covered = lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y)
        return let(starts, covered)

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window_hash))
    return F.when(n < 4, F.lit(0)).otherwise(let(keys, counted)).cast("long")


def _counts(text: Column) -> Column:
    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    by_words, by_lines = let(words(text), of_words), let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR)), of_lines)
    return F.struct(
        by_words.alias("words"),
        by_lines.alias("lines"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


WORD_CHAR = r"[^\x20\x09-\x0D]"


def measure(docs: DataFrame, into: str = "quality") -> DataFrame:
    """``docs`` with a struct of the counts, the rates and ``base_failed``."""
    (c,) = fresh(docs, "counted")
    got, n = F.col(c), F.col(c)["words"]["n_words"]
    rate = lambda x, of, unit=1000: F.when(of > 0, F.floor(unit * x / of)).otherwise(0).cast("long")
    repeats, lines = got["words"]["n_repeat_words"], got["lines"]
    return (
        docs.withColumn(c, _counts(whole("text")))
        .withColumn(
            into,
            F.struct(
                n.alias("n_words"),
                got["word_chars"].alias("word_chars"),
                got["n_symbols"].alias("n_symbols"),
                lines["n_lines"].alias("n_lines"),
                lines["n_dup_lines"].alias("n_dup_lines"),
                repeats.alias("n_repeat_words"),
                rate(got["n_symbols"], n).alias("symbol_rate"),
                rate(lines["n_dup_lines"], lines["n_lines"]).alias("dup_line_rate"),
                rate(repeats, n).alias("repeat_rate"),
                rate(got["word_chars"], n, 100).alias("word_length"),
                ((n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)).alias("base_failed"),
            ),
        )
        .drop(c)
    )


def _cell(value: Column) -> Column:
    """The largest value that shares the leading bits of ``value``."""
    shift = F.greatest(F.length(F.bin(value)) - CELL_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1


def sketches(measured: DataFrame, quality: str = "quality") -> DataFrame:
    """lang, source, measure, cell, n: merged histograms of the documents that pass the base."""
    q = F.col(quality)
    values = F.array(*[F.struct(F.lit(m).alias("measure"), _cell(q[m]).alias("cell")) for m in MEASURES])
    long = measured.filter(~q["base_failed"]).select("lang", "source", F.explode(values).alias("x"))
    return long.groupBy("lang", "source", F.col("x.measure").alias("measure"), F.col("x.cell").alias("cell")).agg(F.count("*").alias("n"))


def _fences(cells: DataFrame, by: list[str]) -> DataFrame:
    """docs, and above (and below, for the length of words) of each rule, for each group."""
    part = W.partitionBy(*by, "measure")
    placed = cells.withColumn("upto", F.sum("n").over(part.orderBy("cell"))).withColumn("all", F.sum("n").over(part))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("cell")))
    per = placed.groupBy(*by, "measure").agg(F.max("all").alias("docs"), F.struct(quartile(1).alias("low"), quartile(2).alias("mid"), quartile(3).alias("high")).alias("q"))
    one = per.groupBy(*by).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in MEASURES])
    out = []
    for rule, reach in REACH.items():
        q, of = F.col(rule), F.greatest(F.col(PER[rule])["mid"], F.lit(1))
        least = F.floor(reach * q["mid"] / (4 * F.sqrt(of.cast("double")))) if rule == "word_length" else F.floor(F.lit(1000 * reach) / of)
        out.append((q["high"] + F.greatest(reach * (q["high"] - q["mid"]), least)).alias(f"above_{rule}"))
        if rule == "word_length":
            out.append((q["low"] - F.greatest(reach * (q["mid"] - q["low"]), least)).alias(f"below_{rule}"))
    return one.select(*by, "docs", *out)


BOUNDS = (*[f"above_{r}" for r in REACH], "below_word_length")


def thresholds(measured: DataFrame, quality: str = "quality") -> DataFrame:
    """fence_lang, fence_source, fence_weight and a bound for each rule, times the weight; a row for each group of documents."""
    cells = cut(sketches(measured, quality))
    lang = _fences(cells.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")), ["lang"])
    lang = lang.select(F.col("lang").alias("of_lang"), *[F.col(b).alias(f"{b}_lang") for b in BOUNDS])
    joined = _fences(cells, ["lang", "source"]).join(checked_broadcast(cut(lang)), F.col("lang").eqNullSafe(F.col("of_lang")))
    both = [(F.col("docs") * F.col(b) + PRIOR * F.col(f"{b}_lang")).alias(f"fence_{b}") for b in BOUNDS]
    return cut(joined.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), (F.col("docs") + PRIOR).alias("fence_weight"), *both))


def judge(measured: DataFrame, fences: DataFrame, quality: str = "quality", into: str = "kept") -> DataFrame:
    """``measured`` with ``kept``: it passes the base and no measure is beyond a fence of its group."""
    q = F.col(quality)
    joined = measured.join(checked_broadcast(fences), measured["lang"].eqNullSafe(F.col("fence_lang")) & measured["source"].eqNullSafe(F.col("fence_source")), "left")
    inside = q["word_length"] * F.col("fence_weight") >= F.col("fence_below_word_length")
    for r in REACH:
        inside = inside & (q[r] * F.col("fence_weight") <= F.col(f"fence_above_{r}"))
    return joined.withColumn(into, ~q["base_failed"] & F.coalesce(inside, F.lit(False))).drop(*fences.columns)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. Texts are measured once, and written with their counts."""
    into, kept = fresh(docs, "quality", "kept")
    measured = written(measure(docs, into), "quality")
    judged = judge(measured, thresholds(measured, into), into, kept)
    return judged.filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    measured = cut(measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    judged = judge(measured, thresholds(measured))
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


SQL = r"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM listed)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT l.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM listed l LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines USING (doc_id)
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length
  FROM counts
), long AS (
  SELECT lang, source, measure, value FROM (
    SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length', 'n_words', 'n_lines']) AS measure,
           unnest([symbol_rate, dup_line_rate, repeat_rate, word_length, n_words, n_lines]) AS value
    FROM rated WHERE NOT base_failed)
), cells AS (
  SELECT lang, source, measure, (((value >> s) + 1) << s) - 1 AS cell FROM (SELECT *, greatest(length(bin(value)) - 7, 0) AS s FROM long)
), grouped AS (
  SELECT 'own' AS level, lang, source, measure, cell FROM cells UNION ALL SELECT 'lang', lang, NULL, measure, cell FROM cells
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY cell) AS k, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM grouped
), quartiles AS (
  SELECT level, lang, source, measure, max(n) AS docs, min(cell) FILTER (WHERE 4 * k >= n) AS low, min(cell) FILTER (WHERE 4 * k >= 2 * n) AS mid, min(cell) FILTER (WHERE 4 * k >= 3 * n) AS high
  FROM placed GROUP BY level, lang, source, measure
), scales AS (
  SELECT level, lang, source, max(docs) AS docs, greatest(max(mid) FILTER (WHERE measure = 'n_words'), 1) AS w, greatest(max(mid) FILTER (WHERE measure = 'n_lines'), 1) AS l
  FROM quartiles GROUP BY level, lang, source
), fences AS (
  SELECT s.level, s.lang, s.source, s.docs,
         max(high + greatest(16 * (high - mid), 16000 // w)) FILTER (WHERE measure = 'symbol_rate') AS symbols,
         max(high + greatest(3 * (high - mid), 3000 // l)) FILTER (WHERE measure = 'dup_line_rate') AS dups,
         max(high + greatest(120 * (high - mid), 120000 // w)) FILTER (WHERE measure = 'repeat_rate') AS repeats,
         max(high + greatest(24 * (high - mid), CAST(floor(24 * mid / (4 * sqrt(CAST(w AS DOUBLE)))) AS BIGINT))) FILTER (WHERE measure = 'word_length') AS longest,
         max(low - greatest(24 * (mid - low), CAST(floor(24 * mid / (4 * sqrt(CAST(w AS DOUBLE)))) AS BIGINT))) FILTER (WHERE measure = 'word_length') AS shortest
  FROM scales s JOIN quartiles q ON s.level = q.level AND s.lang IS NOT DISTINCT FROM q.lang AND s.source IS NOT DISTINCT FROM q.source GROUP BY ALL
), joined AS (
  SELECT o.lang, o.source, o.docs + 25 AS n, o.docs * o.symbols + 25 * l.symbols AS symbols, o.docs * o.dups + 25 * l.dups AS dups,
         o.docs * o.repeats + 25 * l.repeats AS repeats, o.docs * o.longest + 25 * l.longest AS longest, o.docs * o.shortest + 25 * l.shortest AS shortest
  FROM fences o JOIN fences l ON o.level = 'own' AND l.level = 'lang' AND o.lang IS NOT DISTINCT FROM l.lang
)
SELECT q.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_rate * n <= symbols AND dup_line_rate * n <= dups AND repeat_rate * n <= repeats
         AND word_length * n <= longest AND word_length * n >= shortest, FALSE) AS kept
FROM rated q LEFT JOIN joined f ON q.lang IS NOT DISTINCT FROM f.lang AND q.source IS NOT DISTINCT FROM f.source
"""
