"""Quality rules: a table of thresholds compiled into one Spark projection, with no user functions.

Everything is a Spark expression over whole texts: counts of words, symbols, repeated lines and repeated word windows,
and ratios of them. A rule is a row of a table (statistic, least, most); the table compiles into one boolean column. There is
no shuffle, so neither hot keys nor the number of rows matter; a text's memory is a small multiple of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import opaque

SPACES = r"[\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"

#: Frequent function words of the four languages (fixed values, part of the rule table).
STOP_WORDS = "a the of and to in is it that for on with as are be by an this de la le les des et en un une du que est dans pour el los se y con una por del der die das und von zu den mit ist im dem nicht ein eine auf als auch für sich".split()

#: statistic, least, most: a document is kept if each lies within (None: no bound on that side).
THRESHOLDS = (
    ("mean_word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("upper_ratio", None, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, SPACES), "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first included: sort the windows by hash, take those with an equal neighbour, and sum up what they cover."""
    spans = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(spans)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_upper.

    A null text counts as empty: every count is 0. Columns of docs with these names are replaced; other columns stay, whatever their names. Repeated
    rows are counted each; a text of any length is read whole, in a memory of a few times its words; an empty table stays empty.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper")
    old = [c for c in docs.columns if c not in new]
    t = F.coalesce(F.col(text), F.lit(""))
    # the rows travel in a struct, so that no name of theirs can clash
    stage = docs.select(F.struct(*old).alias("_row"), t.alias("_t"), _words(t).alias("_words"), F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(NO_SPACE))).alias("_lines"))
    stage = stage.withColumn("n_words", F.size("_words"))
    stage = stage.withColumn("_spans", _repeat_words(F.col("_words"), F.col("n_words")))
    same = lambda x, k: F.coalesce(F.get(F.col("_spans"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_spans"), k + 1)["h"] == x["h"], F.lit(False))
    stage = stage.withColumn("_twice", opaque(F.sort_array(F.transform(F.filter("_spans", same), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_twice"), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    t = F.col("_t")
    counted = stage.select(
        "_row",
        F.col("n_words").cast("long").alias("n_words"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        opaque(covered.cast("long")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,!?"))).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    return counted.select("_row.*", *new)


def compiled(thresholds: tuple = THRESHOLDS) -> Column:
    """The rule table as one boolean column over statistics()."""
    ratios = {
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "upper_ratio": _ratio(F.col("n_upper"), F.col("word_chars")),
    }
    ok = F.lit(True)
    for name, least, most in thresholds:
        ok = ok & (F.lit(True) if least is None else ratios[name] >= least) & (F.lit(True) if most is None else ratios[name] <= most)
    return ok


def score(docs: DataFrame, thresholds: tuple = THRESHOLDS, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """statistics() with base_failed (too few words, or too many of them in repeated windows) and kept (base and table passed). Columns of docs
    with these two names are replaced; nulls, long and repeated texts and empty tables as in statistics()."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return statistics(docs, text).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(thresholds))


#: ratio, numerator, denominator in SQL
_RATIOS = (("mean_word_length", "word_chars", "n_words"), ("symbol_ratio", "n_symbols", "n_words"), ("stop_word_ratio", "n_stop", "n_words"), ("dup_line_ratio", "n_dup_lines", "n_lines"), ("upper_ratio", "n_upper", "word_chars"))
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The same in SQL, for the default table.
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM s),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM u),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
 len(list_filter(w, lambda x: lower(rtrim(x, '.,!?')) IN ({_STOP}))) AS n_stop,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper FROM s LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 {{ratios}} FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 base_failed, NOT base_failed AND mean_word_length BETWEEN 2.0 AND 14.0 AND symbol_ratio <= 0.1 AND stop_word_ratio >= 0.01 AND dup_line_ratio <= 0.5 AND upper_ratio <= 0.3 AS kept FROM f
""".replace("{ratios}", ", ".join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS {n}" for n, a, b in _RATIOS))
