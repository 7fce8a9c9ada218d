"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (metric, relation, bound); the metrics and the rules become
columns of a single projection of built-in functions over the text, with no user
function, join or shuffle: a map-only pass at any size.

The one costly metric is the number of words in repeated 5-word windows. Windows
are hashed (64 bits each, within one text) and a text whose windows are all
different, as most are, stops at `array_distinct`; only others sort their windows.

Defined cases: a null text is an empty one; an empty text has zero words, which
fails the base rule; a null id changes nothing; very long texts are judged whole (beyond
a million words they fail); a value that equals a bound doesn't meet its relation; repeated
rows are judged row by row; columns of the names that the operator adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.llm.common import SPACE, let, table, text_or_empty, without

#: (metric, relation, bound): a text that meets a row's relation fails.
#: The ratios are per word, but dup_line_ratio per line with a word and upper_ratio per character of a word;
#: half a stop word is added, so that a short text isn't judged by chance.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", "<", 10),
    ("n_words", ">", 1_000_000),
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 20.0),
    ("symbol_ratio", ">", 0.30),
    ("dup_line_ratio", ">", 0.50),
    ("repeat_word_ratio", ">", 0.20),
    ("stop_word_ratio", "<", 0.03),
    ("upper_ratio", ">", 0.60),
    ("bar_ratio", ">", 0.25),
)

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that for it with as was on be at by this are or from an but not have "
    "der die das und ist nicht ein eine zu den mit von sich auf für dem im des als auch "
    "le la les et de un une des du en que qui pour dans pas par sur au avec est "
    "el los las y del se por con para su al lo como más no una"
).split()

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _repeat_words(w: Column, width: int = 5) -> Column:
    """Words of `w` inside windows of `width` words that occur twice or more (the first one included)."""
    n = F.size(w)

    def counted(hashes: Column) -> Column:
        def covered(at: Column) -> Column:
            # `at`: sorted starts of repeated windows; each adds what the next one doesn't cover.
            return F.aggregate(
                at,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 30)).cast("int").alias("to")),
                lambda acc, i: F.struct((acc["n"] + (i + width - F.greatest(acc["to"], i))).alias("n"), (i + width).cast("int").alias("to")),
                lambda acc: acc["n"],
            )

        def repeated(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
            at = F.transform(
                F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
                lambda i: F.get(pairs, i)["i"],
            )
            return covered(F.sort_array(at))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, repeated))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    # Words are hashed once, windows over the words' hashes.
    return F.when(n <= width, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), counted)))


def _metrics(text: Column, stop_words: list[str]) -> Column:
    """A struct of counts for one text."""
    longest = max(map(len, stop_words))
    w = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: (F.length(x) <= longest) & F.lower(x).isin(stop_words))).cast("long").alias("n_stop"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    count = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")
    return F.struct(
        let(w, of).alias("w"),
        let(lines, of_lines).alias("l"),
        count("#*$%&|<>").alias("n_symbols"),
        count("|").alias("n_bars"),
        count("A-Z").alias("n_upper"),
    )


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[tuple[str, str, float], ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """docs with the counts, base_failed, kept, and failed_rules (like 'symbol_ratio > 0.3')."""
    m = "_quality"
    out = without(docs, [*ADDED, m]).withColumn(m, _metrics(text_or_empty(text_col), stop_words))
    at = lambda name: F.col(f"{m}.{name}")
    words, lines = F.greatest(at("w.n_words"), F.lit(1)), F.greatest(at("l.n_lines"), F.lit(1))
    metric = {
        "n_words": at("w.n_words"),
        "mean_word_chars": at("w.word_chars") / words,
        "symbol_ratio": at("n_symbols") / words,
        "dup_line_ratio": at("l.n_dup_lines") / lines,
        "repeat_word_ratio": at("w.n_repeat_words") / words,
        "stop_word_ratio": (at("w.n_stop") + 0.5) / words,
        "upper_ratio": at("n_upper") / F.greatest(at("w.word_chars"), F.lit(1)),
        "bar_ratio": at("n_bars") / words,
    }
    fails = [F.when(metric[k] < v if rel == "<" else metric[k] > v, F.lit(f"{k} {rel} {v:g}")) for k, rel, v in rules]
    base = (at("w.n_words") < 10) | (100 * at("w.n_repeat_words") > 20 * at("w.n_words"))
    failed = F.array_compact(F.array(*fails))
    return out.select(
        *[c for c in out.columns if c != m],
        *[at(k).alias(k.split(".")[1]) for k in ("w.n_words", "w.word_chars")],
        at("n_symbols").alias("n_symbols"),
        at("l.n_dup_lines").alias("n_dup_lines"),
        at("w.n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed_rules"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LIST = ", ".join(f"'{x}'" for x in STOP_WORDS)
_FAILS = " OR ".join(f"{k} {rel} {v!r}" for k, rel, v in RULES)

ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACES}) <> '') AS l
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM docs, unnest(range(1, len(w) - 3)) AS t(i)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM repeated, unnest(range(i, i + 5)) AS t(p) GROUP BY r
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: lower(x) IN ({_LIST}))) AS n_stop
  FROM docs LEFT JOIN covered USING (r)
), ratios AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
         (n_stop + 0.5::DOUBLE) / greatest(n_words, 1) AS stop_word_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio, n_bars / greatest(n_words, 1) AS bar_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {_FAILS}) AS kept FROM ratios
"""
