"""Quality rules: a short-circuit cascade, native DataFrame expressions only.

Base counts are whole-text statistics. The verdict comes from a cascade of
rules: cost (seconds on a bounded sample) and selectivity (share rejected) are
measured for each rule, rules are ordered by rejection per cost, and a nested
CASE stops at the first rule that rejects. The order changes only the cost,
never the verdict, since a document is kept only if no rule rejects it.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged one by one; a very long text is judged whole; rules
that reject alike per second are ordered by cost, then name, which changes no
verdict; extra columns stay as they are, and the
operator's own columns replace columns of the same name; an empty table gives
an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK_REGEX, hash_sample, materialise, table

#: Words of a window, least number of words, most per cent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Bound of the sample on which cost and selectivity are estimated, and runs of each rule on it.
SAMPLE_ROWS, RUNS = 1000, 2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_TEXT = "coalesce(text, '')"
_WORDS = f"array_remove(split({_TEXT}, '{WORD_BREAK_REGEX}'), '')"
_LINES = rf"filter(split({_TEXT}, '\n'), l -> btrim(l, ' \t\n\u000b\f\r') != '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shifted(name: str, by: int) -> str:
    return f"zip_with(slice({name}, 1, size({name}) - {by}), slice({name}, {by + 1}, size({name}) - {by}), (a, b) -> xxhash64(a, b))"


def _windows(words: str) -> str:
    """Hashes of all windows of 8 words: three doublings over word hashes."""
    two = _let(f"transform({words}, w -> xxhash64(w))", "h1", _shifted("h1", 1))
    four = _let(two, "h2", _shifted("h2", 2))
    return _let(four, "h4", _shifted("h4", 4))


def _covered(h: str) -> str:
    """Words under windows that occur at least twice; sorts only texts that have such windows."""
    order = f"array_sort(transform({h}, (x, i) -> struct(x AS h, i AS i)))"
    twice = "filter(transform(s, (x, j) -> IF(x.h = get(s, j - 1).h OR x.h = get(s, j + 1).h, x.i, NULL)), x -> x IS NOT NULL)"
    gaps = f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> CAST(least({WINDOW}, coalesce(b - a, {WINDOW})) AS BIGINT)), 0L, (t, x) -> t + x)"
    return _let(order, "s", _let(f"array_sort({twice})", "p", f"IF(size(p) = 0, 0L, {gaps})"))


def _expressions() -> dict[str, str]:
    return {
        "n_symbols": f"CAST(regexp_count({_TEXT}, '[#*$%&|<>]') AS BIGINT)",
        "n_dup_lines": _let(_LINES, "ls", "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)"),
    }


def counts(docs: DataFrame) -> DataFrame:
    """docs with the five base counts; the words of a text are split once."""
    e = _expressions()
    w = {
        "n_words": "CAST(size(w) AS BIGINT)",
        "word_chars": "CAST(length(array_join(w, '')) AS BIGINT)",
        "n_repeat_words": _repeated("w"),
    }
    by_word = _let(_WORDS, "w", "struct(" + ", ".join(f"{v} AS {k}" for k, v in w.items()) + ")")
    docs = docs.drop(*COUNTS, "_w").withColumn("_w", F.expr(by_word))
    docs = docs.withColumns({k: F.col("_w")[k] for k in w} | {k: F.expr(e[k]) for k in ("n_symbols", "n_dup_lines")})
    return docs.drop("_w")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _repeated(words: str) -> str:
    return f"IF(size({words}) < {WINDOW}, 0L, {_let(_windows(words), 'h', f'IF(size(array_distinct(h)) = size(h), 0L, {_covered("h")})')})"


def rules() -> dict[str, str]:
    """Rule name -> SQL that is true where the rule rejects, over the text and `w`, its words, which all rules share."""
    letters, chars = rf"regexp_count({_TEXT}, '\\p{{L}}')", "length(array_join(w, ''))"
    return {
        "few_words": f"size(w) < {LEAST_WORDS}",
        "repeated_windows": f"100 * {_repeated('w')} > {MOST_REPEATED} * size(w)",
        "symbols": f"10 * regexp_count({_TEXT}, '[#*$%&|<>]') > 3 * size(w)",
        "shouting": rf"10 * regexp_count({_TEXT}, '\\p{{Lu}}') > 5 * {letters}",
        "few_letters": f"10 * {letters} < 4 * {chars}",
        "word_length": _let(chars, "n", "n < 2 * size(w) OR n > 20 * size(w)"),
        "repeated_lines": _let(_LINES, "ls", "10 * (size(ls) - size(array_distinct(ls))) > 5 * size(ls)"),
    }


def plan_cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, best rejection per second first, measured on about sample_rows rows (at most twice as many).

    A rule's cost is its fastest run of RUNS, less that of a job that only
    splits the words: neither compilation nor a job's own overhead counts.
    """
    sample = materialise(hash_sample(docs.select("text"), ["text"], sample_rows, docs.count()), "quality-sample")

    def timed(rule: str) -> tuple[float, float]:
        seconds, rejects = [], F.expr(_let(_WORDS, "w", rule))
        for _ in range(RUNS):
            began = time.perf_counter()
            row = sample.agg(F.count("*").alias("n"), F.count_if(rejects).alias("bad")).first()
            seconds.append(time.perf_counter() - began)
        return min(seconds), row["bad"] / max(1, row["n"])

    empty, _ = timed("size(w) < 0")
    measured = []
    for name, rule in rules().items():
        seconds, rejected = timed(rule)
        seconds = max(seconds - empty, 1e-3)
        measured.append((-rejected / seconds, seconds, name))
    return [name for _, _, name in sorted(measured)]


def cascade(order: list[str]) -> Column:
    """True where no rule rejects; the words are split once, and later rules are not evaluated after a rejection."""
    found = rules()
    return F.expr(_let(_WORDS, "w", "CASE " + " ".join(f"WHEN {found[name]} THEN false" for name in order) + " ELSE true END"))


def quality_filter(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, unchanged, with all their columns whatever their names."""
    return docs.where(cascade(plan_cascade(docs, sample_rows)))


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, base_failed and the verdict for every row.

    The rules that need the base counts alone read them from the columns; only
    the others look at the text again, and only where the base has not failed.
    """
    order = [r for r in plan_cascade(docs, sample_rows) if r not in ("few_words", "repeated_windows")]
    c = F.col
    cheap = {
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "few_letters": 10 * F.expr(rf"regexp_count({_TEXT}, '\\p{{L}}')") < 4 * c("word_chars"),
    }
    found = {k: F.expr(_let("array('')", "w", v)) for k, v in rules().items() if k in ("shouting", "repeated_lines")} | cheap
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(found[name], F.lit(False)).otherwise(verdict)
    out = counts(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(c("base_failed"), F.lit(False)).otherwise(verdict))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents: base counts and verdict per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_report(docs).select("doc_id", *COUNTS, "base_failed", "kept")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
c AS (
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper_letters
 FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * upper_letters > 5 * letters OR 10 * letters < 4 * word_chars
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 5 * len(ls)) AS kept
FROM b
""".replace("{{", "{").replace("}}", "}")
