"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, pick

STOP_WORDS = (
    "the of and to in a is that for with as on be this was by it are from or "
    "der die das und ist in den von zu mit für auf ein eine nicht sich des im dem als auch an wird "
    "de la que el en y los del se las por un para con una su al es lo "
    "le les des et est une du pour dans qui au sur par plus ne pas"
).split()

#: Rule, measure, least and most value (None: no bound), and from how many words on it applies.
#: A document must meet all that apply. A text whose every word is doubled has a repeat_ratio of
#: 0.5; one of few words tells nothing by its stop words.
RULES: list[tuple[str, str, float | None, float | None, int]] = [
    ("few_words", "n_words", 3, None, 0),
    ("word_length", "mean_word_length", 1.5, 12.0, 0),
    ("symbols", "symbol_ratio", None, 0.1, 0),
    ("no_letters", "alpha_ratio", 0.3, None, 0),
    ("capitals", "upper_ratio", None, 0.5, 0),
    ("no_stop_words", "stop_ratio", 0.02, None, 20),
    ("repeated_words", "repeat_ratio", None, 0.4, 0),
    ("bars", "bar_ratio", None, 0.1, 0),
    ("repeated_lines", "dup_line_ratio", None, 0.6, 0),
    ("bullets", "bullet_ratio", None, 0.9, 0),
    ("ellipses", "ellipsis_ratio", None, 0.5, 0),
]


SYMBOLS = "#$%&*^~<>{}[]|\\"


def measures(text) -> dict[str, "F.Column"]:
    """Spark expressions over the columns text, words and lines."""
    n = F.col("n_words").cast("double")
    lines = F.size("lines").cast("double")
    chars = F.col("n_solid").cast("double")
    # How many characters of a class: what is left once runs of others are gone.
    count = lambda p: F.length(F.regexp_replace(text, f"[^{p}]+", "")).cast("double")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    held = lambda p: F.expr(f"size(filter(lines, l -> {p}))").cast("double")
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return {
        "n_words": n,
        "mean_word_length": part(chars, n),
        "symbol_ratio": part((F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("double"), n),
        "alpha_ratio": part(count("\\p{L}"), chars),
        "upper_ratio": part(count("\\p{Lu}"), chars),
        "stop_ratio": part(F.expr(f"size(filter(words, w -> rtrim('.,;:?', w) IN ({stops})))").cast("double"), n),
        "repeat_ratio": part(F.expr("size(filter(words, (w, i) -> i > 0 AND w = words[i - 1]))").cast("double"), n),
        "bar_ratio": part(F.expr("size(filter(words, w -> w = '|'))").cast("double"), n),
        "dup_line_ratio": part(lines - F.size(F.array_distinct("lines")).cast("double"), lines),
        "bullet_ratio": part(held("startswith(l, '- ') OR startswith(l, '* ')"), lines),
        "ellipsis_ratio": part(held("endswith(l, '...') OR endswith(l, '…')"), lines),
    }


def check(docs: DataFrame, rules: list[tuple[str, str, float | None, float | None, int]] = RULES) -> DataFrame:
    """(doc_id, the measures, failed: the names of the rules that a document fails, joined by commas, keep).

    Words are runs without white space, compared in lower case; lines are what line feeds divide,
    without empty ones. Defined cases: a null text counts as an empty one, of which every measure
    is 0 (so it fails few_words and others); ratios with nothing to divide by are 0; a null doc_id
    stays null; repeated rows are judged alike; an empty table gives no rows; extra columns are
    ignored.
    """
    base = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x != ""))
    base = base.withColumn("n_words", F.size("words")).withColumn("n_solid", F.length(F.translate("text", " \t\r\n", "")))
    found = measures(F.col("text"))
    out = base.select("doc_id", *[c.alias(k) for k, c in found.items()])
    fails = []
    for name, measure, low, high, least in rules:
        tests = [F.col(measure) < low] if low is not None else []
        tests += [F.col(measure) > high] if high is not None else []
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        fails.append(F.when(test & (F.col("n_words") >= least) if least else test, F.lit(name)))
    out = out.withColumn("failed", F.concat_ws(",", *fails))
    return out.withColumn("keep", F.col("failed") == "")


def _oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    part = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0::DOUBLE END"
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    held = lambda p: f"len(list_filter(lines, lambda l: {p}))"
    m = {
        "n_words": "n::DOUBLE",
        "mean_word_length": part("chars", "n"),
        "symbol_ratio": part(count("[#$%&*^~<>{}\\[\\]|\\\\]"), "n"),
        "alpha_ratio": part(count("[\\p{L}]"), "chars"),
        "upper_ratio": part(count("[\\p{Lu}]"), "chars"),
        "stop_ratio": part(f"len(list_filter(words, lambda w: rtrim(w, '.,;:?') IN ({stops})))", "n"),
        "repeat_ratio": part("len(list_filter(list_zip(words[2:], words[:-2]), lambda z: z[1] = z[2]))", "n"),
        "bar_ratio": part("len(list_filter(words, lambda w: w = '|'))", "n"),
        "dup_line_ratio": part("len(lines) - len(list_distinct(lines))", "len(lines)"),
        "bullet_ratio": part(held("starts_with(l, '- ') OR starts_with(l, '* ')"), "len(lines)"),
        "ellipsis_ratio": part(held("ends_with(l, '...') OR ends_with(l, '…')"), "len(lines)"),
    }
    fails = []
    for name, measure, low, high, least in RULES:
        tests = [f"{measure} < {low}"] * (low is not None) + [f"{measure} > {high}"] * (high is not None)
        fails.append(f"CASE WHEN n_words >= {least} AND ({' OR '.join(tests)}) THEN '{name}' END")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    b AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{TOKEN}') AS words, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines,
                 length(translate(text, ' ' || chr(9) || chr(13) || chr(10), '')) AS chars FROM d),
    c AS (SELECT *, len(words) AS n FROM b),
    m AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in m.items())} FROM c),
    f AS (SELECT *, concat_ws(',', {", ".join(fails)}) AS failed FROM m)
    SELECT *, failed = '' AS keep FROM f
    """


ORACLE = _oracle()
