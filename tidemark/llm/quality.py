"""Quality rules: a threshold table compiled into one Spark projection.

Everything here is DataFrame and SQL functions; no Python runs on executors.

Defined cases: a null text counts as the empty text, which has no words and so
fails the base rule. Ties and repeated rows are judged one by one. Extra
columns of the input, whatever their names, are not read. Texts of any length
are judged whole; the work per text is n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_of

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is a that for it with as was by on be this are from at "
    "der die das und den mit von ist im auf nicht ein eine als sich auch zu des "
    "le la les de un une en est pour dans que du sur par au avec et "
    "el los las y del por con para se al"
).split()

#: As they stand in a text: in lower case, or at the start of a sentence.
STOP_FORMS = [form for word in STOP_WORDS for form in (word, word.capitalize())]

#: Symbols that prose seldom holds (fixed values).
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """low * per <= metric * scale <= high * per, in whole numbers; None is no limit."""

    name: str
    metric: str
    per: str | None
    scale: int
    low: int | None
    high: int | None


#: The threshold table. Ratios are kept in whole numbers so that any engine
#: gives the same verdict. `per` None compares the metric itself.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 10, 25, 140),
    Rule("symbols_per_word", "n_symbols", "n_words", 100, None, 10),
    Rule("shouts_per_word", "n_shouts", "n_words", 100, None, 30),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 100, 4, None),
    Rule("letters_per_char", "n_letters", "word_chars", 100, 60, None),
    Rule("lines_per_word", "n_lines", "n_words", 100, None, 34),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", 100, None, 50),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compile_rules(rules=RULES) -> Column:
    """One boolean column that holds where every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.metric) * F.lit(rule.scale)
        base = F.col(rule.per) if rule.per else F.lit(1)
        if rule.low is not None:
            verdict = verdict & (value >= base * F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (value <= base * F.lit(rule.high))
    return verdict


def _window_keys(words: Column) -> Column:
    """A 64-bit key of each three-word window, in order of its start."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )


def _sorted_windows(keys: Column) -> Column:
    return F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))


def _repeated_starts(ordered: Column, words: Column) -> Column:
    """Starts of the windows whose words occur again, ascending.

    Windows of equal key lie side by side; their words are then compared.
    """
    pairs = F.array_compact(
        F.zip_with(
            ordered,
            F.slice(ordered, 2, F.size(ordered)),
            lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])),
        )
    )
    equal = F.filter(
        pairs,
        lambda p: (words[p[0]] == words[p[1]])
        & (words[p[0] + 1] == words[p[1] + 1])
        & (words[p[0] + 2] == words[p[1] + 2]),
    )
    return F.sort_array(F.array_distinct(F.flatten(equal)))


def _covered_words(starts: Column) -> Column:
    """How many words the three-word windows at these ascending starts cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The metrics of each text beside the carried columns.

    Staged so that the word and line arrays are computed once each and dropped
    as soon as they have been counted.
    """
    carry = ["doc_id"] if carry is None else carry
    kept = F.struct(*carry).alias("__carried")
    text = F.col("__text")
    words, lines, keys = F.col("__words"), F.col("__lines"), F.col("__keys")
    staged = docs.select(kept, text_of(text_col).alias("__text"))
    staged = staged.select(
        "__carried",
        "__text",
        F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("__lines"),
    )
    staged = staged.select(
        "__carried",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(text, "[^a-zA-Z\\x80-\\x{10FFFF}]+", "")).cast("long").alias("n_letters"),
        F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        words,
        F.when(F.size(words) >= 3, _window_keys(words)).alias("__keys"),
    )
    counted = [c for c in staged.columns if not c.startswith("__")]
    staged = staged.select(
        "__carried",
        *counted,
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), _sorted_windows(keys)).alias("__ordered"),
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), words).alias("__words"),
    )
    staged = staged.select("__carried", *counted, _repeated_starts(F.col("__ordered"), words).alias("__starts"))
    return staged.select(
        "__carried", *counted, F.coalesce(_covered_words(F.col("__starts")), F.lit(0).cast("long")).alias("n_repeat_words")
    )


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, rules=RULES) -> DataFrame:
    """Metrics, `base_failed` and `kept`; carried columns stay in the struct `__carried`."""
    measured = measure(docs, text_col, carry)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return measured.select(
        *measured.columns, base_failed.alias("base_failed"), (~base_failed & compile_rules(rules)).alias("kept")
    )


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its metrics and its verdict."""
    judged = judge(docs, text_col, [id_col])
    return judged.select(
        F.col(f"__carried.`{id_col}`").alias(id_col),
        *[c for c in judged.columns if c != "__carried"],
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns unchanged."""
    judged = judge(docs, text_col, [f"`{c}`" for c in docs.columns])
    # A row number in the projection below the filter: over a projection that is
    # not deterministic the optimizer leaves the filter where it is. Pushed down,
    # the verdict would be spelled out in terms of the text, each metric again
    # for each rule that uses it.
    numbered = judged.select("__carried", "kept", F.monotonically_increasing_id().alias("__row"))
    return numbered.where(F.col("kept") & (F.col("__row") >= 0)).select("__carried.*")
