"""Quality rules: native DataFrame operations only.

Base counts of a text come first; then two histograms are compared to those of each language
by Jensen-Shannon distance (base 2, 0 to 1): character classes, and common words (one bin each
and one for all other words). A language's reference is the sum over all its documents; a text
is judged by the nearest language. The distances of short texts are noise, so each has a guard:
a least number of characters, or words, below which it decides nothing.

A null or empty text has no words and fails the base rules. Documents without a language, or of
one without a word list, enter no reference but are judged. If a reference is missing, its
distance is absent and rejects nothing. Repeated rows are judged alike; extra columns are
carried by :func:`judge`; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm.common import GAP, sealed
from topicweave.session import Scratch

# Common words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "en": "the of and to a in is that it on for with as was be by this are".split(),
    "es": "de la que el en y a los del se las por un para con no una su".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur".split(),
}
WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
PUNCTUATION = r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]"
UPPER = r"\p{Lu}"
DIGITS = "[0-9]"
RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "class_distance", "word_distance", "base_failed", "kept",
]
CLASSES = ["white", "symbols", "punctuation", "upper", "digits", "others"]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Largest distance to the nearest language, and the least length for it to decide.
    max_class_distance: float = 0.25
    class_guard: int = 100
    #: For words, below what a text without any listed word gets (0.331 and more where a fifth
    #: of a reference's words are listed): the least dense place between ordinary texts and those.
    max_word_distance: float = 0.27
    word_guard: int = 100
    words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)

    @property
    def listed(self) -> list[str]:
        return sorted({w for own in self.words.values() for w in own})


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _length_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def class_counts(text: Column, marks: Column) -> Column:
    """Characters per class, in the order of ``CLASSES``; ``marks`` is the text without others."""
    patterns = [WHITE, SYMBOLS, PUNCTUATION, UPPER]
    rest = F.length(marks)
    parts = [_length_of(marks, p) for p in patterns]
    digits = rest - reduce(lambda a, x: a + x, parts)
    counts = [*parts, digits, F.length(text) - rest]
    return F.array(*[c.cast("double") for c in counts])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def word_counts(words: Column, listed: list[str]) -> Column:
    """Occurrences of each listed word, in any case: the words found become one letter each,
    and the letters are counted by taking them away."""
    letters = {w: chr(0x4E00 + i) for i, w in enumerate(listed)}
    code = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    longest = max(map(len, listed))
    short = F.transform(F.filter(words, lambda w: F.length(w) <= longest), F.lower)
    found = F.transform(F.filter(short, lambda w: w.isin(listed)), lambda w: F.element_at(code, w))
    return let(
        F.array_join(found, ""),
        lambda s: F.array(
            *[(F.length(s) - F.length(F.replace(s, F.lit(c)))).cast("double") for c in letters.values()]
        ),
    )


def windows_of(words: Column) -> Column:
    """A hash of each 3-word window, in order."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def repeated_words(windows: Column) -> Column:
    """Words covered by the windows that occur twice or more among a text's 3-word windows."""

    def of_sorted(p: Column) -> Column:
        def twice(s: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(p, F.greatest(j - 1, F.lit(0)))["h"] == s["h"])
            return before | F.coalesce(F.get(p, j + 1)["h"] == s["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(p, twice), lambda s: s["i"]))
        return let(
            places,
            lambda q: F.aggregate(
                F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(placed, of_sorted)


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram to a reference histogram."""
    q = F.array(*[F.lit(float(x)) for x in reference])

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of_bin(p: Column, r: Column) -> Column:
        # a bin the text lacks adds half the reference's share
        both = let((p + r) / 2, lambda m: (part(p, m) + part(r, m)) / 2)
        return F.when(p == 0, r / 2).otherwise(both)

    def of_share(total: Column) -> Column:
        shares = F.transform(counts, lambda c: c / total)
        return F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(shares, q, of_bin))))

    return let(_total(counts), lambda t: F.when(t > 0, of_share(t)))


def measured(docs: DataFrame, rules: Rules, carry: list[str]) -> DataFrame:
    """The columns of ``carry`` with the base counts and both histograms (``_classes``,
    ``_common``). Steps that use a value several times are projections of their own, so that
    each value is computed once.
    """
    text, words, windows = F.col("_text"), F.col("_words"), F.col("_windows")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    marks = F.regexp_replace(text, f"[^{WHITE}{SYMBOLS}{PUNCTUATION}{UPPER}{DIGITS}]+", "")
    distinct = F.size(F.array_distinct(windows))
    out = (
        docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
        .withColumns({"_words": F.array_remove(F.split(text, GAP), ""), "_lines": lines, "_marks": marks})
        .withColumns(
            {
                "_windows": windows_of(words),
                "_listed": word_counts(words, rules.listed),
                "_classes": class_counts(text, F.col("_marks")),
                "_n_dup": F.size("_lines") - F.size(F.array_distinct("_lines")),
            }
        )
        .withColumn("_n_twice", F.size("_windows") - distinct)
    )
    # most texts repeat no window; the places are sorted only where one does
    repeated = F.when(F.col("_n_twice") > 0, repeated_words(windows)).otherwise(0)
    others = F.size(words).cast("double") - _total(F.col("_listed"))
    return out.select(
        *carry,
        "lang",
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - F.col("_classes")[0]).cast("long").alias("word_chars"),
        F.col("_classes")[1].cast("long").alias("n_symbols"),
        F.col("_n_dup").cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        "_classes",
        F.concat("_listed", F.array(others)).alias("_common"),
    )


def references(rows: DataFrame, rules: Rules) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of each listed language over all its measured rows, as shares."""
    n_words = len(rules.listed) + 1
    sums = rows.where(F.col("lang").isin(list(rules.words))).groupBy("lang").agg(
        *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.col("_common")[i]).alias(f"w{i}") for i in range(n_words)],
    )
    found = {}
    for r in sums.collect():  # one row per listed language
        classes = [r[f"c{i}"] for i in range(len(CLASSES))]
        common = [r[f"w{i}"] for i in range(n_words)]
        if sum(classes) and sum(common):
            found[r["lang"]] = tuple([x / sum(h) for x in h] for h in (classes, common))
    return found


def judge(docs: DataFrame, rules: Rules | None = None, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with base counts, ``class_distance``, ``word_distance``, ``base_failed``, ``kept``.

    Texts are measured once; the counts and histograms are written with the columns to
    ``carry`` (all of ``docs`` unless named), and references and verdicts read those rows.
    """
    rules = rules or Rules()
    docs, names, columns = sealed(docs, ["text", "lang"], RESULTS)
    if carry is not None:
        names, columns = zip(*[(n, c) for n, c in zip(names, columns) if c in carry], strict=True)
    held = measured(docs, rules, [n for n in names if n != "lang"])
    out = Scratch(docs.sparkSession, "rules").write(held, "measured")
    known = references(out, rules)

    def nearest(column: str, which: int) -> Column:
        each = [distance(F.col(column), own[which]) for own in known.values()]
        if not each:
            return F.lit(None).cast("double")
        return each[0] if len(each) == 1 else F.least(*each)

    out = out.withColumns(
        {"class_distance": F.round(nearest("_classes", 0), 9), "word_distance": F.round(nearest("_common", 1), 9)}
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    strays = [
        (_total(F.col("_classes")) >= rules.class_guard) & (F.col("class_distance") > rules.max_class_distance),
        (F.col("n_words") >= rules.word_guard) & (F.col("word_distance") > rules.max_word_distance),
    ]
    stray = reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in strays])
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~stray)
    return out.select(*names, *RESULTS).toDF(*columns, *RESULTS)
