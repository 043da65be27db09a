"""Text functions: every one maps a Column to a Column and stays in the JVM.

The regular expressions use no look-around and no locale-dependent class, so
they mean the same in Spark (java.util.regex) and in an RE2 engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicweave.functions.wordlists import (
    EMOTICONS,
    PUNCTUATION,
    cleaning_stop_words,
    query_stop_words,
)

# Unicode white space.
WHITE_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+"

# Rules that split one white-space word, padded with a space on both sides, into
# words and marks: (pattern, replacement with $n groups), in order. Replacements
# write two spaces, so neighbouring matches never compete for one.
TOKEN_RULES: list[tuple[str, str]] = [
    # double quotes: opening after a space or bracket, closing elsewhere
    (r"([ (\[{<])(?:\"|'')", "$1 ``  "),
    (r"\"|''", "  ''  "),
    # marks that always stand alone
    (r"[;@#$%&?!()\[\]{}<>«“‘„»”’]|`+|\.\.+|--", "  $0  "),
    # colon and comma, unless a digit follows
    (r"([:,])([^0-9])", "  $1  $2"),
    # apostrophe before a single letter (but not 'd 'm 's 't)
    (r"'([0-9_a-ce-ln-ru-zA-CE-LN-RU-ZªµºÀ-ÖØ-öø-ÿ])([^\p{L}\p{N}_])", "'  $1$2"),
    # full stop at the end of a word, then a closing apostrophe
    (r"([^.])\.('*) ", "$1  .  $2 "),
    (r"([^'])' ", "$1  '  "),
    # English contractions
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1  $2  "),
    (r"(?i) (?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta)) ", " $1$3$5$7  $2$4$6$8 "),
    (r"(?i) (?:(d)('ye)|(more)('n)|('t)(is|was)) ", " $1$3$5  $2$4$6 "),
]
# Words without marks that a rule above still splits.
MERGED_WORDS = ["cannot", "gimme", "lemme", "gonna", "wanna", "gotta"]
PLAIN_WORD = r"^[\p{L}\p{N}_]*$"
# A word and one mark that the rules above always split off; the usual case.
WORD_AND_STOP = r"^[\p{L}\p{N}_]+[.,]$"

SHORT_LINK_PREFIX = "//t.co"

# Runs of two or more word characters (letters, numbers, underscore).
COUNTED_TOKEN = r"[\p{L}\p{N}_]{2,}"

# Emoji ranges.
EMOJI_RUN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
# Fixed value: an ellipsis decoded with the wrong character set.
MOJIBAKE_ELLIPSIS = "‚Ä¶"
NON_ASCII_RUN = r"[^\x{00}-\x{7F}]+"


def as_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _split_word(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    for pattern, replacement in TOKEN_RULES:
        padded = F.regexp_replace(padded, F.lit(pattern), F.lit(replacement))
    return F.split(F.trim(padded), " +")


def _words(text: Column) -> Column:
    return F.split(as_text(text), WHITE_SPACE)


def _tokens_of(words: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Every rule looks at one white-space word only, so plain words and words with
    a closing comma or full stop (nearly all) skip them.

    An abbreviation keeps its full stop, but for the last word of the text.
    """

    def parts(word: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - 1)
        return (
            F.when(
                word.rlike(PLAIN_WORD) & ~F.lower(word).isin(MERGED_WORDS),
                F.array(word),
            )
            .when(
                word.rlike(WORD_AND_STOP) & ~F.lower(stem).isin(MERGED_WORDS),
                F.array(stem, F.right(word, F.lit(1))),
            )
            .otherwise(_split_word(word))
        )

    if abbreviations:
        stopped = [f"{a}." for a in abbreviations]
        last = F.size(F.filter(words, lambda w: w != "")) - 1
        kept = F.transform(
            F.filter(words, lambda w: w != ""),
            lambda w, i: F.when(F.lower(w).isin(stopped) & (i < last), F.array(w)).otherwise(parts(w)),
        )
    else:
        kept = F.transform(words, parts)
    return F.filter(F.flatten(kept), lambda t: t != "")


def word_tokens(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Split a text into words and marks; links lose their scheme."""
    return _tokens_of(_words(text), abbreviations)


def is_emoticon(token: Column) -> Column:
    return token.isin(EMOTICONS)


def is_stop_word(token: Column) -> Column:
    return F.lower(token).isin(cleaning_stop_words())


def is_punctuation(token: Column) -> Column:
    return F.instr(F.lit(PUNCTUATION), token) > 0


def is_short_link(token: Column) -> Column:
    return token.startswith(SHORT_LINK_PREFIX)


def keep_token(token: Column) -> Column:
    return (
        ~is_stop_word(token)
        & ~is_emoticon(token)
        & ~is_punctuation(token)
        & ~is_short_link(token)
    )


def clean_text(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Tokenise, drop stop words, emoticons, punctuation and short links, rejoin.

    Stop words that no rule splits (close to half of a text) go before the rules.
    """
    whole = [w for w in cleaning_stop_words() if w.isalpha() and w not in MERGED_WORDS]
    words = F.filter(_words(text), lambda w: ~F.lower(w).isin(whole))
    return F.array_join(F.filter(_tokens_of(words, abbreviations), keep_token), " ")


def counted_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, in text order."""
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(COUNTED_TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """White-space words of a query; stop words go before lower-casing.

    Punctuation is not stripped, so ``madrid,`` stays one (unmatched) word.
    """
    words = F.split(F.trim(F.regexp_replace(as_text(query), F.lit(WHITE_SPACE), F.lit(" "))), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(query_stop_words()))
    return F.transform(kept, F.lower)


def delete_colons(text: Column) -> Column:
    return F.replace(text, F.lit(":"), F.lit(""))


def delete_mojibake(text: Column) -> Column:
    return F.replace(text, F.lit(MOJIBAKE_ELLIPSIS), F.lit(""))


def blank_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(NON_ASCII_RUN), F.lit(" "))


def delete_emoji(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(EMOJI_RUN), F.lit(""))
