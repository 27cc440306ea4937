"""Tokeniser and token-array helpers as Column expressions.

The tokeniser is a fold of ``regexp_replace`` over the rules, run once over the
whole text: whole texts, JVM only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (ACRONYM_AT_BREAK, BLANKS, DIGITS, NON_WORD, SENTENCE_END,
                    STOPWORDS_EN, WORD)

# The rules of ``fixed.TOKEN_RULES`` as passes over the text: (pattern,
# replacement, what a text must hold for the pass to change it; None: always
# run).  A text without any of those strings skips the pass, which a plain
# search tells.  Patterns begin with a literal or a small class, so a place
# that cannot match is left at its first character; what stands before it is
# looked back at.  A comma or colon is never at a line's end, where a blank
# stands, so that rule has no pass.  The two rules for endings after an
# apostrophe stay apart, since the first makes blanks that the second looks for.
TOKEN_PASSES = [
    (r"([:,])(\D)", r" $1 $2", None),
    (r"[.;@#$%&?!](?:(?<!\.)|\.\.)", r" $0 ", None),
    (r'\.(?<=[^.]\.)([\]\)}>"\']*)\s*$', r" . $1 ", None),
    (r"'(?<=[^']') ", r" ' ", ("'",)),
    (r'["“”]', r" ", ('"', "“", "”")),
    (r"[\[\](){}<>-](?:(?<!-)|-)", r" $0 ", None),
    (r"'(?<=[^' ]')[smd]? ", r" $0", ("'",)),
    (r"[n'](?:(?<=[^' ]')(?:ll|re|ve)|(?<=[^' ]n)'t) ", r" $0", ("'",)),
    (r"\b(can)(not)\b", r" $1 $2 ", ("cannot",)),
    (r"\b(d)('ye)\b", r" $1 $2 ", ("d'ye",)),
    (r"\b(gim)(me)\b", r" $1 $2 ", ("gimme",)),
    (r"\b(lem)(me)\b", r" $1 $2 ", ("lemme",)),
    (r"\b(gon)(na)\b", r" $1 $2 ", ("gonna",)),
    (r"\b(wan)(na)\b", r" $1 $2 ", ("wanna",)),
    (r"\b(got)(ta)\b", r" $1 $2 ", ("gotta",)),
    (r"\b(more)('n)\b", r" $1 $2 ", ("more'n",)),
    (r" ('t)(is|was)\b", r" $1 $2 ", (" 'tis", " 'twas")),
]
# A run of blanks that is not one plain blank already; a dotted word before a break.
BLANK_RUNS = f"{BLANKS[:-1]}(?:(?<! ){BLANKS[:-1]}*|{BLANKS})"
ACRONYM_SEEN = r"\.\p{L}\.\n"


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK_RUNS, " "))


def _where(text: Column, seen: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The text, changed if ``seen`` holds; it is computed once (an array of one)."""
    return F.get(F.transform(F.array(text), lambda x: F.when(seen(x), change(x)).otherwise(x)), F.lit(0))


def _passes(text: Column) -> Column:
    for needed, run in groupby(((*p, None)[:3] for p in TOKEN_PASSES), key=lambda p: p[2]):
        rules = list(run)
        chain = lambda x: reduce(lambda acc, rule: F.regexp_replace(acc, "(?m)" + rule[0], rule[1]), rules, x)
        seen = lambda x: reduce(or_, [F.contains(x, F.lit(n)) for n in needed])
        text = chain(text) if needed is None else _where(text, seen, chain)
    return text


def tokenize(text: Column, marked: bool = False) -> Column:
    """Text -> word tokens (contractions and punctuation split off).

    With ``marked`` the text's sentences are known already: blanks are
    collapsed and a line break stands at each end (``sentences``).  Otherwise
    blanks are collapsed, sentences end after ., ! or ? + blank (not after
    dotted acronyms) and are padded with a blank on both sides; the rules then
    run once over the whole text in multi-line mode, so a rule anchored at
    ``$`` sees each sentence end.  No rule can match across the padded
    boundary, so this equals applying the rules sentence by sentence.  Lambdas
    run per text and pass, never per token.
    """
    x = text
    if not marked:
        x = F.regexp_replace(collapse_blanks(text), SENTENCE_END, "$1\n")
        x = _where(x, lambda t: F.rlike(t, F.lit(ACRONYM_SEEN)), lambda t: F.regexp_replace(t, ACRONYM_AT_BREAK, "$1$2 "))
    x = _passes(F.concat(F.lit(" "), F.replace(x, F.lit("\n"), F.lit(" \n ")), F.lit(" ")))
    return F.array_remove(F.split(F.replace(x, F.lit("\n"), F.lit(" ")), " "), "")


def remove_stopwords(tokens: Column, words: list[str] | None = None) -> Column:
    """Exact whole-token match, before punctuation is stripped.

    ``NOT IN`` over literals is planned as a hash-set lookup (InSet)."""
    words = STOPWORDS_EN if words is None else words
    return F.filter(tokens, lambda t: ~t.isin(words))


def strip_punctuation(tokens: Column) -> Column:
    """Remove everything but letters, digits, underscore and blanks.

    Tokens hold no blanks, so the stripping runs once on the blank-joined
    tokens and the result is split back; punctuation tokens stay as empty
    strings in place.  (An empty array comes back as [''], which the later
    empty-token filter removes.)
    """
    return F.split(F.regexp_replace(F.array_join(tokens, " "), NON_WORD, ""), " ")


def drop_empty(tokens: Column) -> Column:
    """T5 / F4."""
    return F.array_remove(tokens, "")


def strip_digits(tokens: Column) -> Column:
    """Digit runs removed after empties were dropped (so '10' -> '')."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, DIGITS, ""))


def join_tokens(tokens: Column) -> Column:
    """The empties of T6 give double blanks, as in the reference."""
    return F.array_join(tokens, " ")


def strip_digits_joined(tokens: Column) -> Column:
    """T6 + T7 in one string operation: join, then remove digit runs.

    Equal to stripping every token and joining, since no digit run spans
    the blank separator; an all-digit token leaves a double blank."""
    return F.regexp_replace(F.array_join(tokens, " "), DIGITS, "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscore."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def ngrams(words: Column, n: int) -> Column:
    """In-document n-grams joined by a blank (empty when fewer than n words).

    ``words`` must be a column of the frame, not an expression: it is read n
    times.  Shifted slices are zipped, so the work is linear in the words.
    """
    k = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), k)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out
