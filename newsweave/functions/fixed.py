"""Fixed values.

Everything in this module is a literal that results depend on: the label
merge table, the stopword list, the tokeniser rule table, the noun suffix
rules, the special token ids and the stand-in fixture's category list.  They
are data, not logic; operators read them from here so that the Spark plans and
the DuckDB oracle SQL are generated from one source.
"""

from __future__ import annotations

# --- fixed values: category merge table (raw label -> merged label) -------
# 20 sources, 12 targets; exact match on lower-cased text, unmatched labels kept.
CATEGORY_MERGE = {
    "healthy living": "wellness",
    "queer voices": "groups voices",
    "worldpost": "world news",
    "science": "science & tech",
    "tech": "science & tech",
    "money": "business & finances",
    "arts": "arts & culture",
    "college": "education",
    "latino voices": "groups voices",
    "business": "business & finances",
    "parents": "parenting",
    "black voices": "groups voices",
    "the worldpost": "world news",
    "style": "style & beauty",
    "green": "environment",
    "taste": "food & drink",
    "culture & arts": "arts & culture",
    "good news": "miscellaneous",
    "weird news": "miscellaneous",
    "fifty": "miscellaneous",
}

# --- fixed values: English stopwords (179 words) ---------------------------
STOPWORDS_EN = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan "
    "shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# --- fixed values: word tokeniser rules -------------------------------------
# Penn-Treebank style rules, applied in this order to ' ' + sentence + ' '.
# Java replacement syntax ($n); the DuckDB oracle converts $n to \n.
TOKEN_RULES = [
    (r"([:,])([^\d])", r" $1 $2"),
    (r"([:,])$", r" $1 "),
    (r"\.\.\.", r" ... "),
    (r"[;@#$%&]", r" $0 "),
    (r'''([^\.])(\.)([\]\)}>"']*)\s*$''', r"$1 $2 $3 "),
    (r"[?!]", r" $0 "),
    (r"([^'])' ", r"$1 ' "),
    (r'["“”]', r" "),
    (r"[\[\]\(\)\{\}<>]", r" $0 "),
    (r"--", r" -- "),
    (r"([^' ])('s|'m|'d|') ", r"$1 $2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"$1 $2 "),
    (r"\b(can)(not)\b", r" $1 $2 "),
    (r"\b(d)('ye)\b", r" $1 $2 "),
    (r"\b(gim)(me)\b", r" $1 $2 "),
    (r"\b(gon)(na)\b", r" $1 $2 "),
    (r"\b(got)(ta)\b", r" $1 $2 "),
    (r"\b(lem)(me)\b", r" $1 $2 "),
    (r"\b(more)('n)\b", r" $1 $2 "),
    (r"\b(wan)(na)\b", r" $1 $2 "),
    (r" ('t)(is)\b", r" $1 $2 "),
    (r" ('t)(was)\b", r" $1 $2 "),
]
# Blank characters collapsed before tokenising (Unicode separators and NEL).
BLANKS = r"[\t\n\x0B\f\r \p{Z}\x{85}]+"
# Sentence end: ., ! or ? followed by a blank; dotted acronyms (u.s., e.g.)
# do not end a sentence.
SENTENCE_END = r"([.!?]) "
ACRONYM_AT_BREAK = r"(^|[ \n])((\p{L}\.){2,})\n"
# Characters removed from tokens (everything but letters, digits, _ and blanks).
# What surrounds a word's letters, but for dots behind it; a word as sentences
# are learned from it; a dotted acronym or a single initial.
WORD_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
PLAIN_WORD = r"^\p{L}+(\.\p{L}+)*$"
INITIALS = r"^(\p{L}\.)*\p{L}$"
# Published constants of unsupervised sentence splitting by likelihood ratios:
# how often an abbreviation has its dot, and the least scores of an
# abbreviation and of a sentence starter.
DOT_PROBABILITY = 0.99
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
NON_WORD = r"[^\p{L}\p{N}_\s]"
DIGITS = r"\p{Nd}+"
WORD = r"[\p{L}\p{N}_]+"

# --- fixed values: noun suffix rules (suffix, replacement) ------------------
NOUN_SUFFIX_RULES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# --- fixed values: sequence encoding special ids ----------------------------
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
MAX_LEN = 256
# The published pattern that splits a text before byte-level merges, with
# Unicode classes; the file of a public vocabulary on this machine.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# --- fixed values: split, batches, scoring ----------------------------------
SPLIT_SEED = 42
SPLIT_WEIGHTS = (14, 3, 3)    # train, validation, test: 30 % held out, then halved
TRAIN_BATCH = 8
EPOCHS = 4
WARMUP_FRACTION_PERCENT = 10
SCORE_BATCH = 1500
PROB_CLIP = 1e-7

# --- fixed values: stand-in fixture categories (FIXTURES.md) ----------------
# The 20 merge sources in table order, then the 12 targets alphabetically.
FIXTURE_CATEGORIES = list(CATEGORY_MERGE) + sorted(set(CATEGORY_MERGE.values()))

# --- fixed values: function words of the stand-in language predictor --------
# Used only to give the evaluation operators a SQL-checkable predictor over
# `documents`; ties go to the earlier language in this list.
LANGUAGE_WORDS = [
    ("en", "the of and to is that it was with this are".split()),
    ("fr", "le les et des du une pour est qui dans avec".split()),
    ("de", "der die und den von zu das mit sich auf nicht".split()),
    ("es", "el los las y del por con su una para se".split()),
]
