"""Small invented lexicons, and the fixed English stop-word list.

Real dictionaries are the user's own and are passed in as DataFrames of the same
shape. These stand-ins hold words that occur in the driver's generated prose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The Snowball English stop words.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing would should could
ought i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd
they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't
doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's
who's what's here's there's when's where's why's how's a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very
""".split()

# Ours, invented: easy words for the readability measures.
EASY_WORDS = """
the of and to a in is that it for was on with be by as this are at from he here there then other
""".split()

# Ours, invented: (dict, category, pattern, weight).
DICTIONARIES = [
    ("afinn", "positive", "rest", 2.0), ("afinn", "positive", "thing*", 1.0),
    ("afinn", "positive", "thin", 1.0), ("afinn", "negative", "stupid", -2.0),
    ("afinn", "negative", "pathetic", -2.0), ("afinn", "negative", "worth*", -1.0),
    ("geninq", "positive", "here", 1.0), ("geninq", "positive", "rein*", 1.0),
    ("geninq", "negative", "trash", -1.0), ("geninq", "negative", "edst*", -1.0),
    ("huliu", "positive", "then", 1.0), ("huliu", "negative", "loser*", -1.0),
    ("laver", "culture", "ones*", 1.0), ("laver", "economy", "ration*", 1.0),
    ("laver", "economy", "retion", 1.0),
    ("lm", "litigious", "anor", 1.0), ("lm", "uncertainty", "inan*", 1.0),
    ("lm", "uncertainty", "in_is", 1.0),
    ("lsd", "negative", "disgust*", -1.0), ("lsd", "negative", "not_the", -1.0),
    ("lsd", "positive", "of_the", 1.0), ("lsd", "positive", "heti*", 1.0),
    ("mfd", "fairness", "even*", 1.0), ("mfd", "fairness", "ered", 1.0),
    ("mfd", "harm", "moron*", 1.0), ("mfd", "harm", "idiot", 1.0),
    ("nrc", "trust", "than", 1.0), ("nrc", "fear", "thre*", 1.0),
    ("rid", "primary", "hea*", 1.0), ("rid", "primary", "heat", 1.0),
    ("rid", "secondary", "on_the_*", 1.0),
    ("sentiws", "negative", "scum", -1.0), ("sentiws", "positive", "ing*", 1.0),
    ("uk2us", "colour", "thou*", 1.0), ("uk2us", "colour", "ouble", 1.0),
]

# Ours, invented: (word, category) with the ten emotion categories.
EMOTION_CATEGORIES = [
    "anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust", "negative",
    "positive",
]
EMOTIONS = [
    ("idiot", "anger"), ("idiot", "disgust"), ("idiot", "negative"), ("stupid", "anger"),
    ("stupid", "negative"), ("then", "anticipation"), ("threen", "anticipation"),
    ("trash", "disgust"), ("trash", "negative"), ("threat", "fear"), ("thre", "fear"),
    ("rest", "joy"), ("rest", "positive"), ("thing", "positive"), ("loser", "sadness"),
    ("loser", "negative"), ("ouble", "surprise"), ("inan", "surprise"), ("here", "trust"),
    ("than", "trust"), ("heat", "positive"),
]

# Ours, invented: polar words and valence shifters.
POLARITY = [
    ("rest", 1.0), ("thing", 0.5), ("here", 0.75), ("heat", 0.25), ("then", 0.5), ("ones", 0.6),
    ("trash", -1.0), ("idiot", -1.0), ("stupid", -0.75), ("loser", -0.75), ("anor", -0.5),
    ("edst", -0.4), ("ered", -0.25), ("pathetic", -0.8), ("good", 0.75), ("happy", 0.75),
    ("bad", -0.75),
]
SHIFTERS = [
    ("not", "negator"), ("never", "negator"), ("anat", "negator"), ("inor", "negator"),
    ("very", "amplifier"), ("only", "amplifier"), ("ering", "amplifier"), ("the", "amplifier"),
    ("hardly", "deamplifier"), ("hest", "deamplifier"), ("erly", "deamplifier"),
]

# Ours, invented: (dict, category, pattern) of the ratio lists.
RATIO_LEXICON = [
    ("GI", "positive", "rest"), ("GI", "positive", "thing"), ("GI", "negative", "trash"),
    ("GI", "negative", "edst"), ("HE", "positive", "heat"), ("HE", "negative", "loser"),
    ("HE", "negative", "anor"), ("LM", "positive", "ones"), ("LM", "negative", "idiot"),
    ("LM", "negative", "ered"), ("LM", "uncertainty", "inan"), ("LM", "uncertainty", "thou"),
    ("QDAP", "positive", "retion"), ("QDAP", "positive", "hetion"), ("QDAP", "negative", "stupid"),
    ("QDAP", "negative", "onand"),
]

PROFANITY = ["idiot", "moron", "scum", "stupid", "trash", "clown", "loser"]
SPELLING = """
the of and to a in is that it for was on with be by as this are at from he here there then other
than thing rest heat ones only even what she has have not hat her him his its one two three day
trash idiot stupid loser clown scum moron worthless pathetic disgusting est que les des une pour par
dans sur avec qui der die das und nicht ein eine ist von mit den dem auf el la los las una por con
""".split()

# Ours, invented: (term, lemma).
LEMMAS = [("things", "thing"), ("thing", "thin"), ("was", "be"), ("are", "be"), ("is", "be"), ("heated", "heat")]

# Ours, invented: named terms of the wide document-term form.
WIDE_TERMS = ["the", "of", "and", "ing", "tion", "rest", "heat", "de", "la", "der", "und", "los"]


def values_sql(rows: list, columns: list[str]) -> str:
    """An inline table both Spark and the oracle can read."""

    def literal(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)

    flat = [r if isinstance(r, tuple) else (r,) for r in rows]
    body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in flat)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def table(spark: SparkSession, rows: list, columns: list[str]) -> DataFrame:
    """An inline table; Spark knows its exact size, so it never needs a hint."""
    flat = [r if isinstance(r, tuple) else (r,) for r in rows]

    def literal(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{x!r}D" if isinstance(x, float) else str(x)

    body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in flat)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
