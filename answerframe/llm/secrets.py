"""Secret scans: three published patterns, and character Markov models of random strings and identifiers.

Everything on the path from text to spans is a DataFrame expression. A text is split at a pattern's matches; the lengths
of pieces and matches give the spans in code points. Long unbroken runs of letters, digits and ``+/_-`` are scored by
``log P(random) - log P(identifier)`` per character under two first-order Markov models. The models are two tables of
128 x 128 character pairs, counted by one aggregate from labelled strings, so their size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, pick, text_or_empty

# The base patterns and the lengths that their matches must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: Equal to all matches of ``AKIA[A-Z0-9]+`` of 18 or more characters: runs are maximal, shorter ones fail anyway.
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Equal to all maximal runs of ``[0-9a-f]+`` of 16 or more characters.
HEX = r"[0-9a-f]{16,}"

#: Runs that the models judge; shorter ones say too little.
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Mean log-likelihood ratio per character pair (natural logarithm) from which a run counts as random.
THRESHOLD = 1.4
SMOOTHING = 0.5
#: Documents that random strings and ordinary identifiers are taken from, at most about.
MAX_DOCS, MAX_PLAIN = 20_000, 1_000
#: Words of an identifier that the ordinary model learns from.
NAME_WORDS = 3
CODES = 128

SPAN = "array<struct<at: int, to: int, kind: int, name: string>>"


@dataclass
class MarkovModels:
    """Log-likelihood ratio of random to ordinary for each pair of ASCII characters, ``CODES x CODES``."""

    ratio: np.ndarray

    def literal(self) -> Column:
        """The table as one constant array expression."""
        numbers = ",".join(f"{x:.6f}" for x in self.ratio.ravel())
        return F.split(F.lit(numbers), ",").cast("array<double>")


def spans(text: Column, pattern: str, kind: int, name: str, keep: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans in code points, end exclusive.

    ``keep`` is an array of booleans for the matches; a match with false is dropped.
    """
    parts = {"piece": F.split(text, pattern, -1), "found": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}
    if keep is not None:
        parts["keep"] = keep
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["piece"])
        to = at + F.length(x["found"])
        one = F.array(F.struct(at.alias("at"), to.alias("to"), F.lit(kind).alias("kind"), F.lit(name).alias("name")))
        wanted = x["found"].isNotNull() if keep is None else x["found"].isNotNull() & x["keep"]
        more = F.when(wanted, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(F.coalesce(to, at).alias("pos"), more.alias("out"))

    # both lists are arguments, not parts of the function, so a text is split and searched once
    return F.aggregate(F.arrays_zip(*[v.alias(k) for k, v in parts.items()]), start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> list[Column]:
    """Spans of the three kinds; texts without a pattern's fixed parts skip its scan."""
    lower = F.lower(text)
    words = ("passw", "secret", "token", "api")
    hint = F.lit(False)
    for w in words:
        hint = hint | lower.contains(w)
    none = F.array().cast(SPAN)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(values, lambda v: F.length(v) >= ASSIGN_VALUE)
    return [
        F.when(hint, spans(text, ASSIGN, 0, "assign", long_enough)).otherwise(none),
        F.when(text.contains("AKIA"), spans(text, ACCESS, 1, "access")).otherwise(none),
        F.when(text.rlike(HEX), spans(text, HEX, 2, "hex")).otherwise(none),
    ]


def runs_of(text: Column) -> Column:
    return F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def labelled_strings(docs: DataFrame, max_docs: int = MAX_DOCS, max_plain: int = MAX_PLAIN) -> DataFrame:
    """``value, random`` from documents: values the base patterns call secret, against ordinary identifiers.

    Random strings are the assigned values, access keys and hexadecimal runs of about ``max_docs`` documents.
    Ordinary identifiers are the words of about ``max_plain`` documents in which no pattern matches, joined in the ways
    programs join them. Documents are chosen by the hash of their id.
    """
    rows = pick(docs, "doc_id", "text").where("text IS NOT NULL")
    text = F.col("text")
    values = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE)
    secret = F.concat(
        values,
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    random = bounded_sample(rows, "doc_id", max_docs).select(F.explode(secret).alias("value"), F.lit(True).alias("random"))
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9]+"), F.lit(0))
    lower = F.transform(F.slice("words", F.col("at"), F.lit(NAME_WORDS)), F.lower)
    joined = F.array(
        F.array_join(lower, "_"),
        F.array_join(lower, "-"),
        F.array_join(lower, "/"),
        F.array_join(F.transform(lower, F.initcap), ""),
        F.upper(F.array_join(lower, "_")),
    )
    plain = bounded_sample(rows, "doc_id", max_plain).where(F.size(secret) == 0).select(words.alias("words"))
    starts = F.explode(F.sequence(F.lit(1), F.size("words"), F.lit(NAME_WORDS))).alias("at")
    names = plain.where(F.size("words") > 0).select("words", starts).select(F.explode(joined).alias("value"))
    return random.unionByName(names.withColumn("random", F.lit(False)))


def fit(strings: DataFrame) -> MarkovModels:
    """Both models from labelled strings (``value``, ``random``).

    Hexadecimal and access-key alphabets are smoothed towards an even spread over letters and digits, so a random
    string of another alphabet is still likelier under the first model. Characters outside ASCII are left out.
    """
    counted = (
        strings.where(F.length("value") > 1)
        .select("random", F.explode(pairs(F.col("value"))).alias("pair"))
        .where((F.col("pair") >= 0) & (F.col("pair") < CODES * CODES))
        .groupBy("random", "pair")
        .count()
    )
    counts = np.zeros((2, CODES, CODES))
    for r in counted.collect():  # at most 2 x CODES x CODES rows
        counts[int(r["random"]), r["pair"] // CODES, r["pair"] % CODES] = r["count"]
    alphabet = np.zeros(CODES, bool)
    alphabet[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
    even = alphabet / alphabet.sum()
    seen = counts[1].sum(axis=1, keepdims=True)
    random = 0.5 * even[None, :] + 0.5 * (counts[1] + even) / (seen + 1)
    ordinary = counts[0] + SMOOTHING
    ordinary /= ordinary.sum(axis=1, keepdims=True)
    both = alphabet[:, None] & alphabet[None, :]
    return MarkovModels(np.where(both, np.log(np.where(both, random, 1)) - np.log(np.where(both, ordinary, 1)), 0.0))


def pairs(value: Column) -> Column:
    """Numbers of the pairs of neighbouring characters."""
    codes = F.transform(F.split(value, ""), F.ascii)
    return F.zip_with(
        F.slice(codes, F.lit(1), F.length(value) - 1), F.slice(codes, F.lit(2), F.length(value) - 1), lambda a, b: a * CODES + b
    )


def mean_ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per pair of neighbouring characters of an ASCII string."""
    total = F.aggregate(pairs(value), F.lit(0.0), lambda acc, pair: acc + F.element_at(table, pair + 1))
    return total / (F.length(value) - 1)


def scan(docs: DataFrame, models: MarkovModels, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text, base, added`` of each row: spans by pattern, and runs that only the models find.

    A span is ``(at, to, kind, name)`` in code points, end exclusive. A null text counts as empty. Added spans
    (kind 3, ``markov``) never overlap a base span. Repeated rows are repeated.
    """
    text = F.col("text")
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    assign, access, hexa = base_spans(text)
    found = rows.select("doc_id", "text", assign.alias("assign"), access.alias("access"), hexa.alias("hex"))
    base = F.array_sort(
        F.concat("assign", "access", "hex"),
        lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["kind"] - b["kind"]),
    )
    table = models.literal()
    random = F.transform(runs_of(text), lambda v: mean_ratio(v, table) >= threshold)
    markov = F.when(text.rlike(RUN), spans(text, RUN, 3, "markov", random)).otherwise(F.array().cast(SPAN))
    both = found.select(
        "doc_id",
        "text",
        F.size("assign").alias("n_assign"),
        F.size("access").alias("n_access"),
        F.size("hex").alias("n_hex"),
        base.alias("base"),
        markov.alias("markov"),
    )
    apart = F.filter(
        "markov", lambda m: ~F.exists("base", lambda b: (b["at"] < m["to"]) & (m["at"] < b["to"]))
    )
    return both.withColumn("added", apart).drop("markov")


def written(found: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["name"], s["at"].cast("string"), s["to"].cast("string"))), ","
    )


def all_spans(base: str = "base", added: str = "added") -> Column:
    return F.array_sort(
        F.concat(base, added),
        lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["kind"] - b["kind"]),
    )
