"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and hashed n-gram come from Spark tasks and one aggregate; the matrix of
log-probabilities has ``languages x 65,536`` numbers whatever the input, and is broadcast. Texts
are scored in numpy, block by block, as sums of matrix rows picked by their n-gram hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOCK_CHARS,
    LETTERS,
    blocks,
    bounded_sample,
    doubles,
    map_arrow,
    pick,
    share,
    strings,
)

ORDERS = 3
BITS = 16
SMOOTHING = 0.5
#: Labelled documents the counts are taken from, at most (chosen by the hash of their id).
MAX_TRAINING = 20_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: languages x (2**BITS + 1); the last column is the empty n-gram with weight 0
    weights: np.ndarray
    priors: np.ndarray


def letters_only(text: str | None) -> str:
    """The text in lower case with one space for each run of anything but letters."""
    found = " ".join(LETTERS.findall(text.lower())) if text else ""
    return found if any(map(str.isalpha, found)) else ""


def pieces(text: str, limit: int = BLOCK_CHARS) -> list[str]:
    """Cuts of a padded text that overlap so that every n-gram lies in exactly one."""
    edge = " " * (ORDERS - 1)
    full = f"{edge}{text}{edge}"
    return [full[k : k + limit + ORDERS - 1] for k in range(0, len(full) - ORDERS + 1, limit)]


def hashed_ngrams(parts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per n-gram order the hash at each position of the joined parts; where each part starts."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    none = (ends[:, None] - np.arange(1, ORDERS)).ravel()
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        ahead = np.zeros(len(codes), np.uint32)
        ahead[: len(codes) - n] = codes[n:]
        h = h * np.uint32(0x01000193) + ahead + np.uint32(n + 1)
        index = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
        index[none] = 1 << BITS
        out.append(index)
    return out, starts


def _counts(lang: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = []
    for name in sorted(set(lang)):
        total = np.zeros((1 << BITS) + 1, np.int64)
        cleaned = [letters_only(t) for t in text[lang == name]]
        for a, b in blocks([len(c) for c in cleaned]):
            for cut in (p for c in cleaned[a:b] for p in pieces(c)):
                for index in hashed_ngrams([cut])[0]:
                    total += np.bincount(index, minlength=len(total))
        seen = np.flatnonzero(total[:-1])
        rows.append(pd.DataFrame({"lang": name, "bucket": seen, "n": total[seen]}))
    return pd.concat(rows) if rows else pd.DataFrame({"lang": [], "bucket": [], "n": []})


def fit(train: DataFrame, max_rows: int = MAX_TRAINING) -> LanguageModel:
    """Learn from the columns ``doc_id, text, lang``; rows without a language don't count.

    At most about ``max_rows`` rows, chosen by the hash of their id, are counted, each over its
    whole text. No row at all gives a model that answers ``und``.
    """
    rows = pick(train, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = bounded_sample(rows, "doc_id", max_rows)

    def count(batches):
        for batch in batches:
            yield _counts(batch["lang"], batch["text"])

    counted = rows.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(shares)
    if not languages:
        return LanguageModel([], np.zeros((0, (1 << BITS) + 1)), np.zeros(0))
    n = np.full((len(languages), 1 << BITS), SMOOTHING)
    place = table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    n[place, table["bucket"].to_numpy(np.int64)] += table["n"].to_numpy(np.float64)
    weights = np.zeros((len(languages), (1 << BITS) + 1))
    weights[:, :-1] = np.log(n) - np.log(n.sum(axis=1, keepdims=True))
    priors = np.array([shares[name] for name in languages], float)
    return LanguageModel(languages, weights, np.log(priors / priors.sum()))


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    cleaned = [letters_only(t) for t in texts]
    scores = np.tile(model.priors, (len(texts), 1))
    for a, b in blocks([len(c) for c in cleaned]):
        cuts = [(i, p) for i in range(a, b) for p in pieces(cleaned[i])]
        for k, m in blocks([len(p) for _, p in cuts]):
            owner = np.array([i for i, _ in cuts[k:m]])
            indexes, starts = hashed_ngrams([p for _, p in cuts[k:m]])
            for j, weight in enumerate(model.weights):
                found = sum(np.add.reduceat(weight[index], starts) for index in indexes)
                np.add.at(scores[:, j], owner, found)
    known = np.array([bool(c) for c in cleaned]) & bool(model.languages)
    names, out = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model.languages:
        best = scores.argmax(axis=1)
        shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
        top = 1 / shifted.sum(axis=1)
        for i in np.flatnonzero(known):
            names[i], out[i] = model.languages[best[i]], top[i]
    return names, out


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text alone.

    A null text or one without a letter is ``und`` with score 0. Equal sums go to the language
    that comes first by name. Repeated rows are repeated; an empty table gives an empty one.
    """
    shared = share(docs.sparkSession, model)

    def run(batch):
        names, score = predict_texts(batch.column(1).to_pylist(), shared())
        return [batch.column(0), strings(names), doubles(score)]

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double")
