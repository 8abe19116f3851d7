"""One object with a method per feature family of a single text column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import readability as rd
from ..functions.text import apply_chain, strip_digits, strip_symbols
from ..functions.tokens import ngrams, terms2, without, words
from ..operators import diversity as dv
from ..operators import sentiment as sn
from ..operators import terms as tm
from ..operators import topics as tp
from ..operators import vectors as vc


class FeatureExtraction:
    """``params`` holds one dict per family; missing families use the defaults.

    Every method returns a DataFrame keyed by ``id_col``.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, params: Mapping[str, Mapping] = {}):
        self.df, self.id_col, self.text_col = df, id_col, text_col
        self.params = {k: dict(v) for k, v in params.items()}

    def _of(self, family: str) -> dict:
        return self.params.get(family, {})

    def bag_of_word(self) -> DataFrame:
        """TF-IDF of word n-grams, every text ranked by weight (``top`` limits the rank)."""
        opt = self._of("bag_of_word")
        low, high = opt.get("ngram_range", (1, 2))
        tokens = terms2(self.text_col)
        if opt.get("stop_words"):
            tokens = without(tokens, list(opt["stop_words"]))
        cells = tm.term_counts(self.df, [self.id_col], ngrams(tokens, low, high, " "))
        weights = tm.tfidf_smooth_l2(cells, self.df, self.id_col)
        return tm.top_terms(weights, self.id_col, "tfidf", opt["top"]) if "top" in opt else weights

    def dtm(self) -> DataFrame:
        """Stemmed counts after dropping symbols and digits."""
        steps = self._of("dtm").get("steps", [strip_symbols, strip_digits, F.lower])
        plain = apply_chain(self.text_col, steps)
        tokens = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
        return tm.stem_counts(self.df, [self.id_col], tokens)

    def doc2vec(self) -> DataFrame:
        return vc.word_vectors(self.df, self.id_col, words(self.text_col), **self._of("doc2vec"))

    def sentiment_analysis(self) -> DataFrame:
        opt = self._of("sentiment_analysis")
        return sn.shifter_sentiment(
            self.df, self.id_col, [self.text_col], opt["polarity"], opt["shifters"], ["sentiment"]
        )

    def lexical_diversity(self) -> DataFrame:
        return dv.lexical_diversity(self.df, self.id_col, self.text_col)

    def readability(self) -> DataFrame:
        opt = self._of("readability")
        return rd.readability(
            self.df,
            self.id_col,
            self.text_col,
            opt.get("easy_words", ()),
            opt.get("measures", rd.SCORE_MEASURES),
            counts=True,
        )

    def topic_modeling(self) -> DataFrame:
        opt = self._of("topic_modeling")
        texts = self.df.select(self.id_col, F.lit("all_text").alias("field"), F.coalesce(self.text_col, F.lit("")).alias("text"))
        ks = {"all_text": [opt.get("k", tp.TOPICS["all_text"])]}
        rest = {"iterations": opt.get("iterations", 20), "min_docfreq": opt.get("min_docfreq", 2)}
        return tp.fit_topics(texts, self.id_col, words("text"), ks, **rest).columns()

    def embed(self, encoder: Callable[[pd.Series], np.ndarray]) -> DataFrame:
        """Vectors of any encoder that maps a batch of texts to one row each."""
        return vc.encode_texts(self.df, [self.id_col], [self.text_col], encoder)
