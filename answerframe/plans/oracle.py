"""The same results in ANSI-style SQL for an independent engine."""

from __future__ import annotations

from ..functions import readability as rd
from ..functions import stem as st
from ..functions.text import ANSWERS
from ..operators.topics import CHOICES, TOPICS
from . import wordlists as wl
from .tuning_run import ALPHAS, L1_RATIOS
from .stand_ins import DEV_SOURCES, TEST_SOURCES

ORACLE: dict[str, str] = {}

WORD = r"'\p{L}+(?:''\p{L}+)?'"
GENERAL = r"'https?://\S+|[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]'"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {WORD})"


def word_list(items) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + ")"


def values(rows, columns) -> str:
    return wl.values_sql(rows, columns)


CELLS = f"""cells AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents)
  GROUP BY doc_id, term)"""

VOCAB = """vocab AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS term_count, count(*) AS doc_count FROM cells GROUP BY term)"""

ANSWERS_CTE = "answers AS (SELECT conv_id * 100000 + turn // 5 AS respondent_id, " + ", ".join(
    f"max(CASE WHEN turn % 5 = {i} THEN text END) AS {c}" for i, c in enumerate(ANSWERS)
) + " FROM conversations GROUP BY conv_id * 100000 + turn // 5)"


def ngrams(source: str, keys: str, n_max: int, sep: str = "_", n_min: int = 1) -> str:
    """``grams(keys, term)`` rows from ``source(keys, w)``."""
    parts = [
        f"SELECT {keys}, array_to_string(w[i:i+{n - 1}], '{sep}') AS term FROM "
        f"(SELECT {keys}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {source}) AS s{n}"
        for n in range(n_min, n_max + 1)
    ]
    return "grams AS (" + " UNION ALL ".join(parts) + ")"


TOKENS = f"tok AS (SELECT doc_id, {words('text')} AS w FROM documents)"
GRAM_CELLS = "cells AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY doc_id, term)"

ORACLE["concat_answers_skip_null"] = (
    f"WITH {ANSWERS_CTE} SELECT respondent_id, concat_ws(' ', {', '.join(ANSWERS)}) AS all_text FROM answers"
)
ORACLE["concat_answers_propagate"] = (
    f"WITH {ANSWERS_CTE} SELECT respondent_id, {' || chr(32) || '.join(ANSWERS)} AS full_text FROM answers"
)
ORACLE["unpivot_answers"] = f"WITH {ANSWERS_CTE} " + " UNION ALL ".join(
    f"SELECT respondent_id, '{c}' AS field, {c} AS text FROM answers WHERE {c} IS NOT NULL"
    for c in ANSWERS
)
ORACLE["clean_text"] = """
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), ' +', ' ', 'g'))
  AS clean_text FROM documents"""
ORACLE["strip_symbols_digits"] = r"""
SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\p{Nd}', '', 'g'))
  AS stripped FROM documents"""
ORACLE["corpus_token_filter"] = rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {GENERAL}),
  lambda x: NOT regexp_matches(x, '^\p{{P}}$|^\p{{S}}$|^\p{{N}}+$')) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM t"""
ORACLE["token_counts"] = f"""
WITH {TOKENS}
SELECT d.doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(w) AS INTEGER) AS n_tokens,
  round(length(text)::DOUBLE / nullif(len(w), 0) + 1e-9, 6) AS char_per_word
FROM documents d JOIN tok USING (doc_id)"""

_cpw = [
    f"round(length({c})::DOUBLE / nullif(len({words(c)}), 0) + 1e-9, 6) AS char_per_word{i}"
    for i, c in enumerate(ANSWERS, 1)
]
_chars = " + ".join(f"coalesce(length({c}), 0)" for c in ANSWERS)
_words = " + ".join(f"coalesce(len({words(c)}), 0)" for c in ANSWERS)
ORACLE["char_per_word"] = f"""
WITH {ANSWERS_CTE} SELECT respondent_id, {', '.join(_cpw)},
  round(({_chars})::DOUBLE / nullif({_words}, 0) + 1e-9, 6) AS char_per_word_all_text FROM answers"""
ORACLE["word_counts"] = f"WITH {CELLS} SELECT doc_id, term, n FROM cells"
ORACLE["ngram_counts_1_5"] = f"""
WITH {TOKENS}, {ngrams('tok', 'doc_id', 5)}, {GRAM_CELLS}
SELECT doc_id, CAST(length(term) - length(replace(term, '_', '')) + 1 AS INTEGER) AS ngram_order,
  count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_total, max(n) AS n_max
FROM cells GROUP BY 1, 2"""
ORACLE["ngram_docfreq_trim"] = f"""
WITH {TOKENS}, {ngrams('tok', 'doc_id', 5)}, {GRAM_CELLS}, {VOCAB} SELECT * FROM vocab WHERE doc_count >= 2"""
ORACLE["docfreq_trim"] = f"WITH {CELLS}, {VOCAB} SELECT * FROM vocab WHERE doc_count >= 2"
_PRUNED = """pruned AS (SELECT *, doc_count::DOUBLE / (SELECT count(*) FROM documents) AS doc_share
  FROM vocab WHERE term_count >= 25 AND doc_count::DOUBLE / (SELECT count(*) FROM documents) <= 0.9)"""
ORACLE["vocab_prune"] = f"""
WITH {CELLS}, {VOCAB}, {_PRUNED}
SELECT term, term_count, doc_count, round(doc_share + 1e-9, 6) AS doc_share FROM pruned"""
ORACLE["stopword_filter"] = (
    f"WITH {CELLS} SELECT doc_id, term, n FROM cells WHERE term NOT IN {word_list(wl.STOPWORDS)}"
)
ORACLE["keep_pruned_terms"] = f"""
WITH {CELLS}, {VOCAB}, {_PRUNED}
SELECT doc_id, term, n FROM cells WHERE term IN (SELECT term FROM pruned)"""
ORACLE["dtm_sparse"] = f"""
WITH {CELLS}, {VOCAB}, {_PRUNED}
SELECT doc_id, term, n::DOUBLE AS value FROM cells JOIN pruned USING (term)"""
_RANKED = ",\n  ".join(
    f"CASE WHEN (SELECT count(*) FROM top) >= {r} THEN CAST(coalesce(max(c.n) FILTER (WHERE t.rank = {r}), 0) AS BIGINT) END AS all_{r}"
    for r in range(1, 51)
)
ORACLE["dtm_wide"] = f"""
WITH {CELLS}, {VOCAB}, {_PRUNED},
top AS (SELECT term, row_number() OVER (ORDER BY doc_count DESC, term) AS rank FROM pruned QUALIFY rank <= 50)
SELECT d.doc_id, {_RANKED}
FROM documents d LEFT JOIN cells c ON c.doc_id = d.doc_id LEFT JOIN top t ON t.term = c.term GROUP BY d.doc_id"""
ORACLE["tfidf_log10"] = f"""
WITH {CELLS}, {VOCAB}
SELECT doc_id, term, n, round(n * log10((SELECT count(*) FROM documents)::DOUBLE / doc_count) + 1e-9, 6) AS weight
FROM cells JOIN vocab USING (term)"""
_SMOOTH = """weighted AS (
  SELECT doc_id, term, n, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + doc_count)) + 1) AS raw
  FROM cells JOIN vocab USING (term)),
scaled AS (SELECT doc_id, term, n,
  round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) + 1e-9, 6) AS tfidf FROM weighted)"""
_TERM2 = r"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)"
ORACLE["tfidf_smooth_l2"] = f"""
WITH {_TERM2}, grams AS (SELECT doc_id, unnest(w) AS term FROM tok), {GRAM_CELLS}, {VOCAB}, {_SMOOTH}
SELECT doc_id, term, n, tfidf FROM scaled"""
ORACLE["top_terms"] = f"""
WITH {_TERM2}, {ngrams('tok', 'doc_id', 2, ' ')}, {GRAM_CELLS}, {VOCAB}, {_SMOOTH},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS INTEGER) AS rank
  FROM scaled)
SELECT doc_id, term, n, tfidf, rank FROM ranked WHERE rank <= 10"""


def nzv_ctes(keys: str, docs: str, weighted: bool) -> str:
    """``nzv(keys, doc_count, freq_ratio, percent_unique, nzv)`` from ``cells``."""
    match = " AND ".join(f"h.{k.strip()} = z.{k.strip()}" for k in keys.split(","))
    single = "distinct_values = 1" + (" OR doc_count = total" if weighted else "")
    return f"""
hist AS (SELECT {keys}, n, count(*) AS held FROM cells GROUP BY {keys}, n),
sizes AS (SELECT {keys}, CAST(sum(held) AS BIGINT) AS doc_count, (SELECT count(*) FROM {docs}) AS total
  FROM hist GROUP BY {keys}),
column_values AS (SELECT {keys}, n, held FROM hist UNION ALL
  SELECT {keys}, 0 AS n, total - doc_count AS held FROM sizes WHERE total > doc_count),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY held DESC, n) AS rank FROM column_values),
shape AS (SELECT {keys}, count(*) AS distinct_values, max(held) FILTER (rank = 1) AS top,
  max(held) FILTER (rank = 2) AS next FROM ranked GROUP BY {keys}),
nzv AS (SELECT {', '.join('h.' + k.strip() for k in keys.split(','))}, doc_count,
  top::DOUBLE / next AS freq_ratio, 100.0::DOUBLE * distinct_values / total AS percent_unique,
  ({single}) OR coalesce(top::DOUBLE / next > 19 AND 100.0::DOUBLE * distinct_values / total <= 10, false) AS nzv
  FROM shape h JOIN sizes z ON {match})"""


ORACLE["nzv_terms"] = f"""
WITH {CELLS}, {nzv_ctes('term', 'documents', False)}
SELECT term, doc_count, round(freq_ratio + 1e-9, 6) AS freq_ratio, round(percent_unique + 1e-9, 6) AS percent_unique, nzv
FROM nzv"""

_easy = word_list(wl.EASY_WORDS)
_tiles = " + ".join(
    f"{v} * len(regexp_extract_all(joined, '[{g}]'))" for v, g in rd.TILE_VALUES.items()
)
COUNTS = rf"""
base AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
syl AS (SELECT *, array_to_string(w, '') AS joined,
  list_transform(w, lambda t: greatest(1, len(regexp_extract_all(t, '[aeiouy]+')))) AS s,
  list_filter(w, lambda t: t NOT IN {_easy}) AS hard,
  array_to_string((regexp_extract_all(text, '\S+'))[1:100], ' ') AS sample FROM base),
m AS (SELECT doc_id, len(w)::DOUBLE AS W, len(replace(joined, '''', ''))::DOUBLE AS C,
  greatest(1, len(regexp_extract_all(text, '[.!?]+')))::DOUBLE AS St, length(text)::DOUBLE AS Nc,
  coalesce(list_sum(s), 0)::DOUBLE AS Sy,
  len(list_filter(s, lambda x: x >= 2))::DOUBLE AS W2, len(list_filter(s, lambda x: x >= 3))::DOUBLE AS W3,
  len(hard)::DOUBLE AS D,
  len(list_filter(hard, lambda t: len(regexp_extract_all(t, '[aeiouy]+')) >= 2))::DOUBLE AS Dd,
  ({_tiles})::DOUBLE AS tile_score, len(regexp_extract_all(joined, '[a-z]'))::DOUBLE AS letters,
  coalesce(list_sum(list_transform({words('sample')}, lambda t:
    CASE WHEN len(regexp_extract_all(t, '[aeiouy]+')) < 3 THEN 1 ELSE 3 END)), 0)::DOUBLE
    / greatest(1, len(regexp_extract_all(sample, '[.!?]+'))) AS linsear
  FROM syl),
f AS (SELECT *, nullif(W, 0) AS N, CASE WHEN W > 0 THEN W / St END AS asl FROM m)"""

FORMULAS = {
    "Flesch_Kincaid": "0.39 * asl + 11.8 * (Sy / N) - 15.59",
    "Dale_Chall_old": "15.79 * (D / N) + 0.0496 * asl + CASE WHEN D / N > 0.05 THEN 3.6365 ELSE 0 END",
    "Wheeler_Smith": "asl * 10 * (W2 / N)",
    "meanSentenceLength": "asl",
    "meanWordSyllables": "Sy / N",
    "Strain": "CASE WHEN W > 0 THEN Sy * 3 / St / 10 END",
    "SMOG": "CASE WHEN W > 0 THEN 1.043 * sqrt(30 * (W3 / St)) + 3.1291 END",
    "Scrabble": "tile_score / nullif(letters, 0)",
    "FOG": "0.4 * (asl + 100 * (W3 / N))",
    "Farr_Jenkins_Paterson": "-31.517 - 1.015 * asl + 1.599 * 100 * ((W - W2) / N)",
    "DRP": (
        "100 * (1 - (0.886593 - 0.08364 * (C / N) + 0.161911 * power((W - D) / N, 3) - 0.021401 * asl"
        " + 0.000577 * asl * asl - 0.000005 * asl * asl * asl))"
    ),
    "Dale_Chall": "64 - 95 * (D / N) - 0.69 * asl",
}
SCORES = {
    "avg_syllables_per_word": "round(Sy / N + 1e-9, 2)",
    "avg_sentence_length": "round(asl + 1e-9, 2)",
    "flesch_ease_score": "206.835 - 1.015 * asl - 84.6 * (Sy / N)",
    "flesch_grade_score": FORMULAS["Flesch_Kincaid"],
    "linsear_write_score": (
        "CASE WHEN W > 0 THEN CASE WHEN linsear > 20 THEN linsear / 2 ELSE (linsear - 2) / 2 END END"
    ),
    "dale_chall_score": FORMULAS["Dale_Chall_old"],
    "gunning_fog_score": FORMULAS["FOG"],
    "smog_score": "CASE WHEN W > 0 THEN CASE WHEN St >= 3 THEN 1.043 * sqrt(30 * (W3 / St)) + 3.1291 ELSE 0 END END",
    "automated_readability_score": "4.71 * (Nc / N) + 0.5 * asl - 21.43",
    "coleman_liau_score": "0.058 * 100 * (C / N) - 0.296 * 100 * (St / N) - 15.8",
}


def measured(formulas: dict[str, str]) -> str:
    # the nudge settles exact decimal ties the same way on both sides
    return ", ".join(
        f"round(CAST({sql} AS DOUBLE) + 1e-9, 6) + 0.0 AS {name}" for name, sql in formulas.items()
    )


ORACLE["readability_counts"] = f"""
WITH {COUNTS} SELECT doc_id, CAST(Sy AS INTEGER) AS syllables_count, CAST(W AS INTEGER) AS word_count,
  CAST(Dd AS INTEGER) AS difficult_count, CAST(St AS INTEGER) AS sentence_count FROM f"""
ORACLE["readability_corpus"] = f"WITH {COUNTS} SELECT doc_id, {measured(FORMULAS)} FROM f"
ORACLE["readability_scores"] = f"WITH {COUNTS} SELECT doc_id, {measured(SCORES)} FROM f"

_by_answer = []
for _i, _c in enumerate(ANSWERS, 1):
    _n = f"nullif(len({words(_c)}), 0)"
    _letters = f"length(replace(array_to_string({words(_c)}, ''), '''', ''))"
    _st = f"greatest(1, len(regexp_extract_all({_c}, '[.!?]+')))"
    _nb = f"nullif(length({_c}) - length(replace({_c}, ' ', '')), 0)"
    _by_answer += [
        f"CASE WHEN {_c} IS NOT NULL THEN round(5.88::DOUBLE * ({_letters}::DOUBLE / {_n}) - 29.6::DOUBLE * ({_st}::DOUBLE / {_n})"
        f" - 15.8 + 1e-9, 6) END AS readability_CL{_i}",
        f"CASE WHEN {_c} IS NOT NULL THEN round(1.0364::DOUBLE * (length({_c})::DOUBLE / {_nb}) + 0.0194::DOUBLE"
        f" * (length({_c})::DOUBLE / {_st}) - 0.6059 + 1e-9, 6) END AS readability_DB1_{_i}",
        f"CASE WHEN {_c} IS NOT NULL THEN round(131.059 - 10.364::DOUBLE * (length({_c})::DOUBLE / {_nb})"
        f" - 0.0194::DOUBLE * (length({_c})::DOUBLE / {_st}) + 1e-9, 6) END AS readability_DB{_i}",
    ]
ORACLE["readability_by_answer"] = (
    f"WITH {ANSWERS_CTE} SELECT respondent_id, {', '.join(_by_answer)} FROM answers"
)

_LEXDIV = """
CASE WHEN N > 1 AND N <> 1 THEN round(ln(V) / nullif(ln(N), 0) + 1e-9, 6) + 0.0 END AS "lex_div_C",
CASE WHEN N > 1 THEN round(V / sqrt(N) + 1e-9, 6) + 0.0 END AS "lex_div_R",
CASE WHEN N > 1 THEN round(pairs / nullif(N * (N - 1), 0) + 1e-9, 6) + 0.0 END AS "lex_div_D" """
ORACLE["lexdiv_counts"] = f"""
WITH {CELLS}, s AS (SELECT doc_id, count(*)::DOUBLE AS V, sum(n)::DOUBLE AS N, sum(n * (n - 1))::DOUBLE AS pairs
  FROM cells GROUP BY doc_id)
SELECT doc_id, {_LEXDIV} FROM documents LEFT JOIN s USING (doc_id)"""
_answer_tok = " UNION ALL ".join(
    rf"""SELECT respondent_id, '{c}' AS field, list_filter(regexp_extract_all(lower(coalesce({c}, '')), {GENERAL}),
  lambda x: NOT regexp_matches(x, '^\p{{P}}$|^\p{{S}}$|^\p{{N}}+$')) AS w FROM answers"""
    for c in ANSWERS
)
ORACLE["lexdiv_weighted"] = f"""
WITH {ANSWERS_CTE}, tok AS ({_answer_tok}), {ngrams('tok', 'respondent_id, field', 5)},
cells AS (SELECT respondent_id, field, term, count(*) AS n FROM grams GROUP BY ALL),
{nzv_ctes('field, term', 'answers', True)},
w AS (SELECT respondent_id, n * log10((SELECT count(*) FROM answers)::DOUBLE / doc_count) AS weight
  FROM cells JOIN nzv USING (field, term) WHERE NOT nzv),
s AS (SELECT respondent_id, count(*) FILTER (weight <> 0)::DOUBLE AS V, sum(weight) AS N,
  sum(weight * (weight - 1)) AS pairs FROM w GROUP BY respondent_id)
SELECT respondent_id, {_LEXDIV} FROM answers LEFT JOIN s USING (respondent_id)"""

_marks = {
    "Period": "[.]", "Comma": "[,]", "Colon": "[:]", "SemiC": "[;]", "QMark": "[?]", "Exclam": "[!]",
    "Dash": "[-–—]", "Quote": "[\"“”]", "Apostro": "[''’]", "Parenth": "[()]",
}


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


_profile = ", ".join(
    f"round(100.0::DOUBLE * {_count(p)} / N + 1e-9, 6) AS \"{name}\"" for name, p in _marks.items()
)
_other = " - ".join(["len(regexp_extract_all(text, '\\p{P}'))"] + [_count(p) for p in _marks.values()])
PROFILE_SQL = rf"""CAST(W AS INTEGER) AS "WC",
  CASE WHEN W > 0 THEN round(W::DOUBLE / greatest(1, len(regexp_extract_all(text, '[.!?]+'))) + 1e-9, 6) END AS "WPS",
  round(100.0::DOUBLE * len(list_filter(w, lambda t: length(t) > 6)) / N + 1e-9, 6) AS "Sixltr",
  round(100.0::DOUBLE * len(regexp_extract_all(text, '\p{{P}}')) / N + 1e-9, 6) AS "AllPunc", {_profile},
  round(100.0::DOUBLE * ({_other}) / N + 1e-9, 6) + 0.0 AS "OtherP" """
_BASE = f"""base AS (SELECT doc_id, text, {words('text')} AS w FROM documents),
sized AS (SELECT doc_id, text, w, len(w) AS n_words, nullif(len(w), 0) AS denom FROM base)"""
_profile_sql = PROFILE_SQL.replace("CAST(W AS", "CAST(n_words AS").replace("W > 0", "n_words > 0")
_profile_sql = _profile_sql.replace("W::DOUBLE", "n_words::DOUBLE").replace("/ N +", "/ denom +")
ORACLE["liwc_profile"] = f"WITH {_BASE} SELECT doc_id, {_profile_sql} FROM sized"

_LEX = f"lex AS (SELECT * FROM {values(wl.DICTIONARIES, ['dict', 'category', 'pattern', 'weight'])})"
_MATCH = """hits AS (
  SELECT DISTINCT v.term, l.dict, l.category FROM (SELECT DISTINCT term FROM cells) v JOIN lex l
  ON v.term = l.pattern OR (l.pattern LIKE '%*' AND starts_with(v.term, rtrim(l.pattern, '*'))
    AND NOT contains(substr(v.term, length(l.pattern)), '_')))"""
_cats = list(dict.fromkeys((d, c) for d, c, _, _ in wl.DICTIONARIES))
_MAX = max(p.count("_") + 1 for _, _, p, _ in wl.DICTIONARIES)
_first = _cats[0][0]
_dict_cols = ", ".join(
    f"round(100.0::DOUBLE * coalesce(c.{d}_{k}, 0) / denom + 1e-9, 6) AS {d}_{k}" for d, k in _cats
)
_dict_sums = ", ".join(
    f"sum(n) FILTER (dict = '{d}' AND category = '{k}') AS {d}_{k}" for d, k in _cats
)
ORACLE["dictionary_profile"] = f"""
WITH {_LEX}, {_BASE}, tok AS (SELECT doc_id, w FROM base), {ngrams('tok', 'doc_id', _MAX)}, {GRAM_CELLS}, {_MATCH},
c AS (SELECT doc_id, {_dict_sums} FROM cells JOIN hits USING (term) GROUP BY doc_id),
anyhit AS (SELECT doc_id, sum(n) AS dic FROM cells
  WHERE term IN (SELECT term FROM hits WHERE dict = '{_first}') GROUP BY doc_id)
SELECT doc_id, {_profile_sql}, round(100.0::DOUBLE * coalesce(dic, 0) / denom + 1e-9, 6) AS "Dic", {_dict_cols}
FROM sized LEFT JOIN c USING (doc_id) LEFT JOIN anyhit USING (doc_id)"""
ORACLE["lexicon_multiword"] = f"""
WITH {_LEX}, {TOKENS}, {ngrams('tok', 'doc_id', _MAX, n_min=2)}, {GRAM_CELLS}, {_MATCH}
SELECT doc_id, dict, category, CAST(sum(n) AS BIGINT) AS n
FROM cells JOIN hits USING (term) GROUP BY doc_id, dict, category"""

_emo = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (category = '{c}'), 0) AS BIGINT) AS nrc_{c}" for c in wl.EMOTION_CATEGORIES
)
ORACLE["emotion_counts"] = f"""
WITH {CELLS}, e AS (SELECT * FROM {values(wl.EMOTIONS, ['word', 'category'])}),
h AS (SELECT doc_id, category, n FROM cells JOIN e ON term = word)
SELECT doc_id, {_emo} FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id"""


def ratio_sql(texts: str, key: str, fields: list[tuple[str, str]], porter: bool = False) -> str:
    """Ratio columns from ``texts(key, field, text)`` for (field, prefix) pairs."""
    stop = word_list(wl.STOPWORDS)
    lexicon = f"lex0 AS (SELECT * FROM {values(wl.RATIO_LEXICON, ['dict', 'category', 'pattern'])})"
    raw = f"raw AS (SELECT {key}, field, unnest({words('text')}) AS term FROM texts)"
    kept = f"kept AS (SELECT {key}, field, term FROM raw WHERE term NOT IN {stop})"
    if porter:
        stems = porter_ctes("SELECT term FROM kept UNION SELECT pattern FROM lex0")
        lexicon += f", {raw}, {kept}, {stems}"
        tokens = f"toks AS (SELECT {key}, field, stem AS term FROM kept JOIN stems USING (term))"
        lex = "lex AS (SELECT DISTINCT dict, category, stem AS pattern FROM lex0 JOIN stems ON pattern = term)"
    else:
        lexicon += f", {raw}, {kept}"
        tokens = "toks AS (SELECT * FROM kept)"
        lex = "lex AS (SELECT DISTINCT * FROM lex0)"
    cols, outs = [], []
    for f, prefix in fields:
        cols.append(f"count(*) FILTER (field = '{f}') AS w_{f}")
        outs.append(f"CAST(coalesce(w_{f}, 0) AS BIGINT) AS \"{prefix}WordCount\"")
        for d in ["GI", "HE", "LM", "QDAP"]:
            for c in ["positive", "negative"] + (["uncertainty"] if d == "LM" else []):
                inside = f"(SELECT pattern FROM lex WHERE dict = '{d}' AND category = '{c}')"
                cols.append(f"count(*) FILTER (field = '{f}' AND term IN {inside}) AS {d}_{c}_{f}")
            share = f"round(({{}})::DOUBLE / nullif(w_{f}, 0) + 1e-9, 6) + 0.0 AS \"{prefix}{{}}\""
            outs.append(share.format(f"{d}_positive_{f} - {d}_negative_{f}", f"Sentiment{d}"))
            outs.append(share.format(f"{d}_negative_{f}", f"Negativity{d}"))
            outs.append(share.format(f"{d}_positive_{f}", f"Positivity{d}"))
            if d == "LM":
                outs.append(share.format(f"LM_uncertainty_{f}", "RatioUncertaintyLM"))
    return f"""{texts}, {lexicon}, {tokens}, {lex},
sums AS (SELECT {key}, {', '.join(cols)} FROM toks GROUP BY {key}),
ids AS (SELECT DISTINCT {key} FROM texts)
SELECT {key}, {', '.join(outs)} FROM ids LEFT JOIN sums USING ({key})"""


def porter_ctes(source: str) -> str:
    """``stems(term, stem)`` for the terms of ``source``, one CTE per step."""
    m0, m1, m_1 = st.MEASURE_OVER_0, st.MEASURE_OVER_1, st.MEASURE_IS_1
    vowel, short, double = st.HAS_VOWEL, st.SHORT_END, st.DOUBLED

    def cut(k: int) -> str:
        return f"left(s, length(s) - {k})"

    def table(rules: dict[str, str], measure: str) -> str:
        cases = ""
        for suffix, new in sorted(rules.items(), key=lambda r: -len(r[0])):
            k = len(suffix)
            fits = f"regexp_matches({cut(k)}, '{measure}')" if measure else "true"
            if suffix == "ion":
                fits += f" AND regexp_matches({cut(k)}, '[st]$')"
            cases += f" WHEN s LIKE '%{suffix}' THEN CASE WHEN {fits} THEN {cut(k)} || '{new}' ELSE s END"
        return f"CASE{cases} ELSE s END"

    past = f"""CASE WHEN s LIKE '%eed' THEN CASE WHEN regexp_matches({cut(3)}, '{m0}') THEN {cut(1)} ELSE s END
      WHEN s LIKE '%ed' THEN CASE WHEN regexp_matches({cut(2)}, '{vowel}') THEN {cut(2)} || '!' ELSE s END
      WHEN s LIKE '%ing' THEN CASE WHEN regexp_matches({cut(3)}, '{vowel}') THEN {cut(3)} || '!' ELSE s END
      ELSE s END"""
    repair = f"""CASE WHEN s NOT LIKE '%!' THEN s
      WHEN regexp_matches({cut(1)}, '(?:at|bl|iz)$') THEN {cut(1)} || 'e'
      WHEN regexp_matches({cut(1)}, '{double}') THEN {cut(2)}
      WHEN regexp_matches({cut(1)}, '{short}') THEN {cut(1)} || 'e' ELSE {cut(1)} END"""
    final_y = f"CASE WHEN s LIKE '%y' AND regexp_matches({cut(1)}, '{vowel}') THEN {cut(1)} || 'i' ELSE s END"
    final_e = f"""CASE WHEN s LIKE '%e' AND (regexp_matches({cut(1)}, '{m1}') OR
      (regexp_matches({cut(1)}, '{m_1}') AND NOT regexp_matches({cut(1)}, '{short}'))) THEN {cut(1)} ELSE s END"""
    final_ll = f"CASE WHEN s LIKE '%ll' AND regexp_matches(s, '{m1}') THEN {cut(1)} ELSE s END"
    steps = [
        table(st.STEP_1, ""), past, repair, final_y, table(st.STEP_2, m0), table(st.STEP_3, m0),
        table(dict.fromkeys(st.STEP_4, ""), m1), final_e, final_ll,
    ]
    ctes = [f"p0 AS (SELECT DISTINCT term, lower(term) AS s FROM ({source}))"]
    for i, step in enumerate(steps):
        ctes.append(f"p{i + 1} AS (SELECT term, CASE WHEN length(term) > 2 THEN {step} ELSE s END AS s FROM p{i})")
    ctes.append(f"stems AS (SELECT term, s AS stem FROM p{len(steps)})")
    return ",\n".join(ctes)


_DOC_TEXTS = "texts AS (SELECT doc_id, 'text' AS field, text FROM documents)"
ORACLE["sentiment_ratios"] = "WITH " + ratio_sql(_DOC_TEXTS, "doc_id", [("text", "")])
ORACLE["sentiment_ratios_stemmed"] = "WITH " + ratio_sql(_DOC_TEXTS, "doc_id", [("text", "")], True)
_ANSWER_TEXTS = "texts AS (" + " UNION ALL ".join(
    f"SELECT respondent_id, '{c}' AS field, {c} AS text FROM answers" for c in ANSWERS
) + ")"
ORACLE["sentiment_ratios_by_answer"] = f"WITH {ANSWERS_CTE}, " + ratio_sql(
    _ANSWER_TEXTS, "respondent_id", [(c, f"q{i}_") for i, c in enumerate(ANSWERS, 1)]
)
ORACLE["stem_vocab"] = f"""
WITH {CELLS}, {VOCAB}, {porter_ctes('SELECT term FROM vocab')}
SELECT term, term_count, stem FROM vocab JOIN stems USING (term)"""
ORACLE["dtm_stemmed"] = rf"""
WITH plain AS (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g'),
  '\p{{Nd}}', '', 'g')) AS t FROM documents),
toks AS (SELECT doc_id, unnest(string_split_regex(t, '\s+')) AS term FROM plain),
kept AS (SELECT * FROM toks WHERE term <> ''), {porter_ctes('SELECT term FROM kept')}
SELECT doc_id, stem, count(*) AS n FROM kept JOIN stems USING (term) GROUP BY doc_id, stem"""


def shifter_sql(texts: str, key: str, fields: list[tuple[str, str]]) -> str:
    near = f"OVER (PARTITION BY {key}, field, sent, clause ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)"
    outs = ", ".join(
        f"max(CASE WHEN field = '{f}' AND txt THEN score END) AS {name}" for f, name in fields
    )
    return f"""{texts},
pol AS (SELECT * FROM {values(wl.POLARITY, ['word', 'weight'])}),
shf AS (SELECT * FROM {values(wl.SHIFTERS, ['word', 'kind'])}),
s1 AS (SELECT {key}, field, unnest(string_split_regex(lower(text), '[.!?]+')) AS sentence,
  generate_subscripts(string_split_regex(lower(text), '[.!?]+'), 1) AS sent FROM texts WHERE text IS NOT NULL),
s2 AS (SELECT *, len({words('sentence')}) AS n_words FROM s1),
s3 AS (SELECT {key}, field, sent, n_words, unnest(string_split_regex(sentence, '[,;:]')) AS part,
  generate_subscripts(string_split_regex(sentence, '[,;:]'), 1) AS clause FROM s2 WHERE n_words > 0),
s4 AS (SELECT {key}, field, sent, clause, n_words, unnest({words('part')}) AS term,
  generate_subscripts({words('part')}, 1) AS pos FROM s3),
s5 AS (SELECT s4.*, weight, sum(CASE WHEN kind = 'negator' THEN 1 ELSE 0 END) {near} AS neg,
  sum(CASE WHEN kind = 'amplifier' THEN 1 ELSE 0 END) {near} AS amp,
  sum(CASE WHEN kind = 'deamplifier' THEN 1 ELSE 0 END) {near} AS deamp
  FROM s4 LEFT JOIN pol ON term = pol.word LEFT JOIN shf ON term = shf.word),
s6 AS (SELECT {key}, field, sent, n_words,
  weight * CASE WHEN neg % 2 = 1 THEN -1 ELSE 1 END * (1 + 0.8::DOUBLE * CASE WHEN neg % 2 = 1 THEN 0 ELSE amp END
  - least(0.8::DOUBLE * (deamp + CASE WHEN neg % 2 = 1 THEN amp ELSE 0 END), 1.0::DOUBLE)) AS score FROM s5),
s7 AS (SELECT {key}, field, sent, coalesce(sum(score), 0) / sqrt(max(n_words)) AS x FROM s6
  GROUP BY {key}, field, sent),
s8 AS (SELECT {key}, field, sum(x) AS total, count(*) FILTER (x <> 0) AS polar,
  count(*) FILTER (x = 0) AS flat FROM s7 GROUP BY {key}, field),
s9 AS (SELECT {key}, field, text IS NOT NULL OR true AS txt, CASE WHEN coalesce(polar, 0) = 0 THEN 0.0::DOUBLE
  ELSE round(total / (polar + sqrt(ln(1.0::DOUBLE + flat))) + 1e-9, 6) + 0.0 END AS score
  FROM texts LEFT JOIN s8 USING ({key}, field))
SELECT {key}, {outs} FROM s9 GROUP BY {key}"""


ORACLE["sentiment_shifters"] = "WITH " + shifter_sql(_DOC_TEXTS, "doc_id", [("text", "sent_all_text")])
ORACLE["sentiment_by_answer"] = f"WITH {ANSWERS_CTE}, " + shifter_sql(
    _ANSWER_TEXTS, "respondent_id", [(c, f"sent{i}") for i, c in enumerate(ANSWERS, 1)]
)
ORACLE["spelling_errors"] = f"""
WITH {CELLS} SELECT d.doc_id, CAST(coalesce(sum(n) FILTER (term NOT IN {word_list(wl.SPELLING)}), 0) AS BIGINT)
  AS errors FROM documents d LEFT JOIN cells USING (doc_id) GROUP BY d.doc_id"""
ORACLE["profanity_count"] = f"""
WITH {CELLS} SELECT d.doc_id, CAST(coalesce(sum(n) FILTER (term IN {word_list(wl.PROFANITY)}), 0) AS BIGINT)
  AS profanity FROM documents d LEFT JOIN cells USING (doc_id) GROUP BY d.doc_id"""

_LABEL = (
    f"CASE WHEN source IN {word_list(DEV_SOURCES)} THEN 'Dev' "
    f"WHEN source IN {word_list(TEST_SOURCES)} THEN 'Test' ELSE 'Train' END"
)
_blank = ", ".join(f"CAST(NULL AS DOUBLE) AS \"{t}_Pred\"" for t in ["A", "O", "C"])
ORACLE["submission_layout"] = f"""
SELECT d.doc_id AS "Respondent_ID", quality::DOUBLE AS "E_Pred", {_blank}, toxic::DOUBLE AS "N_Pred"
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {_LABEL} IN ('Dev', 'Test')"""
ORACLE["split_filter"] = f'SELECT {_LABEL} AS "Dataset", lang, count(*) AS n FROM documents GROUP BY 1, 2'
ORACLE["split_by_position"] = (
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents"
)
ORACLE["csv_round_trip"] = "SELECT conv_id, turn, role, text FROM conversations"
ORACLE["split_slices"] = """
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p < n * 3 // 5 THEN 'Train' WHEN p < n * 4 // 5 THEN 'Dev' ELSE 'Test' END AS "Dataset" FROM p"""
ORACLE["kfold_contiguous"] = (
    "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM documents"
)
_corrs = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS feature, CASE WHEN stddev_pop({f}) > 0 AND stddev_pop({t}) > 0"
    f" THEN corr({f}, {t}) END AS r FROM x WHERE {f} IS NOT NULL"
    for t in ["quality", "toxic"]
    for f in FORMULAS
)
ORACLE["feature_target_corr"] = f"""
WITH {COUNTS}, x AS (SELECT quality::DOUBLE AS quality, toxic::DOUBLE AS toxic,
  {', '.join(f'CAST({sql} AS DOUBLE) AS {name}' for name, sql in FORMULAS.items())} FROM f JOIN labels USING (doc_id)),
r AS ({_corrs})
SELECT target, feature, round(r + 1e-9, 4) + 0.0 AS r, CAST(row_number() OVER (PARTITION BY target
  ORDER BY round(abs(r), 6) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM r"""
ORACLE["readability_quality"] = f"""
WITH {COUNTS}, x AS (SELECT lang, W, St, {FORMULAS['Flesch_Kincaid']} AS grade, quality::DOUBLE AS quality
  FROM f JOIN documents USING (doc_id) JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg(W) + 1e-9, 4) AS avg_words, round(avg(St) + 1e-9, 4) AS avg_sentences,
  round(avg(grade) + 1e-9, 4) AS avg_grade, CASE WHEN stddev_pop(grade) > 0 AND stddev_pop(quality) > 0
  THEN round(corr(grade, quality) + 1e-9, 4) + 0.0 END AS r_quality FROM x GROUP BY lang"""
ORACLE["lexicon_wildcard"] = f"""
WITH {_LEX}, {CELLS}, {_MATCH}
SELECT dict, category, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS doc_count
FROM cells JOIN hits USING (term) GROUP BY dict, category, term"""


# Ridge with two features in closed form. Fold sums are taken about the overall
# means; training sums are the total minus the fold.
_sums = ["a", "b", "y", "a*a", "a*b", "b*b", "a*y", "b*y", "y*y"]
_names = ["sa", "sb", "sy", "saa", "sab", "sbb", "say", "sby", "syy"]
ORACLE["ridge_grid"] = f"""
WITH folded AS (SELECT *, ntile(10) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fold
  FROM lineitem),
long AS (SELECT fold, 'l_extendedprice' AS target, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM folded
  UNION ALL SELECT fold, 'l_tax', l_quantity, l_discount, l_tax FROM folded),
mid AS (SELECT target, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM long GROUP BY target),
z AS (SELECT fold, target, a - ma AS a, b - mb AS b, y - my AS y FROM long JOIN mid USING (target)),
f AS (SELECT target, fold, count(*)::DOUBLE AS n, {', '.join(f'sum({e}) AS {n}' for e, n in zip(_sums, _names, strict=True))}
  FROM z GROUP BY target, fold),
t AS (SELECT *, {', '.join(f'sum({n}) OVER (PARTITION BY target) - {n} AS t{n}' for n in ['n', *_names])} FROM f),
c AS (SELECT *, tsaa - tsa * tsa / tn AS caa, tsab - tsa * tsb / tn AS cab, tsbb - tsb * tsb / tn AS cbb,
  tsay - tsa * tsy / tn AS cay, tsby - tsb * tsy / tn AS cby FROM t),
g AS (SELECT * FROM c CROSS JOIN {values([(a,) for a in ALPHAS], ['alpha'])}),
w AS (SELECT *, ((cbb + alpha) * cay - cab * cby) / ((caa + alpha) * (cbb + alpha) - cab * cab) AS wa,
  ((caa + alpha) * cby - cab * cay) / ((caa + alpha) * (cbb + alpha) - cab * cab) AS wb FROM g),
d AS (SELECT *, (tsy - wa * tsa - wb * tsb) / tn AS shift FROM w),
e AS (SELECT target, alpha, n, syy - sy * sy / n AS sst,
  syy - 2 * (wa * say + wb * sby) + wa * wa * saa + 2 * wa * wb * sab + wb * wb * sbb
  - 2 * shift * (sy - wa * sa - wb * sb) + n * shift * shift AS sse FROM d)
SELECT alpha, target, round(sum(n * (1 - sse / sst)) / sum(n), 7) AS cv_r2,
  round(ln(sum(sse) / sum(n)), 7) AS cv_log_mse FROM e GROUP BY alpha, target"""

ORACLE["ridge_free"] = ORACLE["ridge_grid"]

# Two features: of the nine sign patterns' solutions, those with the pattern's signs are kept; the one with the
# smallest objective is the optimum.
_both = " UNION ALL ".join(
    f"""SELECT *, ((gbb + l2) * (ba - {i} * l1) - gab * (bb - {j} * l1)) / ((gaa + l2) * (gbb + l2) - gab * gab) AS wa,
  ((gaa + l2) * (bb - {j} * l1) - gab * (ba - {i} * l1)) / ((gaa + l2) * (gbb + l2) - gab * gab) AS wb,
  {i} AS ia, {j} AS ib FROM h"""
    for i in (-1, 1)
    for j in (-1, 1)
)
_head = ORACLE["ridge_grid"].split("\ng AS (SELECT")[0]
_tail = ORACLE["ridge_grid"].split("\nd AS (SELECT")[1].split("SELECT alpha, target, round")[0]
ORACLE["elastic_grid"] = f"""{_head}
g AS (SELECT *, caa / tn AS gaa, cab / tn AS gab, cbb / tn AS gbb, cay / tn AS ba, cby / tn AS bb,
  alpha * l1_ratio AS l1, alpha * (1 - l1_ratio) AS l2
  FROM c CROSS JOIN {values([(a, r) for a in ALPHAS for r in L1_RATIOS], ['alpha', 'l1_ratio'])}),
h AS (SELECT * FROM g),
tried AS (SELECT *, 0.0 AS wa, 0.0 AS wb, 0 AS ia, 0 AS ib FROM h
  UNION ALL SELECT *, sign(ba) * greatest(abs(ba) - l1, 0) / (gaa + l2), 0.0, 0, 0 FROM h
  UNION ALL SELECT *, 0.0, sign(bb) * greatest(abs(bb) - l1, 0) / (gbb + l2), 0, 0 FROM h
  UNION ALL {_both}),
w AS (SELECT * FROM tried WHERE (ia = 0 AND ib = 0) OR l1 = 0 OR (sign(wa) = ia AND sign(wb) = ib)
  QUALIFY row_number() OVER (PARTITION BY target, fold, alpha, l1_ratio ORDER BY
    0.5 * (gaa * wa * wa + 2 * gab * wa * wb + gbb * wb * wb) - ba * wa - bb * wb
    + l1 * (abs(wa) + abs(wb)) + 0.5 * l2 * (wa * wa + wb * wb)) = 1),
d AS (SELECT{_tail.replace("SELECT target, alpha,", "SELECT target, alpha, l1_ratio,")}
SELECT alpha, l1_ratio, target, round(sum(n * (1 - sse / sst)) / sum(n), 6) AS cv_r2,
  round(ln(sum(sse) / sum(n)), 6) AS cv_log_mse FROM e GROUP BY alpha, l1_ratio, target"""

# One feature: the elastic net is a soft threshold.
ORACLE["elastic_one_feature"] = f"""
WITH folded AS (SELECT *, ntile(10) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fold
  FROM lineitem),
z AS (SELECT fold, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS a,
  l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM folded),
f AS (SELECT fold, count(*)::DOUBLE AS n, sum(a) AS sa, sum(y) AS sy, sum(a*a) AS saa, sum(a*y) AS say, sum(y*y) AS syy
  FROM z GROUP BY fold),
t AS (SELECT *, sum(n) OVER () - n AS tn, sum(sa) OVER () - sa AS tsa, sum(sy) OVER () - sy AS tsy,
  sum(saa) OVER () - saa AS tsaa, sum(say) OVER () - say AS tsay FROM f),
c AS (SELECT *, (tsaa - tsa * tsa / tn) / tn AS g, (tsay - tsa * tsy / tn) / tn AS b FROM t),
k AS (SELECT * FROM c CROSS JOIN {values([(a, r) for a in ALPHAS for r in L1_RATIOS], ['alpha', 'l1_ratio'])}),
w AS (SELECT *, sign(b) * greatest(abs(b) - alpha * l1_ratio, 0) / (g + alpha * (1 - l1_ratio)) AS wa FROM k),
d AS (SELECT *, (tsy - wa * tsa) / tn AS shift FROM w),
e AS (SELECT alpha, l1_ratio, n, syy - sy * sy / n AS sst,
  syy - 2 * wa * say + wa * wa * saa - 2 * shift * (sy - wa * sa) + n * shift * shift AS sse FROM d)
SELECT alpha, l1_ratio, 'l_extendedprice' AS target, round(sum(n * (1 - sse / sst)) / sum(n), 7) AS cv_r2,
  round(ln(sum(sse) / sum(n)), 7) AS cv_log_mse FROM e GROUP BY alpha, l1_ratio"""
ORACLE["holdout_metrics"] = """
WITH x AS (SELECT l_returnflag AS target, l_extendedprice AS y, l_quantity * 1500 AS pred FROM lineitem)
SELECT target, count(*) AS n, round(corr(pred, y), 6) AS r,
  round(1 - avg((y - pred) * (y - pred)) / var_pop(y), 6) AS r2, round(avg((y - pred) * (y - pred)), 0) AS mse
FROM x GROUP BY target"""

ORACLE["lemma_counts"] = f"""
WITH {CELLS}, l AS (SELECT * FROM {values(wl.LEMMAS, ['term', 'lemma'])})
SELECT doc_id, coalesce(lemma, c.term) AS term, CAST(sum(n) AS BIGINT) AS n
FROM cells c LEFT JOIN l ON c.term = l.term GROUP BY doc_id, coalesce(lemma, c.term)"""
_SIX = _ANSWER_TEXTS[:-1] + " UNION ALL SELECT respondent_id, 'all_text' AS field, " + (
    f"concat_ws(' ', {', '.join(ANSWERS)}) AS text FROM answers)"
)
ORACLE["dtm_by_field"] = f"""
WITH {ANSWERS_CTE}, {_SIX},
cells AS (SELECT respondent_id, field, term, count(*) AS n FROM
  (SELECT respondent_id, field, unnest({words('text')}) AS term FROM texts) AS t GROUP BY ALL),
vocab AS (SELECT field, term FROM cells GROUP BY field, term
  HAVING sum(n) >= 25 AND count(*)::DOUBLE / (SELECT count(*) FROM answers) <= 0.9)
SELECT respondent_id, field, term, n::DOUBLE AS value FROM cells JOIN vocab USING (field, term)"""

# A text's topic shares sum to one if one of its words is in the vocabulary; an n-gram in two texts has all
# its words there.
_TOPIC_FIELDS = " UNION ALL ".join(
    f"SELECT respondent_id, '{f}' AS field, {k} AS n_topics, coalesce({f}, '') AS text FROM six" for f, k in TOPICS.items()
)
ORACLE["lda_topics"] = f"""
WITH {ANSWERS_CTE}, six AS (SELECT *, concat_ws(' ', {', '.join(ANSWERS)}) AS all_text FROM answers),
texts AS ({_TOPIC_FIELDS}),
found AS (SELECT DISTINCT respondent_id, field, term FROM
  (SELECT respondent_id, field, unnest({words('text')}) AS term FROM texts) AS t WHERE term NOT IN {word_list(wl.STOPWORDS)}),
vocab AS (SELECT field, term FROM found GROUP BY field, term HAVING count(*) >= 2),
seen AS (SELECT DISTINCT respondent_id, field FROM found JOIN vocab USING (field, term))
SELECT t.respondent_id, t.field, CAST(t.n_topics AS INTEGER) AS n_topics, 0 AS n_wrong,
  CASE WHEN s.field IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS total, true AS learned
FROM texts t LEFT JOIN seen s USING (respondent_id, field)"""
_FIELDS = ", ".join(f"('{f}')" for f in TOPICS)
ORACLE["choose_k"] = f"""
SELECT field, CAST(k AS INTEGER) AS k, true AS has_bound, true AS has_cosine, CAST(1 AS BIGINT) AS n_best_likelihood,
  CAST(1 AS BIGINT) AS n_best_cosine
FROM (VALUES {_FIELDS}) AS f(field) CROSS JOIN range({min(CHOICES)}, {max(CHOICES) + 1}) AS r(k)"""

# The wide table joins the single-family results. The concatenated text takes the
# place of the documents inside the families that read those.
_names = {}
for _d, _k in _cats:
    _name, _i = f"dict_{_k}", 0
    while _name in _names.values():
        _i += 1
        _name = f"dict_{_k}_{_i}"
    _names[_d, _k] = _name
_dict_out = ", ".join(f"d.{a}_{b} AS {name}" for (a, b), name in _names.items())
_profile_names = ["WC", "WPS", "Sixltr", "Dic", "AllPunc", *_marks, "OtherP"]
_profile_out = ", ".join(f'd."{c}" AS "dict_{c}"' for c in _profile_names)
_six_fields = [(c, f"q{i}_") for i, c in enumerate(ANSWERS, 1)] + [("all_text", "all_")]
_six_sents = [(c, f"sent{i}") for i, c in enumerate(ANSWERS, 1)] + [("all_text", "sent_all_text")]


def _all_but(table: str, key: str) -> str:
    return f"{table}.* EXCLUDE ({key})"


ORACLE["assemble_features"] = f"""
WITH {ANSWERS_CTE},
documents AS (SELECT respondent_id AS doc_id, concat_ws(' ', {', '.join(ANSWERS)}) AS text FROM answers),
r AS ({ORACLE['readability_corpus']}), ra AS ({ORACLE['readability_by_answer']}),
cw AS ({ORACLE['char_per_word']}), d AS ({ORACLE['dictionary_profile']}),
em AS ({ORACLE['emotion_counts']}), er AS ({ORACLE['spelling_errors']}), pr AS ({ORACLE['profanity_count']}),
sr AS (WITH {ratio_sql(_SIX, 'respondent_id', _six_fields, True)}),
ss AS (WITH {shifter_sql(_SIX, 'respondent_id', _six_sents)}), ld AS ({ORACLE['lexdiv_weighted']})
SELECT a.*, documents.text AS all_text, {_all_but('r', 'doc_id')}, {_all_but('ra', 'respondent_id')},
  {_all_but('cw', 'respondent_id')}, {_profile_out}, {_dict_out}, {_all_but('em', 'doc_id')},
  CAST(er.errors AS BIGINT) AS errors, pr.profanity, {_all_but('sr', 'respondent_id')},
  {_all_but('ss', 'respondent_id')}, {_all_but('ld', 'respondent_id')}
FROM answers a JOIN documents ON documents.doc_id = a.respondent_id JOIN r ON r.doc_id = a.respondent_id
JOIN ra USING (respondent_id) JOIN cw USING (respondent_id) JOIN d ON d.doc_id = a.respondent_id
JOIN em ON em.doc_id = a.respondent_id JOIN er ON er.doc_id = a.respondent_id
JOIN pr ON pr.doc_id = a.respondent_id JOIN sr USING (respondent_id) JOIN ss USING (respondent_id)
JOIN ld USING (respondent_id)"""


def orthogonal_iteration(steps: int) -> str:
    """``s{steps}(r11, r22, r33)`` from ``unit(doc_id, term, w)``: the squares of the three largest singular values."""
    columns = "abc"
    start = ", ".join(f"hash(term || '{c}') % 1000003 / 1000003.0 - 0.5 AS {c}" for c in columns)
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in columns)
    parts = [f"z0 AS MATERIALIZED (SELECT term, {start} FROM (SELECT DISTINCT term FROM unit))"]
    for i in range(1, steps + 1):
        parts += [
            f"y{i} AS MATERIALIZED (SELECT doc_id, {sums} FROM unit JOIN z{i - 1} USING (term) GROUP BY doc_id)",
            f"x{i} AS MATERIALIZED (SELECT term, {sums} FROM unit JOIN y{i} USING (doc_id) GROUP BY term)",
            f"g{i} AS (SELECT sqrt(sum(a * a)) AS r11, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, "
            f"sum(b * c) AS bc, sum(c * c) AS cc FROM x{i})",
            f"h{i} AS (SELECT *, ab / r11 AS r12, ac / r11 AS r13, sqrt(bb - (ab / r11) ** 2) AS r22 FROM g{i})",
            f"k{i} AS (SELECT *, (bc - r12 * r13) / r22 AS r23 FROM h{i})",
            f"s{i} AS MATERIALIZED (SELECT *, sqrt(cc - r13 ** 2 - r23 ** 2) AS r33 FROM k{i})",
            f"p{i} AS (SELECT term, a / r11 AS a, (b - r12 * a / r11) / r22 AS b, c FROM x{i}, s{i})",
            f"z{i} AS MATERIALIZED (SELECT term, a, b, (c - r13 * a - r23 * b) / r33 AS c FROM p{i}, s{i})",
        ]
    return ",\n".join(parts)


SVD_STEPS = 70
ORACLE["svd_spectrum"] = f"""
WITH {_TERM2}, grams AS (SELECT doc_id, unnest(w) AS term FROM tok), {GRAM_CELLS}, vocab AS (
  SELECT term, count(*) AS doc_count FROM cells GROUP BY term HAVING count(*) >= 2), weighted AS (
  SELECT doc_id, term, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + doc_count)) + 1) AS raw
  FROM cells JOIN vocab USING (term)),
unit AS MATERIALIZED (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM weighted),
{orthogonal_iteration(SVD_STEPS)}
SELECT component, round(sqrt(square), 4) AS sigma, round(square, 3) AS energy
FROM (SELECT unnest([1, 2, 3]) AS component, unnest([r11, r22, r33]) AS square FROM s{SVD_STEPS})"""

# The whole column of counts, zeros too, against each label.
ORACLE["term_target_corr"] = f"""
WITH {CELLS}, marked AS (SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic
  FROM documents JOIN labels USING (doc_id)),
held AS (SELECT c.* FROM cells c JOIN marked USING (doc_id)),
dense AS (SELECT term, m.doc_id, quality, toxic, coalesce(n, 0)::DOUBLE AS x
  FROM (SELECT DISTINCT term FROM held) CROSS JOIN marked m LEFT JOIN held USING (term, doc_id)),
found AS (SELECT term, target, count(y) AS n,
  CASE WHEN stddev_pop(CASE WHEN y IS NOT NULL THEN x END) > 1e-7 AND stddev_pop(y) > 0 THEN corr(y, x) END AS r
  FROM (SELECT term, x, unnest(['quality', 'toxic']) AS target, unnest([quality, toxic]) AS y FROM dense)
  GROUP BY term, target)
SELECT term, target, n, round(r, 6) AS r FROM found"""
