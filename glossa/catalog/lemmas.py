"""Lemmatised preparation: cleaned text, hierarchical data, the one-year corpus."""

from __future__ import annotations

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.encode import F_, K, M, _LANG_SRC, matrix_sql
from glossa.catalog.io import _REVIEWS_SQL, reviews
from glossa.catalog.sqlparts import coded_cte, stratified_cte
from glossa.catalog.vocab import TOKENS_CTE
from glossa.functions.stopwords import ENGLISH_STOP_WORDS
from glossa.operators import lemmas as LM
from glossa.session import scratch_path
from glossa.sources import files as FS


def lemma_ctes(source: str) -> str:
    """CTE chain ending in ``tk``: the clean tokens of ``source(doc_id, text)`` as lemmas by its own words."""
    forms = ", ".join(f"CASE WHEN word LIKE {S.q('%' + end)} AND length(word) > {len(end)} "
                      f"THEN left(word, length(word) - {len(end)}) || {S.q(new)} END" for end, new in LM.NOUN_RULES)
    irregular = ", ".join(f"({S.q(w)}, {S.q(x)})" for w, x in LM.NOUN_EXCEPTIONS.items())
    return f"""tk0 AS MATERIALIZED ({S.token_rows_sql(source, ENGLISH_STOP_WORDS)}),
vw AS MATERIALIZED (SELECT DISTINCT word FROM tk0),
irregular(word, lemma) AS (VALUES {irregular}),
forms AS (SELECT word, unnest([word, {forms}]) AS form FROM vw),
chosen AS (SELECT word, min({{'n': length(form), 'form': form}}).form AS lemma
           FROM forms WHERE form IN (SELECT word FROM vw) GROUP BY word),
lem AS (SELECT vw.word, coalesce(irregular.lemma, chosen.lemma) AS lemma
        FROM vw LEFT JOIN irregular ON irregular.word = vw.word LEFT JOIN chosen ON chosen.word = vw.word),
tk AS MATERIALIZED (SELECT tk0.doc_id, tk0.sent_pos, tk0.word_pos, coalesce(lem.lemma, tk0.word) AS word
       FROM tk0 LEFT JOIN lem ON lem.word = tk0.word)"""


def clean_ctes(source: str) -> str:
    """CTE chain ending in ``cleaned(doc_id, text)`` for ``source(doc_id, text)``."""
    return f"""{lemma_ctes(source)},
sn AS ({S.sentence_rows_sql(source)}),
sl AS (SELECT sn.doc_id, sn.sent_pos, coalesce(string_agg(tk.word, ' ' ORDER BY tk.word_pos), '') || ' . ' AS line
       FROM sn LEFT JOIN tk ON tk.doc_id = sn.doc_id AND tk.sent_pos = sn.sent_pos GROUP BY sn.doc_id, sn.sent_pos),
dl AS (SELECT doc_id, string_agg(line, '' ORDER BY sent_pos) AS text FROM sl GROUP BY doc_id),
cleaned AS (SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN coalesce(dl.text, '') END AS text
            FROM {source} s LEFT JOIN dl ON dl.doc_id = s.doc_id)"""


@register("clean_text_lemmas", sql=f"WITH {clean_ctes('documents')}\nSELECT doc_id, text FROM cleaned")
def clean_text_lemmas(spark, d):
    return LM.clean_lemma_text(C.docs(spark, d), LM.lemma_table(C.clean_tokens(spark, d)))


@register("prepare_hierarchical_lemmas", sql=f"""
WITH {coded_cte(_LANG_SRC)},
{stratified_cte()},
{matrix_sql('mdocs AS (SELECT doc_id FROM documents)').replace(TOKENS_CTE, lemma_ctes('documents'))}
SELECT s.doc_id, s.split, s.code,
       list_transform(range(s.n_classes), lambda i: CAST(i = s.code AS INTEGER)) AS y, mat.x
FROM strat s JOIN mat ON s.doc_id = mat.doc_id""")
def prepare_hierarchical_lemmas(spark, d):
    from glossa.plans.prepare import prepare_hierarchical as plan

    return plan(C.corpus(spark, d, "lang"), M, K, F_, seed=C.SEED, lemmas=True)


@register("prepare_year_corpus_lemmas", sql=f"""WITH r AS ({_REVIEWS_SQL}),
yr AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, stars, text FROM r
       WHERE date >= TIMESTAMP '{C.YEAR}-01-01 00:00:00' AND date <= TIMESTAMP '{C.YEAR}-12-30 00:00:00'),
{clean_ctes('yr')}
SELECT CAST(coalesce(TRY_CAST(trunc(yr.stars) AS INTEGER) - 1, 0) AS INTEGER) AS label, cleaned.text
FROM yr JOIN cleaned ON cleaned.doc_id = yr.doc_id""")
def prepare_year_corpus_lemmas(spark, d):
    from glossa.plans.year_corpus import prepare_year_corpus as plan

    src, out = scratch_path(spark, "yjson"), scratch_path(spark, "ycsv")
    FS.write_jsonl(reviews(spark, d), src)
    plan(spark, src, out, C.YEAR, lemmas=True)
    return FS.read_csv_reviews(spark, out, "label int, text string")
