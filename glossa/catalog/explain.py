"""Explanation queries with a frequency-based (rarity rank) weight."""

from __future__ import annotations

from glossa import sqltext as S
from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.vocab import VOCAB_CTE
from glossa.operators import explain as X
from glossa.operators import tokens as tok
from glossa.operators import vocab as V
from glossa.session import landed

N_SENT, N_WORDS = 3, 5

BASE_SQL = f"""{VOCAB_CTE},
st AS MATERIALIZED ({S.sentence_rows_sql()}),
tw AS MATERIALIZED (SELECT tk.doc_id, tk.sent_pos, tk.word_pos, tk.word, CAST(v.idx AS BIGINT) AS weight
       FROM tk JOIN vocab v ON tk.word = v.word),
sw AS MATERIALIZED (SELECT st.doc_id, st.sent_pos, CAST(coalesce(sum(tw.weight), 0) AS BIGINT) AS weight
       FROM st LEFT JOIN tw ON st.doc_id = tw.doc_id AND st.sent_pos = tw.sent_pos
       GROUP BY st.doc_id, st.sent_pos),
sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, sent_pos) AS rank FROM sw)"""

WORD_ORDER = "PARTITION BY doc_id ORDER BY weight DESC, sent_pos, word_pos"


def parts(spark, d):
    """Cut sentences (landed: texts are cut once), the weights of words, and of sentences."""
    sents = tok.cut_sentences(landed(tok.cut_documents(C.docs(spark, d)), "cut"))
    toks = tok.sentence_tokens(sents)
    table = X.weight_table(V.vocab_rank(toks))
    return sents, table, X.sentence_weights(sents, X.weighted(toks, table))


def chosen_tokens(sents, table, sw):
    """Weighted tokens of the heaviest sentences: sentences are chosen before their words are taken."""
    return X.weighted(tok.sentence_tokens(X.in_sentences(sents, X.top_sentences(sw, N_SENT))), table)


@register("top_sentences", sql=f"WITH {BASE_SQL}\nSELECT doc_id, sent_pos, weight, CAST(rank AS INTEGER) AS rank FROM sr WHERE rank <= {N_SENT}")
def top_sentences(spark, d):
    _, _, sw = parts(spark, d)
    return X.top_sentences(sw, N_SENT).select("doc_id", "sent_pos", "weight", "rank")


# the tokens of the chosen sentences: words are ranked within the summary
CHOSEN_SQL = f"""{BASE_SQL},
ct AS (SELECT tw.* FROM tw JOIN sr ON sr.doc_id = tw.doc_id AND sr.sent_pos = tw.sent_pos WHERE sr.rank <= {N_SENT})"""


@register("top_words", sql=f"""WITH {CHOSEN_SQL},
wr AS (SELECT *, row_number() OVER ({WORD_ORDER}) AS rank FROM ct)
SELECT doc_id, sent_pos, word_pos, word, weight, CAST(rank AS INTEGER) AS rank FROM wr WHERE rank <= {N_WORDS}""")
def top_words(spark, d):
    return X.top_words(chosen_tokens(*parts(spark, d)), N_WORDS).select("doc_id", "sent_pos", "word_pos", "word", "weight", "rank")


_W_LEVEL = "CASE ntile(3) OVER ({o}) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
_S_LEVEL = ("CASE ntile(4) OVER (PARTITION BY doc_id ORDER BY weight DESC, sent_pos) "
            "WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END")


@register("word_terciles", sql=f"""WITH {CHOSEN_SQL}
SELECT doc_id, sent_pos, word_pos, {_W_LEVEL.format(o=WORD_ORDER)} AS level FROM ct""")
def word_terciles(spark, d):
    return X.word_terciles(chosen_tokens(*parts(spark, d))).select("doc_id", "sent_pos", "word_pos", "level")


@register("sentence_quartiles", sql=f"""WITH {BASE_SQL}
SELECT doc_id, sent_pos, {_S_LEVEL} AS level FROM sw""")
def sentence_quartiles(spark, d):
    _, _, sw = parts(spark, d)
    return X.sentence_quartiles(sw).select("doc_id", "sent_pos", "level")


@register("top_sentence_text", sql=f"""WITH {BASE_SQL}
SELECT st.doc_id, st.sent_pos, st.sentence FROM st
WHERE EXISTS (SELECT 1 FROM sr WHERE sr.rank <= {N_SENT} AND sr.doc_id = st.doc_id AND sr.sent_pos = st.sent_pos)""")
def top_sentence_text(spark, d):
    _, _, sw = parts(spark, d)
    sents = tok.sentence_table(C.docs(spark, d))
    return X.sentence_text(sents, X.top_sentences(sw, N_SENT))


@register("extractive_summary", sql=f"""WITH {BASE_SQL}
SELECT st.doc_id, array_to_string(list(st.sentence ORDER BY st.sent_pos), ' ') AS summary
FROM st JOIN sr ON sr.doc_id = st.doc_id AND sr.sent_pos = st.sent_pos WHERE sr.rank <= {N_SENT}
GROUP BY st.doc_id""")
def extractive_summary(spark, d):
    _, _, sw = parts(spark, d)
    sents = tok.sentence_table(C.docs(spark, d))
    return X.extractive_summary(sents, X.top_sentences(sw, N_SENT))


@register("highlight_spans", sql=f"""WITH {BASE_SQL},
sl AS (SELECT doc_id, sent_pos, {_S_LEVEL} AS sent_level,
              row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, sent_pos) <= {N_SENT} AS chosen FROM sw),
tt AS MATERIALIZED (SELECT tw.*, sl.sent_level, sl.chosen FROM tw JOIN sl ON tw.doc_id = sl.doc_id AND tw.sent_pos = sl.sent_pos),
cb AS (SELECT *, CASE WHEN chosen THEN ntile(3) OVER (PARTITION BY doc_id, chosen ORDER BY weight DESC, sent_pos, word_pos) END AS b
       FROM tt),
lv AS (SELECT *, CASE WHEN chosen THEN min(b) OVER (PARTITION BY doc_id, word) END AS best FROM cb)
SELECT doc_id, sent_pos, word_pos, word, sent_level,
       CASE best WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS word_level
FROM lv""")
def highlight_spans(spark, d):
    sents, table, sw = parts(spark, d)
    levelled = X.with_levels(sents, X.sentence_levels(sw, N_SENT))
    tw = X.weighted(tok.sentence_tokens(levelled, ["sent_level", "chosen"]), table)
    return X.highlight_spans(tw, sw, N_SENT)
