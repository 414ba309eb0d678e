"""Epoch batches and the incremental vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog import common as C
from glossa.catalog import register
from glossa.catalog.vocab import VOCAB_CTE
from glossa.operators import epochs as EP
from glossa.operators import tokens as tok
from glossa.operators import vocab_state as VS
from glossa.session import materialize, scratch_path
from glossa.sources import stores as ST

EPOCHS, BATCH = 3, 64


def _encrypted_sql(source: str, epoch: int) -> str:
    """``source(doc_id, place)`` with ``place`` encrypted, a nested select a round."""
    sql = f"SELECT s.doc_id, s.place // k.side AS l, s.place % k.side AS r, k.side FROM {source} s, size k"
    for a, b in EP.round_keys(C.SEED, epoch):
        base = f"((r + {a}) % {EP.PRIME})"
        sql = f"SELECT doc_id, r AS l, (l + ({base} * {base} + {b}) % {EP.PRIME}) % side AS r, side FROM ({sql})"
    return f"SELECT doc_id, l * side + r AS place FROM ({sql})"


def _epoch_sql(e: int) -> str:
    return f"""walk{e} AS (SELECT doc_id, place FROM ({_encrypted_sql('rows', e)})
  UNION ALL SELECT w.doc_id, w.place FROM ({_encrypted_sql(f'(SELECT doc_id, place FROM walk{e}, size WHERE place >= size.n)', e)}) w)"""


@register("epoch_batches", sql=f"""WITH RECURSIVE rows AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM documents),
{(',' + chr(10)).join(_epoch_sql(e) for e in range(EPOCHS))},
every AS ({' UNION ALL '.join(f'SELECT {e} AS epoch, doc_id, place FROM walk{e}' for e in range(EPOCHS))})
SELECT CAST(epoch AS INTEGER) AS epoch, doc_id, place, place // {BATCH} AS batch, CAST(place % {BATCH} AS INTEGER) AS slot
FROM every, size WHERE place < size.n""")
def epoch_batches(spark, d):
    rows = materialize(EP.numbered(C.docs(spark, d).select("doc_id")))
    n = rows.count()
    parts = [EP.epoch_batches(rows, n, e, BATCH, C.SEED) for e in range(EPOCHS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("epoch", "doc_id", "place", "batch", "slot")


@register("vocab_incremental", sql=f"WITH {VOCAB_CTE} SELECT * FROM vocab")
def vocab_incremental(spark, d):
    """Three parts of the corpus, one of them offered twice: equal to one fit."""
    docs, root = C.docs(spark, d).select("doc_id", "text"), scratch_path(spark, "vocab-state")
    for part in (0, 1, 2, 1):
        some = docs.where(F.pmod("doc_id", F.lit(3)) == part)
        VS.add_part(root, f"part-{part}", tok.clean_tokens(some), ST.fingerprint(some))
    return VS.ranked(spark, root)
