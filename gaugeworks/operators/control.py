"""The model loop as one recursive query over ticks, its rule variants as rows.

A tick first confirms or reverts a provisional swap, then judges the challenger, then trains a new one. The
state is a row for each variant; measures are prefix sums over the files that have ended by each tick, so a
comparison on the files of a span is a difference of two sums. Version v has the odd or the even scores of a
file by whether v is odd.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gaugeworks.operators.staging import staged

#: Columns of a tick: its number from 1, files ended by then, and sums over them: odd score less even, files in which
#: either is at least as good, false alarms of either.
TICK = "tick long, n long, d double, odd_wins long, even_wins long, odd_fa long, even_fa long"
#: Columns of a variant: files that a first model, a new one, a judgement and a confirmation need; the gain a file that a
#: swap must exceed and the loss a file from which it is reverted; whether most files must be won; the greatest ratio
#: of false alarms (null: any).
VARIANT = "variant long, first long, fresh long, shadow long, confirm long, margin double, noise double, majority boolean, ratio double"


def control_sql(ticks: str, variants: str) -> str:
    """The loop in SQL that Spark and DuckDB both run, over a table of ticks and one of variants."""
    name = lambda v: f"concat('v', CAST({v} AS VARCHAR(20)))"
    parity = lambda v: f"({v} % 2)"
    by_parity = lambda v, odd, even: f"CASE WHEN {parity(v)} = 1 THEN {odd} ELSE {even} END"
    sums = ("d", "odd_wins", "even_wins", "odd_fa", "even_fa")
    none = "CAST(NULL AS BIGINT)"
    trained = ", ".join(f"CASE WHEN train THEN {s} ELSE h_{s} END AS h_{s}" for s in sums)
    return f"""WITH RECURSIVE loop AS (
SELECT variant, CAST(0 AS BIGINT) AS tick, {none} AS champion, {none} AS challenger, {none} AS prev, CAST(0 AS BIGINT) AS versions, CAST(0 AS BIGINT) AS last_n, CAST(0 AS BIGINT) AS h_n,
 CAST(0 AS DOUBLE) AS h_d, CAST(0 AS BIGINT) AS h_odd_wins, CAST(0 AS BIGINT) AS h_even_wins, CAST(0 AS BIGINT) AS h_odd_fa, CAST(0 AS BIGINT) AS h_even_fa, CAST(0 AS BIGINT) AS p_n, CAST(0 AS DOUBLE) AS p_d, CAST('' AS VARCHAR(200)) AS actions FROM {variants}
UNION ALL
SELECT variant, tick, CASE WHEN begins THEN CAST(1 AS BIGINT) ELSE c3 END, CASE WHEN train THEN versions + 1 ELSE h3 END, p3, CASE WHEN train THEN versions + 1 WHEN begins THEN CAST(1 AS BIGINT) ELSE versions END,
 CASE WHEN train OR begins THEN n ELSE last_n END, CASE WHEN train THEN n ELSE h_n END, {trained}, CASE WHEN swap THEN n ELSE p_n END, CASE WHEN swap THEN d ELSE p_d END,
 CAST(concat(CASE WHEN begins THEN 'first:v1 ' WHEN c IS NULL THEN concat('wait_first:', CAST(n AS VARCHAR(20)), ' ') ELSE '' END, act1, CASE WHEN swap THEN concat('swap:', {name("c2")}, '|', {name("h")}, ' ') WHEN judged THEN concat('keep:', {name("c2")}, '|', {name("h")}, ' ')
  WHEN h IS NOT NULL THEN concat('defer:', CAST(files AS VARCHAR(20)), ' ') ELSE '' END, CASE WHEN train THEN concat('train:', {name("versions + 1")}, ' ') ELSE '' END) AS VARCHAR(200))
FROM (SELECT *, c IS NULL AND n >= first AS begins, c3 IS NOT NULL AND h3 IS NULL AND n - last_n >= fresh AS train FROM
 (SELECT *, CASE WHEN swap THEN h ELSE c2 END AS c3, CASE WHEN judged THEN {none} ELSE h END AS h3, CASE WHEN swap THEN c2 ELSE p2 END AS p3 FROM
 (SELECT *, judged AND gain > margin * files AND (NOT majority OR 2 * wins > files) AND (ratio IS NULL OR fa_h <= ratio * fa_c) AS swap FROM
 (SELECT *, coalesce(h IS NOT NULL AND n - h_n >= shadow, false) AS judged, n - h_n AS files, ({parity("h")} - {parity("c2")}) * (d - h_d) AS gain,
  CASE WHEN {parity("h")} = {parity("c2")} THEN n - h_n ELSE {by_parity("h", "odd_wins - h_odd_wins", "even_wins - h_even_wins")} END AS wins,
  {by_parity("h", "odd_fa - h_odd_fa", "even_fa - h_even_fa")} AS fa_h, {by_parity("c2", "odd_fa - h_odd_fa", "even_fa - h_even_fa")} AS fa_c FROM
 (SELECT *, CASE WHEN reverts THEN p ELSE c END AS c2, CASE WHEN due THEN {none} ELSE p END AS p2, CASE WHEN reverts THEN concat('revert:', {name("c")}, '|', {name("p")}, ' ') WHEN due THEN concat('confirm:', {name("c")}, ' ') ELSE '' END AS act1 FROM
 (SELECT *, due AND ({parity("c")} - {parity("p")}) * (d - p_d) < -noise * (n - p_n) AS reverts FROM
 (SELECT l.variant, t.tick, l.champion AS c, l.challenger AS h, l.prev AS p, l.versions, l.last_n, l.h_n, l.h_d, l.h_odd_wins, l.h_even_wins, l.h_odd_fa, l.h_even_fa, l.p_n, l.p_d,
  v.first, v.fresh, v.shadow, v.confirm, v.margin, v.noise, v.majority, v.ratio, t.n, t.d, t.odd_wins, t.even_wins, t.odd_fa, t.even_fa,
  coalesce(l.prev IS NOT NULL AND t.n - l.p_n >= v.confirm, false) AS due FROM loop l JOIN {ticks} t ON t.tick = l.tick + 1 JOIN {variants} v ON v.variant = l.variant) a) b) c1) d1) e) f) g)
SELECT variant, tick, champion, challenger, prev, trim(actions) AS actions FROM loop WHERE tick > 0"""


def control(ticks: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant, tick, champion, challenger, prev, actions) of every tick: what the loop does under each variant.

    ``prev`` is the champion that a provisional swap may yet go back to. ``ticks`` are numbered from 1 without
    gaps, at most as many as ``spark.sql.cteRecursionLevelLimit``; both tables are small by nature: a row a tick, a row
    a variant. Tables without rows give none.
    """
    spark, own = ticks.sparkSession, uuid.uuid4().hex
    names = [f"{x}_{own}" for x in ("ticks", "variants")]
    for name, df in zip(names, (ticks, variants), strict=True):
        # every round of the recursion reads both: unstaged, it would compute them from their sources again
        staged(df, name).createOrReplaceTempView(name)
    return spark.sql(control_sql(*names).replace("VARCHAR(200)", "STRING").replace("VARCHAR(20)", "STRING"))
