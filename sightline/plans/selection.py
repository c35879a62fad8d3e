"""Draws and picks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.catalog import query
from sightline.operators import selection
from sightline.plans.tables import E, events, load


@query("quota_draw", """WITH h AS (SELECT doc_id, lang, source, md5('7:' || lang || ':' || source || ':' || CAST(doc_id AS VARCHAR)) AS draw FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY draw, doc_id) AS k, dense_rank() OVER (PARTITION BY lang ORDER BY source) AS s FROM h), q AS (SELECT *, k > ceil(40.0 / max(s) OVER (PARTITION BY lang)) AS more FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY more, CASE WHEN NOT more THEN s END, CASE WHEN NOT more THEN k END, draw, doc_id) AS place FROM q) SELECT lang, source, doc_id FROM p WHERE place <= 40""")
def quota_draw(spark, sf_dir):
    """Forty documents of each language, even over its sources as far as they go."""
    return selection.quotas(load(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang"], "source", ["doc_id"], 40, seed=7)


_STEP = "list_append(p.got, (SELECT c.frame FROM c WHERE c.event_type = p.event_type AND {among} AND len(list_filter(p.got, lambda a: abs(a - c.frame) < 12)) = 0 ORDER BY {order}, c.frame LIMIT 1))"


@query("spaced_picks", f"""WITH RECURSIVE {E}, c AS (SELECT event_type, frame, max(value) AS top, md5('3:' || event_type || ':' || CAST(frame AS VARCHAR)) AS draw FROM e GROUP BY 1, 2),
p(event_type, k, got) AS (SELECT DISTINCT event_type, 0, CAST([] AS BIGINT[]) FROM c
UNION ALL SELECT event_type, k + 1, CASE WHEN k < 3 THEN {_STEP.format(among="c.frame % 24 < 6", order="c.top DESC")} WHEN k < 8 THEN {_STEP.format(among="TRUE", order="c.top DESC")} ELSE {_STEP.format(among="TRUE", order="c.draw")} END FROM p WHERE k < 12)
SELECT event_type, got[i] AS frame, CASE WHEN i <= 3 THEN 'night' WHEN i <= 8 THEN 'top' ELSE 'random' END AS phase, i AS turn FROM (SELECT event_type, got FROM p WHERE k = 12), range(1, 13) r(i)""")
def spaced_picks(spark, sf_dir):
    """Twelve hours of each event type, half a day apart: three of the night by their top value, five of any, four by a seeded draw."""
    x = events(spark, sf_dir).groupBy("event_type", "frame").agg(F.max("value").alias("top"))
    falling, random = [(F.col("top"), True)], [(selection.drawn(3, "event_type", "frame"), False)]
    phases = [selection.Phase("night", F.col("frame") % 24 < 6, falling, 3), selection.Phase("top", F.lit(True), falling, 5), selection.Phase("random", F.lit(True), random, 4)]
    return selection.spaced(x, ["event_type"], "frame", 12, phases)
