"""The staged flow from a request to its subtitle, for every request, and its SQL, which replays the same rules stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing
from .registry import PLAIN, RANKED, SQL, adapter, query

BAR, ACTIVITY_BAR = 58, 70
COLUMNS = ", ".join(routing.CANDIDATE)


def asked(d) -> str:
    return f"""SELECT p_partkey AS release, p_partkey % 10 = 0 AS cached, p_partkey % 6 = 1 AS spoken, p_partkey % 8 = 2 AS asked,
      CASE p_partkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'manual' ELSE 'auto' END AS mode, p_partkey % 5 > 0 AS translation_settles FROM {d.table("part")}"""


def tracks(d) -> str:
    """The tracks that catalogues offer for a request, in three roles, best names first."""
    role = "CASE WHEN l_linenumber IN (1, 2, 4, 7) THEN 'source' WHEN l_linenumber = 6 THEN 'fallback' ELSE 'target' END"
    return f"""SELECT l_partkey AS release, {role} AS role, row_number() OVER (PARTITION BY l_partkey, {role} ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS position,
      CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS candidate, 'c' || CAST(l_orderkey % 23 AS STRING) AS content, 'catalogue' || CAST(l_suppkey % 3 AS STRING) AS provider,
      CAST(l_quantity AS INT) + 20 AS score, CAST(floor((l_orderkey * 37 + l_linenumber * 11) % 101 * 3 / 4.0) AS INT) AS confidence, l_orderkey % 7 > 0 AS settles FROM {d.table("lineitem")}"""


def best(name: str, rows: str, bar: int, most: int = 10) -> str:
    """CTEs whose last one, `name`, has the position that a search in waves through the first `most` of `rows` ends with, its wave and its seat."""
    return f"""{name}_l AS (SELECT release, list({{'k': position, 'p': provider, 's': score, 'c': confidence}} ORDER BY position)[1:{most}] AS rem FROM {rows} GROUP BY release),
{name}_r AS (SELECT release, rem, []::STRUCT(k BIGINT, s INT, c INT, w INT, seat INT)[] AS acc, 0 AS waves, 0 AS d FROM {name}_l UNION ALL
  SELECT release, list_filter(rem, lambda x: NOT list_contains(wave, x)), got, CASE WHEN len(got) > 0 THEN waves + 1 ELSE 0 END, d + 1 FROM (SELECT *, acc || list_filter(list_transform(wave, lambda x, i: {{'k': x.k::BIGINT, 's': x.s::INT, 'c': x.c::INT, 'w': d, 'seat': (i - 1)::INT}}), lambda x: x.c >= {bar}) AS got FROM (SELECT *, firsts || others[1:3 - len(firsts)] AS wave
    FROM (SELECT *, list_filter(rem, lambda x: NOT list_contains(firsts, x)) AS others FROM (SELECT *, list_filter(rem, lambda x, i: list_position(list_transform(rem, lambda y: y.p), x.p) = i)[1:3] AS firsts FROM {name}_r
    WHERE len(rem) > 0 AND waves < 2 AND NOT (waves = 1 AND list_max(list_transform(acc, lambda x: x.c)) >= least(90, {bar} + 15))))))),
{name} AS (SELECT release, x.k AS position, x.w AS wave, x.seat AS seat FROM (SELECT release, unnest(acc) AS x, generate_subscripts(acc, 1) AS o FROM (SELECT release, arg_max(acc, d) AS acc FROM {name}_r GROUP BY release))
  QUALIFY row_number() OVER (PARTITION BY release ORDER BY 0.82::DOUBLE * x.c + 0.18::DOUBLE * x.s DESC, o) = 1)"""


def versus(chosen: str) -> str:
    return f"SELECT t.* REPLACE (CAST((r.position * 13 + t.position * 29 + t.release * 7) % 101 * 3 // 5 AS INT) AS confidence), r.confidence AS vouched FROM tgt t JOIN {chosen} r USING (release)"


def complete_sql() -> str:
    parts = [f"rq AS ({asked(PLAIN)}), tr AS ({tracks(PLAIN)})"]
    parts += [f"{n} AS (SELECT {COLUMNS} FROM tr WHERE role = '{role}')" for n, role in (("src", "source"), ("tgt", "target"), ("fb", "fallback"))]
    parts.append("open1 AS (SELECT release, spoken FROM rq WHERE NOT cached AND NOT asked)")
    done, left = ["SELECT release, 'cached' AS outcome, NULL AS route, NULL AS candidate, NULL AS confidence, 0 AS attempts, NULL AS reason FROM rq WHERE cached"], []
    for k in range(1, 6):
        barred = "".join(f" AND NOT EXISTS (SELECT 1 FROM win{j} w WHERE w.release = s.release AND (w.candidate = s.candidate OR w.content = s.content))" for j in range(1, k))
        parts += [f"cand{k} AS (SELECT s.* FROM src s JOIN open{k} USING (release) WHERE true{barred})", best(f"e{k}", f"cand{k}", BAR)]
        parts += [f"win{k} AS (SELECT c.*, spoken FROM cand{k} c JOIN e{k} USING (release, position) JOIN open{k} USING (release))", f"rest{k} AS (SELECT * FROM win{k} WHERE NOT (spoken AND settles))"]
        parts += [f"vs{k} AS ({versus(f'rest{k}')})", best(f"t{k}", f"vs{k}", BAR), f"fit{k} AS (SELECT v.* FROM vs{k} v JOIN t{k} USING (release, position) WHERE settles)"]
        parts += [f"open{k + 1} AS (SELECT release, spoken FROM rest{k} WHERE release NOT IN (SELECT release FROM fit{k}))"]
        done += [f"SELECT release, 'direct', 'source', candidate, confidence, {k}, NULL FROM win{k} WHERE spoken AND settles", f"SELECT release, 'direct', 'source', candidate, least(confidence, vouched), {k}, NULL FROM fit{k}"]
        left.append(f"SELECT release, {k - 1} AS attempts FROM open{k} WHERE release NOT IN (SELECT release FROM win{k})")
    parts.append(f"un AS ({' UNION ALL '.join([*left, 'SELECT release, 5 FROM open6'])})")
    parts += ["fbu AS (SELECT fb.* FROM fb SEMI JOIN un USING (release))", best("fe", "fbu", ACTIVITY_BAR), "ref AS (SELECT fbu.* FROM fbu JOIN fe USING (release, position))"]
    parts += [f"vr AS ({versus('ref')})", best("ft", "vr", BAR), "mat AS (SELECT vr.*, attempts FROM vr JOIN ft USING (release, position) JOIN un USING (release))"]
    parts.append("heard AS (SELECT un.*, attempts > 0 OR release IN (SELECT release FROM ref) AS trusted FROM un WHERE release NOT IN (SELECT release FROM mat))")
    parts += ["ta AS (SELECT tgt.* FROM tgt JOIN heard USING (release) WHERE trusted)", best("ae", "ta", max(75, ACTIVITY_BAR + 5)), "tl AS (SELECT tgt.* FROM tgt JOIN heard USING (release) WHERE NOT trusted)", best("le", "tl", ACTIVITY_BAR)]
    parts.append("aud AS (SELECT * FROM (SELECT ta.*, least(confidence, score + 35) AS sure FROM ta JOIN ae USING (release, position) WHERE score >= 35 UNION ALL SELECT tl.*, confidence FROM tl JOIN le USING (release, position)) JOIN un USING (release) WHERE settles)")
    done += ["SELECT release, 'direct', 'reference', candidate, least(confidence, vouched), attempts, NULL FROM mat WHERE settles", "SELECT release, 'direct', 'audio', candidate, sure, attempts, NULL FROM aud"]
    parts.append("late AS (SELECT release, attempts FROM un WHERE release NOT IN (SELECT release FROM mat WHERE settles) AND release NOT IN (SELECT release FROM aud) UNION ALL SELECT release, 0 FROM rq WHERE NOT cached AND asked)")
    parts += ["sl AS (SELECT src.* FROM src SEMI JOIN late USING (release))", best("se", "sl", BAR)]
    parts.append("""fin AS (SELECT l.release, attempts, candidate, confidence, CASE WHEN candidate IS NULL THEN 'no source matched' WHEN mode = 'off' OR (mode = 'manual' AND NOT asked) THEN 'translation not requested' WHEN spoken THEN 'same language' WHEN NOT translation_settles THEN 'translation off the speech' END AS why
      FROM late l JOIN rq USING (release) LEFT JOIN (SELECT sl.* FROM sl JOIN se USING (release, position)) USING (release))""")
    done += ["SELECT release, 'translated', 'source', candidate, confidence, attempts, NULL FROM fin WHERE why IS NULL", "SELECT release, 'failed', NULL, NULL, NULL, attempts, why FROM fin WHERE why IS NOT NULL"]
    whole = " UNION ALL ".join(done)
    return f"WITH RECURSIVE {', '.join(parts)} SELECT release, outcome, coalesce(route, '') AS route, coalesce(candidate, '') AS candidate, CAST(coalesce(confidence, -1) AS INT) AS confidence, CAST(attempts AS INT) AS attempts, coalesce(reason, '') AS reason FROM ({whole})"


@query("P1_complete", complete_sql())
def completed(spark, sf_dir):
    """What comes of every request, by which route, after how many sources, or why not."""
    found = adapter(spark, sf_dir, tracks).persist()
    of = lambda role: found.where(F.col("role") == role).select(routing.CANDIDATE)

    def against(chosen, targets):
        both = targets.join(chosen.select("release", F.col("position").alias("place")), "release")
        told = F.floor((F.col("place") * 13 + F.col("position") * 29 + F.col("release") * 7) % 101 * 3 / 5).cast("int")
        return both.withColumn("confidence", told).select(routing.CANDIDATE)

    out = routing.complete(adapter(spark, sf_dir, asked), of("source"), of("target"), of("fallback"), against, BAR, ACTIVITY_BAR)
    return out.fillna({"route": "", "candidate": "", "confidence": -1, "reason": ""})


WON = f"""WITH RECURSIVE rk AS (SELECT request_id AS release, request_id, provider, provider_id, score, position, CAST((ordinal * 37 + request_id * 11) % 101 AS INT) AS confidence FROM ({RANKED} SELECT * FROM ranked)), {best("b", "rk", BAR, 10**6)}
SELECT request_id, provider, provider_id, score, confidence, wave, seat FROM rk JOIN b USING (release, position)"""
SQL["R8_select_winner"] = WON
