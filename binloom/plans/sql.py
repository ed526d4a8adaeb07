"""Common table expressions of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from binloom.params import MARKS
from binloom.plans.adapters import EPOCH, MARK_RULES, SEGMENT_LEN


def r6(expr: str) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def day(column: str) -> str:
    return f"CAST(date_diff('day', DATE '{EPOCH}', CAST({column} AS DATE)) AS BIGINT)"


def stage(column: str) -> str:
    return f"(['d0','d7','d15'])[{column} % 3 + 1]"


_FLAGS = ", ".join(
    f"max(CASE WHEN {rule} THEN 1 ELSE 0 END) AS {m}" for m, rule in zip(MARKS, MARK_RULES)
)
_ZERO = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MARKS)
_MARK_ROWS = " UNION ALL ".join(
    f"SELECT chrom, stage, bin, '{m}' AS mark, {m} AS v FROM bins" for m in MARKS
)

CTES = {
    "cells": f"""cells AS (SELECT 'chr' || l_suppkey AS chrom, {stage('l_orderkey')} AS stage,
        CAST(floor({day('l_shipdate')} / 7.0) AS BIGINT) AS bin, {_FLAGS}
        FROM lineitem GROUP BY 1, 2, 3)""",
    "bins": f"""bins AS (SELECT g.chrom, g.stage, g.bin, {_ZERO} FROM
        (SELECT 'chr' || s_suppkey AS chrom, unnest(['d0','d7','d15']) AS stage FROM supplier) s
        CROSS JOIN (SELECT unnest(range(0, (SELECT max(bin) + 1 FROM cells))) AS bin) b
        CROSS JOIN LATERAL (SELECT s.chrom AS chrom, s.stage AS stage, CAST(b.bin AS BIGINT) AS bin) g
        LEFT JOIN cells c ON c.chrom = g.chrom AND c.stage = g.stage AND c.bin = g.bin)""",
    "marks": f"marks AS ({_MARK_ROWS})",
    "runs": """runs AS (SELECT stage, chrom, min(bin) AS b0, max(bin) AS b1, count(*) AS len FROM
        (SELECT stage, chrom, bin, bin - row_number() OVER (PARTITION BY stage, chrom ORDER BY bin) AS g
         FROM bins WHERE H3K27me3 = 1) GROUP BY stage, chrom, g)""",
    "segs": """segs AS (SELECT stage, chrom, b0 * 200 AS "start", (b1 + 1) * 200 AS "end", len
        FROM runs WHERE len >= 2)""",
    "longsegs": f"""longsegs AS (SELECT *, chrom || ':' || "start" || ':' || "end" AS name FROM segs
        WHERE len >= {SEGMENT_LEN})""",
    "heads": """heads AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY chrom
        ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS h
        FROM longsegs)""",
    "islands": """islands AS (SELECT *, sum(h) OVER (PARTITION BY chrom ORDER BY "start", "end"
        ROWS UNBOUNDED PRECEDING) AS isl FROM heads)""",
    "merged": """merged AS (SELECT chrom, min("start") AS "start", max("end") AS "end",
        array_to_string(list_sort(list_distinct(list(stage))), '_') AS time_points,
        count(*) AS n_members, chrom || ':' || min("start") || ':' || max("end") AS peak
        FROM islands GROUP BY chrom, isl)""",
    "tiles": """tiles AS (SELECT chrom, peak, "start" AS s, "end" AS e, unnest(range(1, 1 + pieces)) AS i,
        pieces, w FROM (SELECT *, CASE WHEN w <= 4000 THEN 1
          WHEN w - (CAST(ceil(w / 2000.0) AS BIGINT) - 1) * 2000 < 1000
            AND ceil(w / 2000.0) > 1 THEN CAST(ceil(w / 2000.0) AS BIGINT) - 1
          ELSE CAST(ceil(w / 2000.0) AS BIGINT) END AS pieces
        FROM (SELECT *, "end" - "start" + 1 AS w FROM merged)))""",
    "rois": """rois AS (SELECT chrom, s + (i - 1) * 2000 AS "start",
        CASE WHEN i = pieces THEN e ELSE s + i * 2000 - 1 END AS "end",
        CASE WHEN w > 4000 THEN peak || '_' || i ELSE peak END AS roi FROM tiles)""",
    "roibins": """roibins AS (SELECT r.roi, m.mark, m.stage, m.bin - (r."start" // 200) + 1 AS i,
        CAST(ceil(r."end" / 200.0) AS BIGINT) - (r."start" // 200) AS k, m.v
        FROM rois r JOIN marks m ON m.chrom = r.chrom AND m.bin >= r."start" // 200
        AND m.bin < CAST(ceil(r."end" / 200.0) AS BIGINT))""",
    "spatial": """spatial AS (SELECT roi, mark, stage, avg(v) AS coverage,
        CAST(sum(CASE WHEN v = 1 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS nseg,
        sum(i * v) / nullif(sum(v), 0) / max(k) AS com, avg(abs(v - p)) AS local_var
        FROM (SELECT *, lag(v) OVER (PARTITION BY roi, mark, stage ORDER BY i) AS p FROM roibins)
        GROUP BY roi, mark, stage)""",
    "maxseg": """maxseg AS (SELECT roi, mark, stage, max(n) AS maxseg FROM
        (SELECT roi, mark, stage, g, count(*) AS n FROM (SELECT *, i - row_number() OVER
          (PARTITION BY roi, mark, stage ORDER BY i) AS g FROM roibins WHERE v = 1)
         GROUP BY roi, mark, stage, g) GROUP BY roi, mark, stage)""",
    "regions": f"""regions AS (SELECT o_orderkey AS rid, 'c' || o_custkey AS chrom,
        {day('o_orderdate')} AS "start", {day('last_ship')} AS "end", {stage('o_orderkey')} AS stage,
        o_orderpriority AS cluster FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        WHERE {day('last_ship')} > {day('o_orderdate')})""",
    "points": f"""points AS (SELECT 'c' || o_custkey AS chrom, {day('l_shipdate')} AS pos,
        l_partkey AS gene, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_orderkey,
        l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
}

NEEDS = {
    "bins": ["cells"],
    "marks": ["bins"],
    "runs": ["bins"],
    "segs": ["runs"],
    "longsegs": ["segs"],
    "heads": ["longsegs"],
    "islands": ["heads"],
    "merged": ["islands"],
    "tiles": ["merged"],
    "rois": ["tiles"],
    "roibins": ["rois", "marks"],
    "spatial": ["roibins"],
    "maxseg": ["roibins"],
}

#: Expressions that a twin may read several times; computed once.
SHARED = {"roibins", "spatial", "maxseg"}


def with_ctes(body: str, *names: str, extra: tuple[str, ...] = (), instead: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """``body`` preceded by the named table expressions and all they need.

    ``instead`` gives other expressions, and what those need, for some of the names.
    """
    ordered: list[str] = []
    needs = NEEDS | {name: need for name, (_, need) in (instead or {}).items()}
    texts = CTES | {name: text for name, (text, _) in (instead or {}).items()}

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [texts[n].replace(" AS (", " AS MATERIALIZED (", 1) if n in SHARED else texts[n] for n in ordered] + list(extra)
    return f"WITH {', '.join(parts)} {body}" if parts else body
