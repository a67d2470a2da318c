"""Where queries over the test tables and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: SQL of the tables that the twins start from.
CTE = {
    "tape": """tape AS (
  SELECT event_id AS seq, raw_ns // 86400000000000 AS day, raw_ns, raw_ns - raw_ns % 1800000000000 AS ts_ns,
         CASE event_type WHEN 'error' THEN 'A' WHEN 'signup' THEN 'C' ELSE 'T' END AS action,
         CASE event_type WHEN 'purchase' THEN 'B' WHEN 'click' THEN 'A' ELSE 'N' END AS side,
         floor(value)::BIGINT + 1 AS size,
         CASE WHEN value >= 1 THEN floor(value)::BIGINT * 10000000 END AS bid,
         CASE WHEN value >= 1 THEN floor(value)::BIGINT * 10000000 + 10000000 END AS ask,
         event_type, value, (raw_ns - (raw_ns // 86400000000000) * 86400000000000) / 1e9 AS t
  FROM (SELECT *, epoch_us(ts) * 1000 AS raw_ns FROM events))""",
    "exe": """exe AS (
  SELECT *, CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS sgn FROM tape WHERE action = 'T')""",
    "grp": """chained AS (
  SELECT *, sum(CASE WHEN gap <= {merge} THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY ts_ns, seq) AS chain
  FROM (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY day ORDER BY ts_ns, seq) AS gap FROM exe {only})),
held AS (
  SELECT *, last_value(nullif(sgn, 0) IGNORE NULLS) OVER (PARTITION BY day, chain ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps,
         row_number() OVER (PARTITION BY day, chain ORDER BY ts_ns, seq) AS rn FROM chained),
grp AS (
  SELECT *, sum(CASE WHEN rn = 1 OR (sgn <> 0 AND ps <> sgn) THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts_ns, seq)::BIGINT AS grp FROM held)""",
    "ord": """ord AS (
  SELECT day, grp, min(ts_ns) AS ts_ns, arg_min(seq, ts_ns::HUGEINT * 100000000 + seq) AS seq, sign(sum(sgn))::BIGINT AS side,
         sum(size)::BIGINT AS size, count(*) AS n_fills FROM grp GROUP BY day, grp)""",
    "stream": """stream AS (
  SELECT *, (out_ns - day * 86400000000000) / 1e9 AS ts FROM (
    SELECT *, rn + max(ts_ns - rn) OVER (PARTITION BY day ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS out_ns
    FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts_ns, seq) AS rn FROM ord)))""",
    "ends": """ends AS (
  SELECT * FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY day ORDER BY ts_ns, seq) AS after FROM tape) WHERE after IS NULL OR after > ts_ns)""",
    "mids": """mids AS (
  SELECT * FROM (SELECT *, bid + ask - lag(bid + ask) OVER (PARTITION BY day ORDER BY ts_ns, seq) AS change
                 FROM ends WHERE bid > 0 AND ask > 0) WHERE change <> 0)""",
    "metric": """listed AS (
  SELECT event_type AS model, day, t, size,
         unnest(range(greatest(0, floor((t - 21600) / 10800)::BIGINT + 1), least(6, floor(t / 10800)::BIGINT) + 1)) AS k FROM tape),
metric AS (
  SELECT model, day, k, k * 10800e0 AS t0, k * 10800e0 + 21600e0 AS t1, k * 10800e0 + 10800e0 AS t_mid, count(*) AS n_events,
         sum(size)::BIGINT / (count(*) * 997e0) AS est, stddev_samp(size) / 1e3 AS boot_sd FROM listed GROUP BY model, day, k)""",
    "period": """period AS (
  SELECT *, CASE WHEN t_mid < 32400 THEN 'morning' WHEN t_mid < 43200 THEN 'pre' WHEN t_mid < 54000 THEN 'statement'
                 WHEN t_mid < 64800 THEN 'press' ELSE 'close' END AS period FROM metric WHERE t_mid >= 0 AND t_mid < 86400)""",
    "pairs": """pairs AS (
  SELECT * FROM (VALUES ('statement', 'morning'), ('press', 'morning'), ('statement', 'pre'), ('press', 'statement'), ('close', 'morning')) AS p(a, b))""",
}


def sql(*names: str, body: str, merge: int = 0, only: str = "") -> str:
    return "WITH " + ",\n".join(CTE[n].format(merge=merge, only=only) for n in names) + "\n" + body
