"""The canonical views again, as SQL text for the oracle."""

from __future__ import annotations

import re

_SITES = {
    "user": "CAST(user_id + 1 AS INTEGER)",
    "kind": (
        "CAST(list_position((SELECT list_sort(list(DISTINCT event_type)) FROM events), "
        "event_type) AS INTEGER)"
    ),
}

_VIEWS = {
    "cents": """
        SELECT {site} AS site, date_trunc('hour', ts) AS date,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS c
        FROM events GROUP BY 1, 2""",
    "obs_sparse": """
        SELECT site, date, floor(c / CAST((SELECT max(c) FROM cents) AS DOUBLE) * 1e6 + 5e-1) / 1e6 AS power
        FROM cents""",
    "grid": """
        SELECT s.site, g.date
        FROM (SELECT DISTINCT site FROM obs_sparse) s,
             (SELECT unnest(generate_series((SELECT min(date) FROM obs_sparse),
                                            (SELECT max(date) FROM obs_sparse),
                                            INTERVAL 1 HOUR)) AS date) g""",
    "obs": """
        SELECT site, date, coalesce(power, 0e0) AS power,
               NOT (datediff('hour', TIMESTAMP '2024-01-01', date) - 1 >= 168
                    AND (datediff('hour', TIMESTAMP '2024-01-01', date) - 1) % 168 >= 120) AS flag
        FROM grid LEFT JOIN obs_sparse USING (site, date)""",
    "obs_masked": "SELECT site, date, CASE WHEN flag THEN power END AS power, flag FROM obs",
    "truth": "SELECT site, date, power FROM obs WHERE NOT flag",
    "obs_wide": """
        SELECT date, max(power) FILTER (site = 1) AS wp1, max(power) FILTER (site = 2) AS wp2,
               max(power) FILTER (site = 3) AS wp3, max(power) FILTER (site = 4) AS wp4,
               max(power) FILTER (site = 5) AS wp5
        FROM obs GROUP BY date""",
    "issued": """
        SELECT o.site, s.start, CAST(datediff('hour', s.start, o.date) AS INTEGER) AS dist,
               o.date AS new_date, datediff('hour', TIMESTAMP '2024-01-01', o.date) AS h, o.power
        FROM obs o JOIN (
            SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT max(date) FROM obs),
                                          INTERVAL 12 HOUR)) AS start) s
          ON o.date > s.start AND o.date <= s.start + INTERVAL 48 HOUR""",
    "polar": """
        SELECT site, start, dist, new_date,
               floor((25e0 * sqrt(power) + 2e-2 * dist) * 1e6 + 5e-1) / 1e6 AS ws,
               CAST((h * 37 + site * 61) % 360 AS DOUBLE) + 5e-1 AS wd
        FROM issued""",
    "runs": """
        SELECT site, start, dist, new_date, floor(ws * sin(radians(wd)) * 1e6 + 5e-1) / 1e6 AS u,
               floor(ws * cos(radians(wd)) * 1e6 + 5e-1) / 1e6 AS v, ws, wd
        FROM polar""",
    "features": """
        SELECT o.site, o.date, r.start, r.dist, CAST(ceil(r.dist / 12e0) AS INTEGER) AS catagory,
               o.flag, o.power, r.u, r.v, r.ws, r.wd,
               least(1e0, r.ws * r.ws / 625e0) AS ws_power
        FROM obs o JOIN runs r ON r.site = o.site AND r.new_date = o.date""",
    "quantiles": """
        SELECT site, date, power,
               NOT (datediff('hour', TIMESTAMP '2024-01-01', date) - 1 >= 168
                    AND (datediff('hour', TIMESTAMP '2024-01-01', date) - 1) % 168 >= 120) AS flag,
               [floor((power + (k - 50) / 100e0 + ((k * 7) % 5 - 2) / 50e0) * 1e6 + 5e-1) / 1e6
                FOR k IN range(1, 100)] AS q
        FROM obs_sparse""",
    "metric_log": """
        SELECT CAST(user_id % 3 AS INTEGER) AS run,
               row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id)
                 AS step,
               event_type AS tag, value
        FROM events""",
}


def _needed(text: str) -> list[str]:
    seen: list[str] = []

    def visit(part: str) -> None:
        for name in _VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", part):
                visit(_VIEWS[name])
                if name not in seen:
                    seen.append(name)

    visit(text)
    return [name for name in _VIEWS if name in seen]


def with_views(body: str, by: str = "user") -> str:
    """Prefixes ``body`` with the views it names. A body may bring more CTEs of its own by
    starting with ``WITH``. Every view is made once, however often it is named."""
    ctes = [
        f"{name} AS MATERIALIZED ({_VIEWS[name].format(site=_SITES[by])})" for name in _needed(body)
    ]
    body = body.strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if re.match(r"(?i)with\b", body):
        return head + ",\n" + body[4:]
    return head + "\n" + body
