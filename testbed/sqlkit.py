"""Pieces of DuckDB SQL the check queries share."""

from __future__ import annotations

from .views import duckdb_with


def rx(x: str, n: int) -> str:
    """Half-even rounding of the exact binary value, spelled out."""
    m = f"{10 ** n}e0"
    hi = f"(({x})*134217729e0-(({x})*134217729e0-({x})))"
    p, e = f"(({x})*{m})", f"(({hi}*{m}-({x})*{m})+(({x})-{hi})*{m})"
    f = f"floor({p})"
    return (f"((CASE WHEN {p}-{f} > 5e-1 OR ({p}-{f} = 5e-1 AND ({e} > 0 OR ({e} = 0 AND "
            f"abs({f} % 2) = 1))) THEN {f} + 1 ELSE {f} END + 0e0) / {m})")


ACC = """acc AS (
  SELECT unit_id, COALESCE(MAX(h), 1e0) AS acc_h, COALESCE(MAX(v), 1e0) AS acc_v,
         COUNT(h) = ANY_VALUE(n) AS acc_known
  FROM (SELECT u.unit_id, u.n, s.acc_h AS h, s.acc_v AS v
        FROM (SELECT unit_id, UNNEST(source_ids) AS sid, len(source_ids) AS n FROM unit) u
        LEFT JOIN source s ON s.source_id = u.sid AND s.acc_h IS NOT NULL) GROUP BY unit_id),
 eu AS (SELECT unit.*, acc_h, acc_v, acc_known FROM unit JOIN acc USING (unit_id))"""


def register(*more: str) -> str:
    return duckdb_with("unit", "source", *more) + ",\n" + ACC


#: area two rectangles a, b share, and their tolerances
SHARED = ("(greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0e0)"
          "*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0e0))")
COMMON_BOX = ("greatest(a.x0, b.x0) AS wx0, greatest(a.y0, b.y0) AS wy0, "
              "least(a.x1, b.x1) AS wx1, least(a.y1, b.y1) AS wy1")
TH = "sqrt(a.acc_h*a.acc_h+b.acc_h*b.acc_h)"
TV = "sqrt(a.acc_v*a.acc_v+b.acc_v*b.acc_v)"


def beyond(c: str, end: str) -> str:
    """Side of the box of what rectangle e has outside rectangle q: q hides e's side along `c` only
    where it spans e in the other direction and passes that side."""
    o = "y" if c == "x" else "x"
    spans = f"q{o}0 <= e{o}0 AND q{o}1 >= e{o}1 AND q{c}0 < e{c}1 AND q{c}1 > e{c}0"
    hides = f"q{c}0 <= e{c}0" if end == "0" else f"q{c}1 >= e{c}1"
    other = f"q{c}1" if end == "0" else f"q{c}0"
    return f"CASE WHEN {spans} AND {hides} THEN {other} ELSE e{c}{end} END"


def eroded(t: str) -> str:
    """Eroded rectangles a, b meet; one that vanishes counts whole."""
    def d(s):
        return (f"(CASE WHEN {s}.x1-{s}.x0 <= 2*{t} OR {s}.y1-{s}.y0 <= 2*{t} THEN 0e0 "
                f"ELSE {t} END)")
    return " AND ".join(
        f"a.{c}0+{d('a')} <= b.{c}1-{d('b')} AND b.{c}0+{d('b')} <= a.{c}1-{d('a')}"
        for c in "xy")


ZOVER = ("greatest(a.lower_limit,b.lower_limit) < least(a.upper_limit,b.upper_limit) - {tv} "
         "AND a.lower_limit IS NOT NULL AND a.upper_limit IS NOT NULL "
         "AND b.lower_limit IS NOT NULL AND b.upper_limit IS NOT NULL")

CHECK_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_char(body: str) -> str:
    digits = f"list_transform(string_split({body}, ''), lambda c: instr('{CHECK_ALPHABET}', c) - 1)"
    fold = (f"list_reduce(list_prepend(36::BIGINT, {digits}), lambda p, i: "
            "((CASE WHEN ((p % 37) + i) % 36 = 0 THEN 36 ELSE ((p % 37) + i) % 36 END) * 2) % 37)")
    return f"substr('{CHECK_ALPHABET}', CAST((37 - {fold}) % 36 + 1 AS INT), 1)"


def identifier(parent: str, stratum: str, level: str, seq: str) -> str:
    lv, sq = f"lpad(CAST({level} AS STRING),2,'0')", f"lpad(CAST({seq} AS STRING),3,'0')"
    body = f"upper({parent})||'V1'||{stratum}||{lv}||{sq}"
    return (f"upper({parent})||'-V1-'||{stratum}||{lv}||'-'||{sq}||'-'||{check_char(body)}")


#: floors of one building, consecutive by index
STACK = f"""stack AS (
  SELECT f.unit_id, f.lower_limit, f.acc_v, LAG(f.unit_id) OVER w AS below,
         LAG(f.upper_limit) OVER w AS below_top, LAG(f.acc_v) OVER w AS below_acc
  FROM eu f WHERE f.unit_type = 'floor'
  WINDOW w AS (PARTITION BY f.parent_id ORDER BY f.floor_index, f.ord)),
 gap AS (SELECT unit_id, below, abs(lower_limit-below_top) AS d,
                sqrt(acc_v*acc_v+below_acc*below_acc) AS tol FROM stack
         WHERE abs(lower_limit-below_top) > sqrt(acc_v*acc_v+below_acc*below_acc))"""

#: the six rules the testbed keeps as a stored run
FINDING = f"""{STACK},
 finding0 AS (
  SELECT 'Z_IMPOSSIBLE' AS rule_id, 'error' AS severity, unit_id, '' AS related
  FROM eu WHERE lower_limit >= upper_limit
  UNION ALL SELECT 'HEIGHTS_UNAVAILABLE', 'error', unit_id, '' FROM eu
  WHERE lower_limit IS NULL OR upper_limit IS NULL
  UNION ALL SELECT 'PROVENANCE_MISSING', 'info', unit_id, '' FROM eu WHERE NOT acc_known
  UNION ALL SELECT 'CONFIDENCE_LOW', 'warning', unit_id, '' FROM eu
  WHERE created_by = 'ai' AND confidence_score < 6e-1
  UNION ALL SELECT 'FLOOR_SEQUENCE', 'error', unit_id, below FROM gap
  UNION ALL SELECT 'FLOOR_HEIGHT_IMPLAUSIBLE', 'warning', unit_id, '' FROM eu
  WHERE unit_type = 'floor' AND NOT (upper_limit-lower_limit BETWEEN 24e-1 AND 5e0)),
 finding AS (SELECT *, CASE WHEN severity = 'warning' AND length(unit_id) % 2 = 0
                            THEN 'reviewer' END AS acknowledged_by FROM finding0),
 named AS (SELECT rule_id, severity, acknowledged_by, unit_id AS named FROM finding
           UNION ALL SELECT rule_id, severity, acknowledged_by, related FROM finding
           WHERE related <> '')"""


def with_findings(*more: str) -> str:
    return register(*more) + ",\n" + FINDING
