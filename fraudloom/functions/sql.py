"""UD4: the scalar functions as SQL temporary functions (inlined expressions, no Python)."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .fixed_values import PAN_HOLDERS, PAN_SHAPE
from .identity import DIHEDRAL, PERMUTED


def register_sql_functions(spark: SparkSession) -> list[str]:
    d, p = (f"array({', '.join(map(str, t))})" for t in (DIHEDRAL, PERMUTED))
    holders = ", ".join(f"'{h}'" for h in PAN_HOLDERS)
    digits = "filter(split(reverse(regexp_replace(num, '[^0-9]', '')), ''), x -> x <> '')"
    half = lambda c, at: f"CAST(conv(substring({c}, {at}, 8), 16, 10) AS BIGINT)"
    bits = lambda c: f"(shiftleft({half(c, 1)}, 32) | {half(c, 9)})"
    hexed = lambda c: f"{c} RLIKE '^[0-9a-fA-F]{{16}}$'"
    functions = {
        "pan_shape_ok(pan STRING) RETURNS BOOLEAN": f"coalesce(pan RLIKE '^{PAN_SHAPE}$' AND substring(pan, 4, 1) IN ({holders}), false)",
        "verhoeff_ok(num STRING) RETURNS BOOLEAN": (
            "CASE WHEN regexp_replace(num, '[^0-9]', '') RLIKE '^[2-9][0-9]{11}$' THEN "
            f"aggregate(transform({digits}, (x, i) -> get({p}, (i % 8) * 10 + CAST(x AS INT))), 0, (c, x) -> get({d}, c * 10 + x)) = 0 ELSE false END"
        ),
        "hamming64(a STRING, b STRING) RETURNS INT": f"CASE WHEN {hexed('a')} AND {hexed('b')} THEN bit_count({bits('a')} ^ {bits('b')}) ELSE 64 END",
        "decide(score DOUBLE, review DOUBLE, reject DOUBLE, band DOUBLE) RETURNS STRING": (
            "CASE WHEN score >= reject + greatest(0, band) THEN 'REJECT' WHEN score >= reject THEN 'REVIEW' "
            "WHEN score >= review THEN 'REVIEW' WHEN score > review - greatest(0, band) THEN 'REVIEW' ELSE 'PASS' END"
        ),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in functions]
