"""The engine's functions for SQL: temporary functions of a session, defined in SQL, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import constants as C

_STRIP = r"regexp_replace({}, '(?U)^\\s+|\\s+\\z', '')"

#: Signature: body. Scalars first, then functions that give a table (for ``LATERAL``).
FUNCTIONS = {
    "quill_squeeze(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '(?U)\\s+', ' '))",
    "quill_language(t STRING) RETURNS STRING": (
        rf"(SELECT CASE WHEN coalesce(length({_STRIP.format('t')}), 0) = 0 THEN 'en' WHEN ar >= 3 AND la >= 3 THEN 'mixed' WHEN ar > 0 AND la > 0 THEN IF(ar >= la, 'ar', 'en') WHEN ar > 0 THEN 'ar' ELSE 'en' END "
        rf"FROM (SELECT regexp_count(t, '[{C.ARABIC}]') AS ar, regexp_count(t, '[A-Za-z]') AS la))"
    ),
    "quill_direction(t STRING) RETURNS STRING": rf"IF(length(t) > 0 AND regexp_count(t, '[{C.ARABIC}]') / length(t) > 0.3, 'rtl', 'ltr')",
    "quill_truncated(t STRING, most INT) RETURNS STRING": r"IF(length(t) > most, concat(left(t, most), '\n… [truncated]'), t)",
    "quill_idf(n BIGINT, df BIGINT) RETURNS DOUBLE": "log1p(greatest(0.0D, (n - df + 0.5D) / (df + 0.5D)))",
    "quill_saturation(tf BIGINT, dl BIGINT, avgdl DOUBLE) RETURNS DOUBLE": "tf * 2.5D / greatest(tf + 1.5D * (0.25D + 0.75D * greatest(dl, 1) / greatest(avgdl, 1e-9D)), 1e-9D)",
    "quill_rrf(place BIGINT) RETURNS DOUBLE": "1.0D / (60 + place)",
    "quill_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "IF(size(a) > 0 AND size(b) > 0, size(array_intersect(a, b)) / sqrt(CAST(size(array_distinct(a)) AS DOUBLE) * size(array_distinct(b))), 0.0D)",
    "quill_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)",
    "quill_page_label(first INT, last INT) RETURNS STRING": "CASE WHEN coalesce(first, 0) <> 0 AND coalesce(last, 0) NOT IN (0, first) THEN concat('Pages ', first, '-', last) WHEN coalesce(first, 0) <> 0 THEN concat('Page ', first) ELSE 'Page ?' END",
    "quill_sentences(t STRING) RETURNS TABLE (pos INT, sentence STRING)": (
        rf"SELECT pos, col FROM (SELECT posexplode(filter(transform(split(t, '(?U)(?<=[.!?؟۔])\\s+|\\n\\s*\\n'), s -> {_STRIP.format('s')}), s -> s <> '')))"
    ),
    "quill_pages(t STRING, size INT) RETURNS TABLE (page INT, content STRING)": "SELECT pos + 1, col FROM (SELECT posexplode(transform(sequence(0, greatest(0, (length(t) - 1) div size)), i -> substr(t, i * size + 1, size)))) WHERE length(t) > 0",
}


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in a session; their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
