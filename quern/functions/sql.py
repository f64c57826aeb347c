"""The column functions as temporary SQL functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern.functions.keys import DNS, URL
from quern.functions.text import DASHES, IDENTIFIERS, SPACES
from quern.operators.retrieval import BONUS, HOP, ONTOLOGY, SEMANTIC, STRUCTURE
from quern.sources.ontology import weight_sql

_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', cast(conv(substr(h, 17, 1), 16, 10) AS int) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12))"


def register(spark: SparkSession) -> list[str]:
    """norm_text, approx_tokens, uuid5_url, uuid5_dns, cosine_similarity, fusion_score, mil_id_overlap; returns their names."""
    plain = "-" * len(DASHES) + " " * len(SPACES)
    hashed = lambda space: f"sha1(concat(unhex('{space}'), encode(n, 'utf-8')))"
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, t) -> s + t)"
    decay = f"pow({HOP}D, greatest(coalesce(hops, 1) - 1, 0))"
    fused = f"({SEMANTIC}D * coalesce(sem, 0D) + {STRUCTURE}D * greatest(coalesce(link, 0D) * {decay}, coalesce(crossing, 0D)) + CASE WHEN rel IS NULL THEN 0D ELSE {ONTOLOGY}D * ({weight_sql('rel')}) * {decay} END)"
    made = {
        "norm_text(s STRING) RETURNS STRING": f"translate(s, '{DASHES + SPACES}', '{plain}')",
        "approx_tokens(s STRING) RETURNS INT": r"cast(floor(size(filter(split(s, '[ \\t\\r\\n\\f]+'), w -> w <> '')) * 1.3D) AS INT)",
        "uuid5_url(n STRING) RETURNS STRING": _UUID.replace("(h,", f"({hashed(URL)},"),
        "uuid5_dns(n STRING) RETURNS STRING": _UUID.replace("(h,", f"({hashed(DNS)},"),
        "cosine_similarity(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN size(x) = size(y) THEN try_divide({dot('x', 'y')}, sqrt({dot('x', 'x')} * {dot('y', 'y')})) END",
        "fusion_score(sem DOUBLE, link DOUBLE, crossing DOUBLE, rel STRING, hops INT, bonus BOOLEAN) RETURNS DOUBLE": f"round(CASE WHEN coalesce(bonus, false) THEN least({fused} + {BONUS}D, 1D) ELSE {fused} END, 6)",
        "mil_id_overlap(x STRING, y STRING) RETURNS BOOLEAN": " OR ".join(f"coalesce(arrays_overlap(regexp_extract_all(x, r'{p}', 0), regexp_extract_all(y, r'{p}', 0)), false)" for p in IDENTIFIERS),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
