"""Deterministic identifiers as column functions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name spaces of RFC 9562.
URL = "6ba7b8119dad11d180b400c04fd430c8"
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def dashed(h: Column) -> Column:
    """32 hexadecimal digits in the form of a UUID."""
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def element_uid(page: Column, order: Column, kind: Column, text: Column) -> Column:
    """page-order-type-digest of an element; a null page is 0, a null text empty."""
    return F.concat_ws("-", F.coalesce(page, F.lit(0)).cast("string"), order.cast("string"), kind, F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(8)))


def artifact_id(document: Column, uid: Column) -> Column:
    return uuid5(F.concat_ws(":", document, uid))


def chunk_id(document: Column, uids: Column, index: Column, model: Column) -> Column:
    """Identifier of a chunk by its elements, place and embedding model."""
    return dashed(F.md5(F.sha2(F.concat_ws(":", document, F.array_join(uids, "|"), index.cast("string"), model), 256)))


def element_hash(document: Column, uid: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", document, uid, F.coalesce(text, F.lit(""))), 256)


def trusted_point_id(submission: Column) -> Column:
    return uuid5(F.concat(F.lit("trusted:"), submission), DNS)


def image_chunk_id(document: Column, uid: Column, model: Column) -> Column:
    """Identifier of an image's chunk by its element and embedding model."""
    return dashed(F.md5(F.sha2(F.concat_ws(":", document, uid, model), 256)))


def section_chunk_id(document: Column, uid: Column, section: Column, model: Column) -> Column:
    """Identifier of a section of an image's description."""
    return dashed(F.md5(F.sha2(F.concat_ws(":", document, uid, section.cast("string"), model), 256)))


def legacy_uid(index: Column, kind: Column, text: Column) -> Column:
    """legacy-index-type-digest of an element that a plain extractor found."""
    return F.concat_ws("-", F.lit("legacy"), index.cast("string"), kind, F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(8)))
