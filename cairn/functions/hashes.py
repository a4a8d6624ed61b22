"""Digests and the spelling of hashes.

A hash is 64 hex digits. Letter case, white space and `/` inside the text are not part of it. Null, all-zero and anything
that is not 64 hex digits after that is no hash and becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0" * 64
#: The characters that a spelling may carry beside hex digits (white space and the path separator).
IGNORED = "/ \t\n\r\f\v\u0085                 　"


def _plain(text: Column) -> tuple[Column, Column]:
    """The text without ignored characters, and whether it is a hash then. Most texts have 64 characters and go to the
    check as they are; decoding is the cheapest test for hex digits."""
    plain = F.when(F.length(text) == 64, text).otherwise(F.translate(text, IGNORED, ""))
    return plain, (F.length(plain) == 64) & (F.unhex(plain) != F.lit(bytes(32)))


def clean_hash(text: Column) -> Column:
    """Lower-case 64-digit form of a spelled hash, null where it is no hash."""
    plain, good = _plain(text)
    return F.when(good, F.lower(plain))


def hash_bytes(text: Column) -> Column:
    """32-byte form of a spelled hash: half the width of its text, for join keys."""
    plain, good = _plain(text)
    return F.when(good, F.unhex(plain))


def bytes_text(key: Column) -> Column:
    return F.lower(F.hex(key))


def digest(data: Column) -> Column:
    """Content digest, 64 hex digits. SHA-256: built in, whole-stage compiled."""
    return F.sha2(data, 256)


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def hash_path(text: Column, prefix: str = "") -> Column:
    """Sharded object path `ab/cdef...`, under a prefix such as `chunks/`."""
    return F.concat(F.lit(prefix), F.substring(text, 1, 2), F.lit("/"), F.substring(text, 3, 62))


def path_hash(path: Column, prefix: str = "") -> Column:
    """Inverse of hash_path; null where the path has another form."""
    found = F.regexp_extract(path, rf"\A{prefix}([0-9a-f]{{2}})/[0-9a-f]{{62}}\z", 1)
    return F.when(found != "", F.concat(found, F.right(path, F.lit(62))))


def merkle_hash(chunk_hashes: Column) -> Column:
    """File digest: digest of the concatenated chunk digests, in order."""
    joined = F.aggregate(chunk_hashes, F.lit(b"").cast("binary"), lambda done, x: F.concat(done, F.unhex(x)))
    return digest(joined)
