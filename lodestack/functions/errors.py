"""Which class of error a response of the storage service is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Child to parent. The names that callers catch.
PARENTS = {
    "ServiceUnavailable": "ApiError", "BadRequest": "ApiError", "NotFound": "ApiError", "Forbidden": "ApiError", "Conflict": "ApiError",
    "InvalidHash": "BadRequest", "ContentHashMismatch": "BadRequest", "ResolveBadRequest": "BadRequest",
    "ResolveNotFound": "NotFound", "BlobNotFound": "NotFound", "LockNotFound": "NotFound", "LockNotOwned": "Forbidden",
    "LockHeldByOther": "Conflict", "RegisterContentNotFound": "Conflict", "RegisterVersionConflict": "Conflict",
}


def error_class(status: Column, operation: Column, detail: Column) -> Column:
    """The class for a status, an operation's name and a detail; null for 2xx.

    Some rules look for words in the detail (in lower case), others at how the
    operation's name begins; the general class of the status comes last.
    """
    text = F.lower(F.coalesce(detail, F.lit("")))
    says = lambda *words: [F.contains(text, F.lit(w)) for w in words]
    of = lambda *names: F.coalesce(operation, F.lit("")).rlike("^(?:" + "|".join(names) + ")")
    hash_, invalid, mismatch, cas, content = says("hash", "invalid", "mismatch", "cas", "content")
    by_status = {
        400: F.when(hash_ & invalid, "InvalidHash").when(mismatch, "ContentHashMismatch").when(of("resolve"), "ResolveBadRequest").otherwise("BadRequest"),
        404: F.when(of("resolve"), "ResolveNotFound").when(of("get_blob", "blob_exists", "head_blob"), "BlobNotFound").when(of("lock"), "LockNotFound").otherwise("NotFound"),
        403: F.when(of("lock"), "LockNotOwned").otherwise("Forbidden"),
        409: F.when(of("lock"), "LockHeldByOther").when(of("register_version"), F.when(cas | content, "RegisterContentNotFound").otherwise("RegisterVersionConflict")).otherwise("Conflict"),
        503: F.lit("ServiceUnavailable"),
    }
    out = F.when(status.between(200, 299), F.lit(None).cast("string"))
    for code, kind in by_status.items():
        out = out.when(status == code, kind)
    return out.otherwise("ApiError")


def detail_of(body: Column, reason: Column) -> Column:
    """The field ``detail`` of a JSON body if it is a string, else the body as it is, else (null or empty) the reason."""
    parsed = F.try_parse_json(body)
    detail = F.try_variant_get(parsed, "$.detail", "string")
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.detail", "variant")) == "STRING"
    return F.coalesce(F.when(is_text, detail), F.nullif(body, F.lit("")), reason)
