"""Signed tokens as column expressions: base64url and HMAC-SHA256 from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelark.functions.text import strip

#: Labels that a token may carry.
LABELS = ("positive", "negative", "undecided")


def b64url(data: Column) -> Column:
    """base64url without padding or line breaks."""
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def unb64url(text: Column) -> Column:
    """The bytes of base64url text; null if it is none."""
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    return F.try_to_binary(padded, F.lit("base64"))


def hmac_sha256(message: Column, secret: str) -> Column:
    """The 32 bytes of HMAC-SHA256; the padded keys are constants of the plan."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))


def claims_json(**claims: Column) -> Column:
    """Compact JSON with keys in order; null values are the JSON null. Values with characters beyond ASCII are not escaped."""
    return F.to_json(F.struct(*[claims[k].alias(k) for k in sorted(claims)]), {"ignoreNullFields": "false"})


def token(claims: Column, secret: str) -> Column:
    """payload.signature of a claims text."""
    payload = b64url(claims.cast("binary"))
    return F.concat(payload, F.lit("."), b64url(hmac_sha256(payload, secret)))


_CLAIMS = "v int, run_id string, item_id string, semantic_paper_id string, label string, reviewer string, exp string"


def verify(text: Column, secret: str, now: Column) -> Column:
    """struct(error, claims): the first check that fails, or a null error and the claims."""
    payload, sig = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    claims = F.from_json(unb64url(payload).cast("string"), _CLAIMS)
    exp = claims["exp"].try_cast("timestamp")
    error = (
        F.when(F.coalesce(text, F.lit("")).contains(".") == F.lit(False), "invalid token format")
        .when(b64url(hmac_sha256(payload, secret)) != sig, "invalid token signature")
        .when(claims.isNull(), "invalid token payload")
        .when(exp.isNull(), "invalid token expiry")
        .when(exp < now, "token expired")
        .when(~F.coalesce(F.lower(strip(claims["label"])).isin(*LABELS), F.lit(False)), "invalid label in token")
        .when((strip(claims["run_id"]) == "") | (strip(claims["item_id"]) == ""), "missing run_id/item_id")
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), claims).alias("claims"))


def feedback_url(base: str, token_text: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/feedback?t="), F.url_encode(token_text))


def run_view_url(base: str, run: Column) -> Column:
    """The address of a run's report; empty if base or run is blank."""
    b = (base or "").rstrip("/")
    return F.when(F.lit(b == "") | (strip(run) == ""), "").otherwise(F.concat(F.lit(b + "/run?run_id="), F.url_encode(strip(run))))
