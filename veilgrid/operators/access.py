"""Access: tokens of callers, routes, models, headers, addresses, gates of requests and responses. All are columns or
joins with small tables whose size is that of a configuration."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions import text as T

# -- fixed values --
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
BODY_HEADERS = ("content-length", "content-encoding", "etag", "last-modified", "content-md5", "digest", "accept-ranges", "content-range")
CLAIMS = ("id", "type", "scopes", "labels", "provider")
CLAIM_BOUNDS = {"scopes": 64, "labels": 32, "chars": 1024}
DELTA_PATHS = {
    "chat": "choices[0].delta.content", "completion": "choices[0].text", "responses": None, "legacy": "content", "ollama_chat": "message.content",
    "ollama_generate": "response", "messages": "delta.text", "complete": "completion", "candidates": "candidates[0].content.parts[0].text",
}
FLUSH_TYPES = {"messages": ("content_block_stop", "message_delta", "message_stop")}
# -- end of fixed values --


def authenticated(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (authorization) with the record whose hash is that of their token: not disabled, of several the last by
    ``position``. ``id`` is null where there is none."""
    live = records.where(~F.coalesce("disabled", F.lit(False))).groupBy("token_hash").agg(F.max_by(F.struct("id", "type", "scopes", "labels"), "position").alias("record"))
    rows = requests.withColumn("token_hash", F.sha2(T.bearer(F.col("authorization")), 256))
    return rows.join(live, "token_hash", "left").select("*", "record.*").drop("record", "token_hash")


def add_token(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with new ones (token, id, type, scopes, labels) after the last; only hashes of tokens are kept."""
    top = records.agg(F.coalesce(F.max("position"), F.lit(0)).alias("top"))
    rows = new.join(F.broadcast(top)).select(F.sha2("token", 256).alias("token_hash"), "id", "type", "scopes", "labels", F.lit(False).alias("disabled"), (F.col("top") + 1).alias("position"))
    return records.unionByName(rows)


def revoke(records: DataFrame, token_id: str) -> DataFrame:
    return records.withColumn("disabled", F.coalesce("disabled", F.lit(False)) | (F.col("id") == token_id))


def public_records(records: DataFrame) -> DataFrame:
    return records.select("id", "type", "scopes", "labels", "disabled")


def labels_ok(labels: Column, allowed: list[str]) -> Column:
    """Whether all labels have allowed keys and values of 1 to 64 characters."""
    return ~F.exists(F.map_entries(labels), lambda e: ~e["key"].isin(allowed) | ~F.char_length(e["value"]).between(1, 64))


def claims_ok(scopes: Column, labels: Column) -> Column:
    short = lambda x: F.char_length(x) > CLAIM_BOUNDS["chars"]
    return (F.size(scopes) <= CLAIM_BOUNDS["scopes"]) & (F.size(labels) <= CLAIM_BOUNDS["labels"]) & ~F.exists(scopes, short) & ~F.exists(F.map_values(labels), short)


def routed(requests: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """Requests with their route: the one with exactly their path, else the first whose ``suffix`` (``:name``) ends it.
    Routes (route_id, position, path, suffix) are a configuration. The suffix of a path is what follows its last colon, so
    both lookups are joins on equal keys."""
    exact = routes.where(F.col("path").isNotNull()).groupBy(F.col("path").alias("_p")).agg(F.min_by("route_id", "position").alias("_exact"))
    ends = routes.where(F.col("suffix").isNotNull()).groupBy(F.col("suffix").alias("_s")).agg(F.min_by("route_id", "position").alias("_ends"))
    rows = requests.withColumn("_p", F.col(path)).withColumn("_s", F.regexp_extract(F.col(path), ":[^:/]*$", 0))
    return rows.join(exact, "_p", "left").join(ends, "_s", "left").withColumn("route_id", F.coalesce("_exact", "_ends")).drop("_p", "_s", "_exact", "_ends")


def streams(body: Column, route_default: Column) -> Column:
    """Whether a request asks for a stream: it says so, or its route does and it does not say no."""
    said = F.try_variant_get(F.try_parse_json(body), "$.stream", "boolean")
    return F.coalesce(said, route_default, F.lit(False))


def method_allowed(method: Column, allowed: list[str]) -> Column:
    return F.lit(True) if "*" in allowed else method.isin(allowed)


def rpc_ok(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.jsonrpc") == "2.0", F.lit(False))


def kept_headers(headers: Column, allow: list[str] | None = None, deny: list[str] = (), forward_authorization: bool = False, content_type: str | None = None) -> Column:
    """Headers to pass on: denied ones go even if allowed, hop-by-hop ones always, authorization unless it is wanted."""
    gone = {*HOP_HEADERS, "host", "content-length", *(x.lower() for x in deny), *(() if forward_authorization else ("authorization",))}
    out = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(sorted(gone)) & (F.lower(k).isin([a.lower() for a in allow]) if allow is not None else F.lit(True)))
    if content_type is not None:
        out = F.map_concat(F.map_filter(out, lambda k, v: F.lower(k) != "content-type"), F.create_map(F.lit("content-type"), F.lit(content_type)))
    return out


def response_headers(headers: Column, changed: bool = True) -> Column:
    """Headers of a response: without hop-by-hop ones and, if its body changed, without those that speak of the body."""
    gone = [*HOP_HEADERS, *(BODY_HEADERS if changed else ()), "cache-control"]
    return F.map_concat(F.map_filter(headers, lambda k, v: ~F.lower(k).isin(gone)), F.create_map(F.lit("cache-control"), F.lit("no-store")))


def body_gate(body: Column, most: int) -> Column:
    """413, 400 or 200 for raw bytes of a request: too large, no UTF-8, fine."""
    return F.when(F.octet_length(body) > most, 413).when(~F.is_valid_utf8(body.cast("string")), 400).otherwise(200)


def response_gate(content_type: Column, encoding: Column, body: Column, most: int) -> Column:
    """Why a response can't be protected; null if it can. The first reason counts."""
    return (
        F.when(~F.coalesce(F.lower(content_type).rlike(r"^application/([a-z0-9.+-]+\+)?json\b"), F.lit(False)), "not_json")
        .when(F.coalesce(F.lower(encoding), F.lit("identity")) != "identity", "compressed")
        .when(F.octet_length(body) > most, "too_large")
        .when(F.try_parse_json(body.cast("string")).isNull(), "invalid_json")
    )


def absolute_target(target: Column) -> Column:
    return target.rlike(r"^(?i:[a-z][a-z0-9+.-]*:)?//")


def first_hop_https(forwarded: Column) -> Column:
    return F.trim(F.split_part(F.lower(forwarded), F.lit(","), F.lit(1))) == "https"


def loopback_host(host: Column) -> Column:
    return F.lower(host).rlike(r"^(localhost|127(\.[0-9]{1,3}){3}|\[?::1\]?)$")


def blocked_ipv4(address: Column) -> Column:
    """Whether an IPv4 address is in a loopback, private, link-local or 0/8 range; null for other texts."""
    o = F.transform(F.split(address, r"\."), lambda x: x.cast("int"))
    ok = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~F.exists(o, lambda x: x > 255)
    return F.when(ok, o[0].isin(0, 10, 127) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254)))


def blocked_address(address: Column) -> Column:
    """The same for IPv6 too, in a vectorised function: ``::``, ``::1``, mapped IPv4, fe80/10, fc00/7, ff00/8."""
    inner = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
    outer = [ipaddress.ip_network(n) for n in ("::/128", "::1/128", "fe80::/10", "fc00::/7", "ff00::/8")]

    def one(t: str) -> bool | None:
        try:
            a = ipaddress.ip_address(t.strip("[]").split("%")[0])
        except ValueError:
            return None
        if a.version == 6 and a.ipv4_mapped:
            a = a.ipv4_mapped
        return any(a in n for n in (inner if a.version == 4 else outer))

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore").astype("object")

    return run(address)


def claims_verdict(token: Column, issuer: str, audience: str, now: Column, algorithms: tuple[str, ...] = ("RS256", "ES256"), skew: int = 60) -> Column:
    """Why a JWT's header and claims are refused, null if they are not. Its signature is not looked at: that needs a
    library that is not part of the engine. ``now`` is in seconds."""
    part = lambda k: T.from_base64url(F.split_part(token, F.lit("."), F.lit(k))).cast("string")
    claim = lambda name: F.get_json_object(part(2), f"$.{name}")
    number = lambda name: claim(name).cast("double")
    aud = F.coalesce(F.from_json(claim("aud"), "array<string>"), F.array(claim("aud")))
    return (
        F.when(~token.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"), "malformed")
        .when(~F.coalesce(F.get_json_object(part(1), "$.alg").isin(*algorithms), F.lit(False)), "algorithm")
        .when(F.get_json_object(part(1), "$.kid").isNull(), "key id")
        .when(~claim("iss").eqNullSafe(F.lit(issuer)), "issuer")
        .when(~F.coalesce(F.array_contains(aud, audience), F.lit(False)), "audience")
        .when(F.coalesce(claim("sub"), F.lit("")) == "", "subject")
        .when(number("exp").isNull() | (now >= number("exp") + skew), "expired")
        .when(number("nbf") > now + skew, "not yet")
        .when(number("iat") > now + skew, "issued later")
    )
