"""Seams: what the library asks of ciphers, callers' registers, limiters and stores that a user brings, two of each that it
has itself, and checks that any of them must pass.

All work on columns and tables, so an implementation is Spark work of any size. A check runs an implementation over a small
table of cases that are drawn anew for each run, and gives the faults it found, as texts, none for one that keeps its
promise; what an implementation raises is a fault too."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import threading
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import text as T
from veilgrid.operators import access, envelopes, limits, signatures
from veilgrid.operators.vault import KeyRing
from veilgrid.sources.shared import written
from veilgrid.sources.versioned import VersionedTable

# -- what is asked --------------------------------------------------------------------------------------------------


class Cipher(Protocol):
    """An envelope has ``ct``, ``tag``, ``aad_hash`` and a key's name (``kid`` or ``key_id``). Null gives null; what does not open is null."""

    def sealed(self, rows: DataFrame, value: str, aad: Column, out: str = "envelope") -> DataFrame: ...
    def opened(self, rows: DataFrame, aad: Column, envelope: str = "envelope", out: str = "value") -> DataFrame: ...
    def hmac(self, text: Column, domain: str) -> Column: ...


class Callers(Protocol):
    """Requests (authorization) with ``subject_hash`` and ``issuer_hash``, both null for one that is refused."""

    def authenticated(self, requests: DataFrame) -> DataFrame: ...


class Limiter(Protocol):
    """Requests (key, at) with ``hit``, a request's number in its key's window."""

    def hits(self, requests: DataFrame, seconds: int) -> DataFrame: ...


class Store(Protocol):
    """A table that changes as a whole. ``change`` makes the next table from the present one, and may be called again with
    a newer one; no change of another writer gets lost. A table that was read stays as it was."""

    def read(self) -> DataFrame: ...
    def mutate(self, change: Callable[[DataFrame], DataFrame]) -> None: ...


# -- two of each ----------------------------------------------------------------------------------------------------


def _domain_key(key: bytes, domain: str) -> bytes:
    if not isinstance(domain, str) or not domain:
        raise ValueError("a domain is needed")
    return hmac.new(key, domain.encode(), hashlib.sha256).digest()


class RingCipher:
    """Values under the active key of a ring; retired keys still open."""

    def __init__(self, ring: KeyRing, mac_key: bytes):
        self.ring, self.mac_key = ring, mac_key

    def sealed(self, rows: DataFrame, value: str, aad: Column, out: str = "envelope") -> DataFrame:
        return rows.withColumn(out, F.when(F.col(value).isNotNull(), T.encrypt(F.col(value), self.ring.active, aad)))

    def opened(self, rows: DataFrame, aad: Column, envelope: str = "envelope", out: str = "value") -> DataFrame:
        return rows.withColumn(out, T.decrypt(F.col(envelope), self.ring.keys, aad))

    def hmac(self, text: Column, domain: str) -> Column:
        return T.hmac_sha256(_domain_key(self.mac_key, domain), text)


class WrappedCipher:
    """Values under data keys of a written table (key_id, kid, wrapped), chosen for each value by a hash of it."""

    def __init__(self, keys: DataFrame, wrapping: dict[str, bytes], key_ids: list[str], mac_key: bytes):
        self.keys, self.wrapping, self.key_ids, self.mac_key = keys, wrapping, key_ids, mac_key

    def sealed(self, rows: DataFrame, value: str, aad: Column, out: str = "envelope") -> DataFrame:
        turn = F.pmod(F.xxhash64(value), F.lit(len(self.key_ids))).cast("int")
        chosen = rows.withColumn("_of", F.get(F.array(*map(F.lit, self.key_ids)), turn))
        return envelopes.sealed(chosen, self.keys, self.wrapping, value, "_of", aad, out).drop("_of")

    def opened(self, rows: DataFrame, aad: Column, envelope: str = "envelope", out: str = "value") -> DataFrame:
        return envelopes.opened(rows, self.keys, self.wrapping, aad, envelope, out)

    def hmac(self, text: Column, domain: str) -> Column:
        return T.hmac_sha256(_domain_key(self.mac_key, domain), text)


class TokenCallers:
    """Callers by a table of hashed tokens."""

    def __init__(self, records: DataFrame, mac_key: bytes):
        self.records, self.mac_key = records, mac_key

    def authenticated(self, requests: DataFrame) -> DataFrame:
        found = access.authenticated(requests, self.records)
        issuer = F.when(F.col("id").isNotNull(), T.hmac_sha256(self.mac_key, F.lit("tokens")))
        return found.select(*requests.columns, T.hmac_sha256(self.mac_key, F.col("id")).alias("subject_hash"), issuer.alias("issuer_hash"))


class SignedCallers:
    """Callers by signed tokens and a table of keys."""

    def __init__(self, keys: DataFrame, issuer: str, audience: str, now: Column, mac_key: bytes):
        self.keys, self.issuer, self.audience, self.now, self.mac_key = keys, issuer, audience, now, mac_key

    def authenticated(self, requests: DataFrame) -> DataFrame:
        told = signatures.verified(requests.withColumn("_token", T.bearer(F.col("authorization"))), self.keys, self.issuer, self.audience, self.now, token="_token")
        claim = lambda c: T.hmac_sha256(self.mac_key, F.when(F.col("verdict").isNull(), F.get_json_object("claims", f"$.{c}")))
        return told.select(*requests.columns, claim("sub").alias("subject_hash"), claim("iss").alias("issuer_hash"))


class ClockLimiter:
    def hits(self, requests: DataFrame, seconds: int) -> DataFrame:
        return limits.clock_windows(requests, "key", "at", 1, seconds).drop("allowed")


class FirstHitLimiter:
    def hits(self, requests: DataFrame, seconds: int) -> DataFrame:
        return limits.first_hit_windows(requests, "key", "at", 1, seconds).drop("allowed")


def allowed(requests: DataFrame, limiter: Limiter, seconds: int = 60) -> DataFrame:
    """Requests (key, at, limit) with ``allowed``. One without a key or a time, or with a limit that is null or below 1, is
    refused and counts for nothing; so is one whose number makes no sense."""
    fit = F.coalesce((F.col("key") != "") & F.col("at").isNotNull() & (F.col("limit") >= 1), F.lit(False))
    hits = limiter.hits(requests.where(fit), seconds)
    sane = F.coalesce((F.col("hit") >= 1) & (F.col("hit") <= F.col("limit")), F.lit(False))
    return hits.select(*requests.columns, sane.alias("allowed")).unionByName(requests.where(~fit).withColumn("allowed", F.lit(False)))


class SharedStore:
    """A table in a folder, changed by compare and append, for writers anywhere."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.table = VersionedTable(spark, path, schema)

    def read(self) -> DataFrame:
        return self.table.read()

    def mutate(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.table.mutate(change)


class SessionStore:
    """A table of one driver's own: its rows lie in the shared folder, which table is the present one only the driver knows."""

    def __init__(self, spark: SparkSession, schema: str):
        self.now, self.lock = spark.createDataFrame([], schema), threading.Lock()

    def read(self) -> DataFrame:
        return self.now

    def mutate(self, change: Callable[[DataFrame], DataFrame]) -> None:
        with self.lock:
            self.now = written(change(self.now).select(*self.now.columns), "store")


# -- the checks -----------------------------------------------------------------------------------------------------


class _Faults(list):
    def check(self, name: str, test: Callable[[], bool]) -> None:
        try:
            if not test():
                self.append(name)
        except Exception as e:  # noqa: BLE001  whatever a foreign implementation raises is its fault
            self.append(f"{name}: raised {type(e).__name__}")


def cipher_faults(spark: SparkSession, cipher: Cipher, with_hmac: bool = True) -> list[str]:
    """What a cipher does not keep of its promise. Envelopes are written before they are opened, as they are drawn anew."""
    faults = _Faults()
    same = f"{secrets.token_hex(8)}@example.com"
    values = [same, same, f"{secrets.token_hex(8)}@example.org", f"ä王 {secrets.token_hex(4)} é", secrets.token_hex(50_000), None]
    rows = spark.createDataFrame([(i, v, f"at {i % 2}") for i, v in enumerate(values)], "n int, plain string, about string")
    try:
        made = written(cipher.sealed(rows, "plain", F.col("about")), "conformance")
        e = {r.n: r.envelope for r in made.collect()}
    except Exception as err:  # noqa: BLE001
        return [f"sealing: raised {type(err).__name__}"]

    def opened(table: DataFrame, aad: Column) -> list:
        return [r.value for r in cipher.opened(table, aad).orderBy("n").collect()]

    def broken(part: str) -> DataFrame:
        first = F.when(F.col(f"envelope.{part}").startswith("A"), "B").otherwise("A")
        return made.withColumn("envelope", F.when(F.col("envelope").isNotNull(), F.col("envelope").withField(part, F.concat(first, F.substring(f"envelope.{part}", 2, 1 << 30)))))

    present = [e[i] for i, v in enumerate(values) if v is not None]
    faults.check("round trip", lambda: opened(made, F.col("about")) == values)
    faults.check("null stays null", lambda: e[len(values) - 1] is None)
    faults.check("key's name", lambda: all(x.asDict().get("kid") or x.asDict().get("key_id") for x in present))
    faults.check("hash of what it is bound to", lambda: all(x.aad_hash for x in present))
    faults.check("value in clear", lambda: not any(v in str(x.asDict()) for v, x in zip(values, present)))
    faults.check("drawn anew", lambda: e[0].ct != e[1].ct)
    faults.check("bound to what it is about", lambda: opened(made, F.concat(F.lit("no "), "about")) == [None] * len(values))
    faults.check("changed text", lambda: opened(broken("ct"), F.col("about")) == [None] * len(values))
    faults.check("changed tag", lambda: opened(broken("tag"), F.col("about")) == [None] * len(values))
    if with_hmac:
        def mac(text: str, domain) -> str:
            return spark.range(1).select(cipher.hmac(F.lit(text), domain).alias("m")).first().m

        def refuses(domain) -> bool:
            try:
                mac("x", domain)
            except Exception:  # noqa: BLE001
                return True
            return False

        faults.check("hmac repeats", lambda: bool(mac("x", "a")) and mac("x", "a") == mac("x", "a"))
        faults.check("hmac of other texts", lambda: mac("x", "a") != mac("y", "a"))
        faults.check("hmac of other domains", lambda: mac("x", "a") != mac("x", "b"))
        faults.check("hmac without a domain", lambda: refuses("") and refuses(None))
    return list(faults)


def callers_faults(spark: SparkSession, callers: Callers, valid: str, raw: list[str], refused: dict[str, str | None]) -> list[str]:
    """What a register of callers does not keep of its promise. ``valid`` is a header that it knows, ``raw`` what stands behind
    it and must not show; ``refused`` are headers that it must refuse, by name (expired, not yet valid); missing ones, empty
    ones, other schemes and random tokens are added."""
    faults = _Faults()
    no = {"missing": None, "empty": "", "no token": "Bearer", "other scheme": valid.replace("Bearer", "Basic", 1), "random": f"Bearer {secrets.token_hex(16)}", "torn": valid[:-3], **refused}
    rows = spark.createDataFrame([*no.items(), ("valid", valid), ("valid again", valid)], "name string, authorization string")
    try:
        found = {r.name: r for r in callers.authenticated(rows).collect()}
        again = {r.name: r for r in callers.authenticated(rows).collect()}
    except Exception as err:  # noqa: BLE001
        return [f"authenticating: raised {type(err).__name__}"]
    for name in no:
        faults.check(f"refused: {name}", lambda name=name: found[name].subject_hash is None and found[name].issuer_hash is None)
    yes = found.get("valid")
    faults.check("accepted", lambda: bool(yes.subject_hash and yes.issuer_hash))
    faults.check("a row for each request", lambda: set(found) == {*no, "valid", "valid again"})
    faults.check("repeats", lambda: found == again and yes.subject_hash == found["valid again"].subject_hash)
    faults.check("raw values", lambda: not any(x in str(v) for x in raw for k, v in yes.asDict().items() if k != "authorization"))
    return list(faults)


def limiter_faults(spark: SparkSession, limiter: Limiter) -> list[str]:
    """What a limiter does not keep of its promise; a window of ten seconds must hold for requests at most ten seconds apart
    that a multiple of ten begins."""
    faults = _Faults()
    key = secrets.token_hex(4)
    times = [(key, s, 2) for s in (100, 101, 109, 110)] + [("other", 100, 1), ("other", 105, 1), (None, 100, 1), ("", 100, 1), (key, None, 2), ("none", 100, 0), ("null", 100, None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(times)], "n int, key string, s int, limit int").selectExpr("n", "key", "timestamp_seconds(s) at", "limit")
    try:
        got = {r.n: r.allowed for r in allowed(rows, limiter, 10).collect()}
    except Exception as err:  # noqa: BLE001
        return [f"limiting: raised {type(err).__name__}"]
    faults.check("a row for each request", lambda: len(got) == len(times))
    faults.check("up to the limit", lambda: got[0] and got[1] and got[4])
    faults.check("beyond the limit", lambda: not got[2] and not got[5])
    faults.check("a new window", lambda: got[3])
    faults.check("unfit requests", lambda: not any(got[i] for i in range(6, 11)))
    return list(faults)


def store_faults(make: Callable[[], Store], rows_of: Callable[[list[int]], DataFrame], writers: int = 4) -> list[str]:
    """What a store does not keep of its promise. ``make`` gives a new one, ``rows_of`` different rows for different numbers."""
    faults = _Faults()
    rows = lambda df: sorted(map(repr, df.collect()))
    add = lambda *n: lambda now: now.unionByName(rows_of(list(n)))
    wanted = lambda *n: rows(rows_of(list(n)))
    try:
        store = make()
        faults.check("empty at first", lambda: not rows(store.read()))
        store.mutate(add(1, 2))
        before = store.read()
        faults.check("rows come back", lambda: rows(store.read()) == wanted(1, 2))
        store.mutate(lambda now: now.limit(0).unionByName(rows_of([3])))
        faults.check("rows are replaced", lambda: rows(store.read()) == wanted(3))
        faults.check("what was read stays", lambda: rows(before) == wanted(1, 2))
    except Exception as err:  # noqa: BLE001
        return [*faults, f"changing: raised {type(err).__name__}"]

    def failing(now: DataFrame) -> DataFrame:
        raise LookupError

    try:
        store.mutate(failing)
        faults.append("a failing change is told")
    except Exception:  # noqa: BLE001
        pass
    faults.check("a failing change changes nothing", lambda: rows(store.read()) == wanted(3))
    told: list[BaseException] = []

    def write(n: int) -> None:
        try:
            store.mutate(add(n))
        except Exception as err:  # noqa: BLE001
            told.append(err)

    threads = [threading.Thread(target=write, args=(10 + n,)) for n in range(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    faults.check("writers at once", lambda: not told and rows(store.read()) == wanted(3, *(10 + n for n in range(writers))))
    return list(faults)
