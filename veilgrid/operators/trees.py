"""JSON texts: flattening into leaves, rewriting of leaves and keys, shapes. Trees are walked in vectorised functions, as
columns have no type for them; paths, counts and policies are native."""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 256
LEAF = "path array<struct<key:string,idx:int>>, path_text string, value string, kind string"


class TooDeep(ValueError):
    """A tree nested deeper than allowed."""


def number_text(x: int | float) -> str:
    """A number as JSON's own notation shows it: whole ones without a point, large ones with an exponent."""
    if isinstance(x, int):
        return str(x)
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    out = repr(x)
    if "e" not in out and abs(x) < 1e-6:
        out = f"{x:.17g}"
    mantissa, _, power = out.partition("e")
    return out if not power else f"{mantissa.removesuffix('.0')}e{'+' if int(power) > 0 else ''}{int(power)}"


def leaves(value, path: tuple = (), most: int = MOST_DEPTH) -> Iterator[tuple[tuple, str, str]]:
    """(path, text, kind) of strings, numbers and keys, a key before what it holds."""
    if isinstance(value, str):
        yield path, value, "value"
    elif isinstance(value, bool) or value is None:
        return
    elif isinstance(value, (int, float)):
        if value == value and abs(value) != float("inf"):
            yield path, number_text(value), "number"
    elif len(path) >= most:
        raise TooDeep(f"nested deeper than {most}")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from leaves(x, (*path, i), most)
    else:
        for k, x in value.items():
            yield (*path, k), k, "key"
            yield from leaves(x, (*path, k), most)


def plain_path(path: tuple) -> str:
    out = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return out.removeprefix(".")


def safe_path(path: tuple) -> str:
    """A path without the text of its keys."""
    return plain_path(tuple(p if isinstance(p, int) else "key_" + hashlib.sha256(p.encode()).hexdigest()[:12] for p in path))


def path_text(path: Column, safe: bool = True) -> Column:
    """The same for a path column, natively."""
    name = lambda p: F.concat(F.lit("key_"), F.substring(F.sha2(p["key"], 256), 1, 12)) if safe else p["key"]
    part = lambda p: F.when(p["idx"].isNotNull(), F.concat(F.lit("["), p["idx"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), name(p)))
    return F.regexp_replace(F.array_join(F.transform(path, part), ""), r"^\.", "")


def parse(text: str | None):
    return None if text is None else json.loads(text)


def flatten(rows: DataFrame, column: str, most: int = MOST_DEPTH) -> DataFrame:
    """A row for each leaf: the other columns, path, path_text (safe), value, kind, and error. A text that is no JSON or
    nested too deep gives one row with an error and no value, so that nothing is lost silently; null gives none."""

    @F.pandas_udf(f"array<struct<{LEAF.replace(' array', ':array').replace(' string', ':string')},error:string>>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            try:
                found = list(leaves(json.loads(t), (), most))
            except (ValueError, RecursionError) as e:
                return [{"path": None, "path_text": None, "value": None, "kind": None, "error": "too_deep" if isinstance(e, (TooDeep, RecursionError)) else "invalid_json"}]
            parts = lambda p: [{"key": None, "idx": x} if isinstance(x, int) else {"key": x, "idx": None} for x in p]
            return [{"path": parts(p), "path_text": safe_path(p), "value": v, "kind": k, "error": None} for p, v, k in found]

        return pd.Series([one(t) for t in s], dtype=object)

    return rows.withColumn("_leaf", F.explode(run(F.col(column)))).select(*(c for c in rows.columns if c != column), "_leaf.*")


def shape(value):
    """What a tree looks like without its contents: types, and lengths of strings."""
    if isinstance(value, str):
        return {"type": "string", "length": len(value)}
    if isinstance(value, list):
        return [shape(x) for x in value]
    if isinstance(value, dict):
        return {k: shape(v) for k, v in value.items()}
    return {"type": "null" if value is None else "boolean" if isinstance(value, bool) else "number"}


def _mapped(text: Column, one, kind: str = "string") -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def safe(t):
            try:
                return one(json.loads(t))
            except (ValueError, RecursionError):
                return None

        return s.map(safe, na_action="ignore")

    return run(text)


def shape_hash(text: Column) -> Column:
    """sha256 of the canonical form of a tree's shape; null for what is no JSON."""
    return _mapped(text, lambda v: hashlib.sha256(json.dumps(shape(v), sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def get_path(value, path: tuple):
    """What is at a path, or None."""
    for p in path:
        try:
            value = value[p]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def built(path: tuple, leaf):
    """The smallest tree that has a leaf at a path."""
    for p in reversed(path):
        leaf = [None] * p + [leaf] if isinstance(p, int) else {p: leaf}
    return leaf


def rewrite_tree(value, change, path: tuple = ()):
    """A tree with its leaves and keys as ``change(text, kind, path)`` gives them. A number that changes becomes a string;
    a key that meets another gets ``#2``, ``#3``, ..."""
    if isinstance(value, str):
        return change(value, "value", path)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        old = number_text(value)
        new = change(old, "number", path)
        return value if new == old else new
    if isinstance(value, list):
        return [rewrite_tree(x, change, (*path, i)) for i, x in enumerate(value)]
    renamed = {k: change(k, "key", (*path, k)) for k in value}
    taken, out = {k for k, n in renamed.items() if k == n}, {}
    for k, x in value.items():
        new, turn = renamed[k], 2
        if new != k:
            while new in taken:
                new, turn = f"{renamed[k]}#{turn}", turn + 1
            taken.add(new)
        out[new] = rewrite_tree(x, change, (*path, k))
    return out


def _mark_for(text: str) -> str:
    """What stands for values to encrypt until they are: drawn anew for each text, and in none of its own."""
    while (mark := "\ue000" + secrets.token_hex(8)) in text:
        pass
    return mark


def sealed_mark(own: str | None = None) -> str:
    """A mark for one sealed value, drawn anew, so that no text can hold it but by the luck of 128 bits."""
    return "\ue000" + (secrets.token_hex(16) if own is None else own) + "\ue001"


def seal_aad(context: Column, path: Column, kind: Column, rule_id: Column) -> Column:
    """What a sealed value is bound to: where it was taken from and why, beside the caller's own context. With another path,
    type or rule it does not open."""
    return F.to_json(F.struct(F.coalesce(context, F.lit("")).alias("context"), path.alias("path"), rule_id.alias("ruleId"), kind.alias("type")))


def protect_json(rows: DataFrame, column: str, policy, direction: str = "request", most: int = MOST_DEPTH, min_confidence: float | None = None, allow=(), key: bytes | None = None, sealing_key: bytes | None = None, aad: Column | None = None) -> DataFrame:
    """Rows with out (JSON as the policy wants it, null if blocked or no JSON), blocked, detections, types, found, issued and
    error. The tree is walked once; decisions are those of ``policy`` for each leaf. ``allow`` has texts, and entries with a
    value, a (safe) path or both, of which both must fit; hard types are never spared. With ``key`` tokens are those of the
    vault, and ``issued`` has them, each once; with ``sealing_key`` what should be encrypted is, natively, else redacted; an
    envelope is bound by ``seal_aad`` to ``aad``, its path, type and rule.
    ``found`` has type, rule_id, path (safe), kind, confidence and action of each detection."""
    from veilgrid.functions import text as T
    from veilgrid.operators import detect
    from veilgrid.operators.rules import HARD_TYPES

    rules = detect.rules_for(direction)
    low, actions, default, enforced = min_confidence, dict(policy.actions), policy.default, policy.enforced
    entries = [{"value": e} if isinstance(e, str) else e for e in allow]
    if any("value" not in e and "path" not in e for e in entries):
        raise ValueError("an allowed entry needs a value or a path")
    values = {e["value"] for e in entries if "path" not in e}
    paths = {e["path"] for e in entries if "value" not in e}
    pairs = {(e["value"], e["path"]) for e in entries if "value" in e and "path" in e}
    seals = sealing_key is not None

    def stars(v: str) -> str:
        return "*" * len(v) if len(v) <= 8 else v[:2] + "*" * max(4, len(v) - 4) + v[-2:]

    def one(t):
        if t is None:
            return None
        try:
            tree = json.loads(t)
            list(leaves(tree, (), most))
        except (ValueError, RecursionError) as e:
            return {"out": None, "blocked": True, "detections": 0, "types": [], "found": [], "issued": [], "sealed": [], "error": "too_deep" if isinstance(e, (TooDeep, RecursionError)) else "invalid_json"}
        found: list[dict] = []
        issued: dict[str, None] = {}
        sealed: list[dict] = []

        mark = _mark_for(t)

        def replaced(kind: str, action: str, v: str, where_from: dict) -> str:
            if action == "mask":
                return stars(v)
            if action == "tokenize" and key:
                token = T.vault_token_of(key, kind, v)
                issued[token] = None
                return f"[TOKEN:{token}]"
            if action == "tokenize":
                return f"[TOKEN:{kind}:{hashlib.sha256(v.encode()).hexdigest()[:12]}]"
            if action == "encrypt" and seals:
                sealed.append({"mark": f"{mark}:{len(sealed)}\ue001", "value": v, **where_from})
                return sealed[-1]["mark"]
            return f"[REDACTED:{kind}]"

        def change(v, kind, path):
            out, at, where = [], 0, None
            for type_, rule_id, _n, a, b, sure, text in detect.scan(v, kind, rules, direction):
                where = safe_path(path) if where is None else where
                if type_ not in HARD_TYPES and (text in values or where in paths or (text, where) in pairs or (low is not None and sure < low)):
                    continue
                action = actions.get(type_, default)
                found.append({"type": type_, "rule_id": rule_id, "path": where, "kind": kind, "confidence": sure, "action": action})
                if enforced and action not in ("allow", "block"):
                    out += [v[at:a], replaced(type_, action, text, {"path": where, "type": type_, "rule_id": rule_id})]
                    at = b
            return "".join([*out, v[at:]])

        new = rewrite_tree(tree, change)
        stop = enforced and any(f["action"] == "block" for f in found)
        text = None if stop else json.dumps(new if enforced else tree, ensure_ascii=False)
        return {"out": text, "blocked": stop, "detections": len(found), "types": sorted({f["type"] for f in found}), "found": found, "issued": list(issued), "sealed": sealed, "error": None}

    detection = "struct<type:string,rule_id:string,path:string,kind:string,confidence:double,action:string>"

    @F.pandas_udf(f"struct<out:string,blocked:boolean,detections:int,types:array<string>,found:array<{detection}>,issued:array<string>,sealed:array<struct<mark:string,value:string,path:string,type:string,rule_id:string>>,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("out", "blocked", "detections", "types", "found", "issued", "sealed", "error"))
        return pd.DataFrame([one(t) or none for t in s], columns=list(none))

    done = rows.withColumn("_r", run(F.col(column))).select("*", "_r.*").drop("_r")
    if seals:
        done = done.withColumn("out", F.aggregate("sealed", F.col("out"), lambda t, x: F.replace(t, x["mark"], sealed_text(x, sealing_key, aad))))
    return done.drop("sealed")


def sealed_text(x: Column, key: bytes, aad: Column | None = None) -> Column:
    """What stands for a sealed value (value, path, type, rule_id): its envelope, bound by :func:`seal_aad`."""
    from veilgrid.functions import text as T

    bound = seal_aad(F.lit("") if aad is None else aad, x["path"], x["type"], x["rule_id"])
    return F.concat(F.lit("[SEALED:"), T.base64url(F.encode(F.to_json(T.encrypt(x["value"], key, bound)), "UTF-8")), F.lit("]"))


def opened(text: Column, keys: dict[str, bytes], bound: Column) -> Column:
    """The values of a text's envelopes, in order; null for one that is bound to something else, has another key or is broken.
    ``bound`` is what :func:`seal_aad` gave when they were sealed."""
    from veilgrid.functions import text as T

    envelope = lambda x: F.from_json(F.decode(T.from_base64url(x), "UTF-8"), "v int, alg string, kid string, iv string, ct string, tag string, aad_hash string")
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[SEALED:([A-Za-z0-9_-]+)\]"), F.lit(1)), lambda x: T.decrypt(envelope(x), keys, bound))


def restore_tokens(text: Column, known: Column) -> Column:
    """A text with the tokens of a map replaced by what they stand for."""
    return F.aggregate(F.map_entries(known), text, lambda t, e: F.replace(t, e["key"], e["value"]))
