"""Policies: which action a type gets. Merged on the driver, applied as literals, so that no join is needed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("dry-run", "report-only", "enforce")
# -- fixed values --
STRENGTH = {"allow": 0, "redact": 1, "mask": 1, "tokenize": 2, "encrypt": 2, "block": 3}
PRESETS: dict[str, dict] = {
    "llm-redact": {"default": "redact", "actions": {"email": "redact", "phone": "mask"}},
    "korean-pii": {"actions": {"kr_rrn": "block", "phone": "mask", "email": "redact"}},
    "secrets-only": {"actions": {"api_key": "block", "secret": "block"}},
    "strict-block": {"default": "block"},
    "local-only": {"transfer": {"external": False}},
    "mcp-basic": {"default": "redact", "actions": {"api_key": "block", "secret": "block", "kr_rrn": "block"}},
    "local-inference": {"default": "redact", "actions": {"email": "tokenize", "phone": "mask", "api_key": "block", "secret": "block", "kr_rrn": "block"}},
}
REGIONS: dict[str, dict[str, str]] = {
    "kr-pipa": {"kr_rrn": "block", "phone": "mask", "email": "redact", "card": "block", "api_key": "block", "secret": "block", "jp_mynumber": "block"},
    "eu-gdpr": {"email": "tokenize", "phone": "mask", "card": "block", "api_key": "block", "secret": "block", "kr_rrn": "block", "fr_nir": "block", "es_dni": "block", "uk_nino": "block", "it_codice_fiscale": "block", "de_steuer_id": "block", "nl_bsn": "block", "jp_mynumber": "block"},
    "asia-pdpa": {"sg_nric": "block", "in_aadhaar": "block", "jp_mynumber": "block", "kr_rrn": "block", "fr_nir": "block", "es_dni": "block", "it_codice_fiscale": "block", "de_steuer_id": "block", "nl_bsn": "block", "phone": "mask", "email": "redact", "card": "block", "api_key": "block", "secret": "block"},
    "us-general": {"email": "redact", "phone": "mask", "card": "block", "api_key": "block", "secret": "block", "jp_mynumber": "block"},
    "jp-appi": {"jp_mynumber": "block", "phone": "mask", "email": "redact", "card": "block", "api_key": "block", "secret": "block", "kr_rrn": "block"},
}
# -- end of fixed values --


@dataclass
class Policy:
    mode: str = "dry-run"
    default: str = "redact"
    actions: dict[str, str] = field(default_factory=dict)
    models: list[str] | None = None
    rate: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        for name, action in [("default", self.default), *self.actions.items()]:
            if action not in STRENGTH:
                raise ValueError(f"unknown action for {name}: {action}")

    @property
    def enforced(self) -> bool:
        return self.mode == "enforce"

    def action(self, kind: Column) -> Column:
        """The action of a type; the default's for a type without one."""
        out = F.lit(self.default)
        for action in STRENGTH:
            if named := sorted(t for t, a in self.actions.items() if a == action):
                out = F.when(kind.isin(named), action).otherwise(out)
        return out


def merge(sources: Iterable[tuple[str, Mapping[str, str]]], weaken: bool = False) -> dict[str, str]:
    """Actions of several sources. One may strengthen what stands or, at equal strength, replace it; to weaken it is an
    error, or with ``weaken`` is passed over."""
    out: dict[str, str] = {}
    for source, actions in sources:
        for kind, action in actions.items():
            if action not in STRENGTH:
                raise ValueError(f"unknown action for {kind}: {action}")
            stands = out.get(kind)
            if stands is None or STRENGTH[action] >= STRENGTH[stands]:
                out[kind] = action
            elif not weaken:
                raise ValueError(f"{source} weakens {kind} from {stands} to {action}")
    return out


def build(presets: Iterable[str] = (), actions: Mapping[str, str] | None = None, mode: str = "dry-run", default: str = "redact", weaken: bool = False, region: str | None = None, **more) -> Policy:
    sources = []
    for name in presets:
        if name not in PRESETS:
            raise ValueError(f"unknown preset: {name}")
        default = PRESETS[name].get("default", default)
        sources.append((f"preset {name}", PRESETS[name].get("actions", {})))
    merged = merge([*sources, ("actions", actions or {})], weaken)
    if region is not None:
        merged = strengthened(merged, region)
    merged.setdefault("injection", "allow")  # reported only, unless a policy says otherwise
    return Policy(mode, default, merged, **more)


def strengthened(actions: Mapping[str, str], region: str) -> dict[str, str]:
    """Actions with a region's, where those are strictly stronger or where none stands."""
    if region not in REGIONS:
        raise ValueError(f"unknown region: {region}")
    own = {t: a for t, a in REGIONS[region].items() if t not in actions or STRENGTH[a] > STRENGTH[actions[t]]}
    return {**actions, **own}


@dataclass
class Profiles:
    """Named policies and what binds an identity to one: a scope, a label ``key=value``, or the default."""

    policies: dict[str, Policy]
    default: str
    by_scope: dict[str, str] = field(default_factory=dict)
    by_label: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in (self.default, *self.by_scope.values(), *self.by_label.values()):
            if name not in self.policies:
                raise ValueError(f"unknown profile: {name}")

    def resolve(self, scopes: Column, labels: Column) -> Column:
        """The first scope that is bound, else the first label that is, else the default."""
        bound = lambda pairs: F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")
        first = lambda keys, pairs: F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(bound(pairs), k)), lambda p: p.isNotNull()), F.lit(0))
        keys = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.coalesce(first(scopes, self.by_scope), first(keys, self.by_label), F.lit(self.default))

    def allowed_model(self, profile: Column, model: Column) -> Column:
        """Whether a profile lets a model be used; profiles without a list allow all."""
        out = F.lit(True)
        for name, policy in self.policies.items():
            if policy.models is not None:
                out = F.when(profile == name, F.coalesce(model.isin(policy.models), F.lit(False))).otherwise(out)
        return out


def decide(found: DataFrame, policy: Policy, kind: str = "type") -> DataFrame:
    """Long rows of detections with action, reason and mode."""
    return found.withColumns({"action": policy.action(F.col(kind)), "reason": F.concat(F.lit("matched:"), F.col("rule_id")), "mode": F.lit(policy.mode)})


def signed(policy: Policy, key: bytes) -> dict:
    """A policy as a bundle with an HMAC over its canonical form."""
    import dataclasses
    import hashlib
    import hmac

    from veilgrid.functions.text import canonical

    body = dataclasses.asdict(policy)
    return {"policy": body, "alg": "HMAC-SHA256", "signature": hmac.new(key, canonical(body).encode(), hashlib.sha256).hexdigest()}


def opened(bundle: Mapping, key: bytes) -> Policy:
    """The policy of a bundle; an error if its signature is wrong."""
    import hmac

    policy = Policy(**bundle["policy"])
    if bundle.get("alg") != "HMAC-SHA256" or not hmac.compare_digest(signed(policy, key)["signature"], str(bundle.get("signature"))):
        raise ValueError("the bundle's signature is wrong")
    return policy
