"""Settings of a deployment: defaults, an overlay of environment variables, checks that refuse what is odd."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from veilgrid.operators import policy as P
from veilgrid.operators.rules import Rule, custom_rule

#: Environment variables that set a field each.
ENVIRONMENT = {"VEILGRID_MODE": "mode", "VEILGRID_DEFAULT": "default", "VEILGRID_REGION": "region", "VEILGRID_MOST_BYTES": "most_bytes", "VEILGRID_RETENTION_DAYS": "retention_days"}
# -- fixed values --
KINDS = ("crypto-provider", "key-provider", "policy-engine", "filter-engine", "token-vault", "audit-sink", "protocol-adapter", "classifier-plugin", "authProvider")
CAPABILITIES = ("readsPlaintext", "writesPlaintext", "networkEgress", "fileWrite", "auditWrite", "externalSecrets")
RUNTIMES = ("manifest-only", "worker-isolated", "process-isolated")
# -- end of fixed values --


@dataclass
class Settings:
    mode: str = "dry-run"
    presets: list[str] = field(default_factory=lambda: ["korean-pii", "secrets-only", "llm-redact"])
    default: str = "redact"
    actions: dict[str, str] = field(default_factory=lambda: {"card": "block"})
    region: str | None = None
    min_confidence: float = 0.0
    allow: list = field(default_factory=list)
    custom_rules: list[dict] = field(default_factory=list)
    decode: bool = False
    scan_numbers: bool = False
    most_bytes: int = 1 << 20
    most_depth: int = 256
    held: int = 256
    anchor_every: int = 1
    retention_days: int = 30
    reveal: bool = False
    label_keys: list[str] = field(default_factory=lambda: ["team", "env", "tier", "role"])
    methods: list[str] = field(default_factory=lambda: ["initialize", "tools/call", "resources/read", "prompts/get"])

    def __post_init__(self) -> None:
        for name, low in (("most_bytes", 1), ("most_depth", 1), ("held", 0), ("anchor_every", 1), ("retention_days", 1)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < low:
                raise ValueError(f"{name} must be a whole number of at least {low}")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be from 0 to 1")
        for entry in self.allow:
            if not isinstance(entry, str) and not (isinstance(entry, dict) and entry and set(entry) <= {"value", "path"}):
                raise ValueError("an allowed entry is a text or has a value or a path")
        self.policy()
        self.rules()

    def policy(self) -> P.Policy:
        return P.build(self.presets, self.actions, self.mode, self.default, region=self.region)

    def rules(self) -> list[Rule]:
        return [custom_rule(**r) for r in self.custom_rules]


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of a JSON file with the environment's on top; names that are not known are refused."""
    raw = {}
    if path is not None:
        with open(path) as f:
            raw = json.load(f)
    kinds = {f.name: f.type for f in dataclasses.fields(Settings)}
    for variable, name in ENVIRONMENT.items():
        if value := (os.environ if environment is None else environment).get(variable):
            raw[name] = int(value) if kinds[name] == "int" else value
    if unknown := set(raw) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**raw)


# -- manifests: for each kind of them, what must hold where (a dotted name, or nothing for the whole) --


def _text(v: object) -> bool:
    return isinstance(v, str) and v != ""


def _like(pattern: str) -> Callable[[object], bool]:
    return lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None


def _among(known: Sequence[str]) -> Callable[[object], bool]:
    return lambda v: not _text(v) or v in known  # that it is a text at all is another rule's


_RULES: dict[str, list[tuple[str, Callable[[object], bool], str]]] = {
    "all": [
        *((name, _text, f"missing {name}") for name in ("id", "version", "kind", "runtime", "entrypoint")),
        ("kind", _among(KINDS), "unknown kind"), ("runtime", _among(RUNTIMES), "unknown runtime"),
    ],
    "declared": [
        ("compatibility", bool, "missing compatibility"), ("capabilities", lambda v: isinstance(v, Mapping), "missing capabilities"),
        *((f"capabilities.{name}", lambda v: isinstance(v, bool), f"capability {name} must be true or false") for name in CAPABILITIES),
        ("dataHandling.logsRawPayload", lambda v: v is not True, "raw payloads must not be logged"),
        ("", lambda m: not (_at(m, "capabilities.networkEgress") and _at(m, "capabilities.readsPlaintext")) or bool(_at(m, "dataHandling.retention")), "what reads plain text and uses the network must declare its retention"),
    ],
    "loaded": [
        ("kind", lambda v: v == "authProvider", "only an authProvider can be loaded at run time"),
        ("signature", _like("[A-Za-z0-9+/=]+"), "no signature"), ("signerKeyId", _text, "missing signerKeyId"), ("entrySha256", _like("[0-9a-f]{64}"), "no hash of the entry point"),
        ("", lambda m: m.get("notBefore") is not None or m.get("notAfter") is not None, "no time from which or to which it is valid"),
        ("capabilities.readsCredentials", lambda v: v is True, "what sees tokens must declare readsCredentials"),
    ],
}


def _at(m: object, name: str) -> object:
    for part in filter(None, name.split(".")):
        m = m.get(part) if isinstance(m, Mapping) else None
    return m


def manifest_errors(manifest: Mapping, root: str | None = None) -> list[str]:
    """What is wrong with the manifest of an extension; ``root`` names the key that holds it, if one does."""
    m = manifest.get(root) if root else manifest
    if not isinstance(m, Mapping) or not m:
        return ["no manifest"]
    kinds = "all", "loaded" if m.get("runtime") in RUNTIMES[1:] else "declared"
    return [fault for kind in kinds for name, fits, fault in _RULES[kind] if not fits(_at(m, name))]
