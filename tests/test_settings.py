import json

import pytest

from veilgrid.operators import policy as P
from veilgrid.operators.vault import KeyRing
from veilgrid.plans import config


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"mode": "enforce", "custom_rules": [{"id": "x", "type": "y", "pattern": "z+"}]}))
    s = config.load(str(tmp_path / "c.json"), {"VEILGRID_REGION": "eu-gdpr", "VEILGRID_MOST_BYTES": "10"})
    assert s.policy().enforced and s.policy().actions["email"] == "tokenize" and s.most_bytes == 10 and len(s.rules()) == 1
    for bad in ({"mode": "x"}, {"most_bytes": 0}, {"min_confidence": 2}, {"allow": [{}]}, {"custom_rules": [{"id": "a", "type": "b", "pattern": "(a+)+"}]}, {"other": 1}):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises((ValueError, TypeError)):
            config.load(str(tmp_path / "b.json"), {})


def test_manifests():
    good = {"id": "a", "version": "1.0.0", "kind": "audit-sink", "runtime": "manifest-only", "entrypoint": "x", "compatibility": {"core": "1"}, "capabilities": dict.fromkeys(config.CAPABILITIES, False)}
    assert config.manifest_errors(good) == config.manifest_errors({"r": good}, "r") == []
    for bad in ({"kind": "x"}, {"capabilities": {}}, {"runtime": "x"}, {"entrypoint": ""}, {"compatibility": None}, {"dataHandling": {"logsRawPayload": True}}, {"capabilities": {**good["capabilities"], "networkEgress": True, "readsPlaintext": True}}):
        assert config.manifest_errors({**good, **bad}), bad
    loaded = {**good, "kind": "authProvider", "runtime": "worker-isolated", "signature": "abc=", "entrySha256": "0" * 64, "signerKeyId": "k", "notAfter": "2030-01-01", "capabilities": {"readsCredentials": True}}
    assert config.manifest_errors(loaded) == []
    for bad in ({"signerKeyId": ""}, {"notAfter": None}, {"capabilities": {"readsCredentials": "yes"}}, {"capabilities": None}, {"signature": "a b"}, {"signature": None}):
        assert len(config.manifest_errors({**loaded, **bad})) == 1, bad
    assert config.manifest_errors({**loaded, "notAfter": None, "notBefore": "2024-01-01"}) == []
    assert config.manifest_errors({**loaded, "kind": "audit-sink"}) and config.manifest_errors({**loaded, "entrySha256": "x"}) and config.manifest_errors({})


def test_bundles_and_keys():
    p = P.build(["mcp-basic"])
    bundle = json.loads(json.dumps(P.signed(p, b"k")))
    assert P.opened(bundle, b"k") == p
    for key, b in ((b"l", bundle), (b"k", {**bundle, "policy": {**bundle["policy"], "default": "allow"}})):
        with pytest.raises(ValueError):
            P.opened(b, key)
    ring = KeyRing(b"a" * 32).rotated(b"b" * 32)
    assert len(ring.keys) == 2 and ring.active == b"b" * 32
