import json

from veilgrid.operators import detect, policy as P
from veilgrid.streaming import rewriter


def test_what_no_rule_fits_is_looked_at_once(monkeypatch):
    seen, scan = [], detect.scan
    monkeypatch.setattr(detect, "scan", lambda text, *a: seen.append(text) or scan(text, *a))
    texts = rewriter.StreamRewriter(P.build(actions={"email": "redact"}, mode="enforce", default="allow"), "sse", ("choices", 0, "delta", "content"))
    frame = "data: " + json.dumps({"choices": [{"delta": {"content": "plain words only, " * 15}}]})
    out = [x for _ in range(20) for x in texts.frame(frame)] + texts.end()
    said = "".join(json.loads(x.removeprefix("data: "))["choices"][0]["delta"]["content"] for x in out)
    assert said == "plain words only, " * 300
    assert len(seen) < 10
