"""All core queries with their SQL counterparts."""

from __future__ import annotations

from qaloom.plans import audits, checks, frames, intervals, manifests, roundtrips, scores, streams, texts

_MODULES = (frames, texts, scores, manifests, checks, intervals, streams, roundtrips, audits)
FLAGSHIP = "frame_plan"
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in m.ORACLES.items()}
