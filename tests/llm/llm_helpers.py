"""The base secrets by Python's own expressions."""

from __future__ import annotations

import re

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
