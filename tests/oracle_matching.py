"""Plain-Python versions of the scores and of the serial assignment, for small cases."""

from difflib import SequenceMatcher

# Stop words here, and the thresholds and points below.
STOP = {"INC", "LLC", "LTD", "CORP", "CO", "&", "AND", "THE"}


def deployed(led, stm):
    a = d = v = e = 0.0
    if led["amount"] is not None and stm["amount"] is not None:
        diff, size = abs(stm["amount"] - led["amount"]), abs(led["amount"])
        if diff <= 0.01:
            a = 0.4
        elif diff <= max(0.01, size * 0.02):
            a = 0.35
        elif diff <= size * 0.05:
            a = 0.2
    if led["date"] is not None and stm["date"] is not None:
        d = 0.25 if led["date"] == stm["date"] else 0.15
    if led["vendor"] is not None and stm["vendor"] is not None:
        x, y = led["vendor"].upper().strip(), stm["vendor"].upper().strip()
        if x == y:
            v = 0.25
        elif x in y or y in x:
            v = 0.2
        elif set(x.split()) & set(y.split()):
            v = 0.1
    if led["description"] and stm["description"]:
        x, y = led["description"].upper().strip(), stm["description"].upper().strip()
        if x and y:
            if x == y:
                e = 0.1
            elif x in y or y in x:
                e = 0.05
    return a + d + v + e


def clean(text):
    if not text:
        return text
    return " ".join(w for w in text.strip().upper().split() if w not in STOP)


def _similar(x, y, over_union):
    ratio = SequenceMatcher(None, x, y).ratio()
    p, q = set(x.split()), set(y.split())
    if p and q:
        low = len(p | q) if over_union else max(len(p), len(q))
        ratio = max(ratio, len(p & q) / low)
    return ratio


def graded(led, stm):
    x, y = led["amount"] or 0.0, stm["amount"] or 0.0
    diff, mean = abs(x - y), (abs(x) + abs(y)) / 2
    scale = max(0.01, mean * 0.02)
    steps = [(0.01, 1.0), (scale if mean else -1, 0.9), (scale * 3 if mean else -1, 0.7), (scale * 5 if mean else -1, 0.5)]
    a = next((s for limit, s in steps if diff <= limit), 0.0)
    d = 0.0
    if led["date"] is not None and stm["date"] is not None:
        days = abs((led["date"] - stm["date"]).days)
        d = 1.0 if days == 0 else 1.0 - days / 3 * 0.3 if days <= 3 else 0.5 if days <= 6 else 0.0
    v = e = 0.0
    x, y = clean(led["vendor"]), clean(stm["vendor"])
    if x and y:
        v = 1.0 if x == y else 0.9 if x in y or y in x else _similar(x, y, True)
    x, y = clean(led["description"]), clean(stm["description"])
    if x and y:
        e = 1.0 if x == y else _similar(x, y, False)
    total = 0.0
    for part in (a * 0.4, d * 0.25, v * 0.25, e * 0.1):
        total += part
    return total


def serial(ledger, statement, profile):
    """{statement id: ledger id} per session by the one-after-another procedure."""
    out = {}
    for s in sorted(statement, key=lambda r: r["txn_id"]):
        best = None
        for led in sorted(ledger, key=lambda r: r["txn_id"]):
            if led["txn_id"] in out.values():
                continue
            if profile == "deployed":
                score = deployed(led, s)
                fits = score > 0.3
            else:
                score = round(graded(led, s) + 1e-12, 3)
                fits = score >= 0.3
            if fits and (best is None or score > best[0]):
                best = (score, led["txn_id"])
        if best:
            out[s["txn_id"]] = best[1]
    return out


def serial_edges(edges):
    """Same procedure over given (stmt, led, score) edges."""
    out = {}
    for s in sorted({e[0] for e in edges}):
        free = [(-score, led) for st, led, score in edges if st == s and led not in out.values()]
        if free:
            out[s] = min(free)[1]
    return out
