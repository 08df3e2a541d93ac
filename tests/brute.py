"""The rules by their definitions, trace by trace."""

from collections import Counter, defaultdict

ORDERED = ("response", "precedence", "succession", "alternate-response", "alternate-precedence", "alternate-succession",
           "chain-response", "chain-precedence", "chain-succession", "not-chain-succession", "not-succession")


def rule_rows(traces: dict[str, list[str]]) -> dict[tuple, set]:
    out: dict[tuple, set] = defaultdict(set)
    types = sorted({e for s in traces.values() for e in s})
    counts = {t: Counter(s) for t, s in traces.items()}
    for t, s in traces.items():
        out["first", s[0], None].add(t)
        if len(s) > 1:
            out["last", s[-1], None].add(t)
    for a in types:
        ks = {c[a] for c in counts.values() if c[a]}
        for k in ks:
            for t, c in counts.items():
                if c[a] == k:
                    out["exactly", a, str(k)].add(t)
                if c[a] >= k:
                    out["existence", a, str(k)].add(t)
        for k in ks | {max(ks) + 1}:
            for t, c in counts.items():
                if c[a] < k:
                    out["absence", a, str(k)].add(t)
        for b in types:
            for t, c in counts.items():
                x, y = c[a] > 0, c[b] > 0
                if x and y:
                    out["responded existence", a, b].add(t)
                if x == y:
                    out["co-existence", a, b].add(t)
                if (a < b and not (x and y)) or (a >= b and not x and not y):
                    out["not co-existence", a, b].add(t)
                if a < b and (x or y):
                    out["choice", a, b].add(t)
                if a < b and x != y:
                    out["exclusive choice", a, b].add(t)
            for t, s in traces.items():
                at, bt = [i for i, e in enumerate(s) if e == a], [i for i, e in enumerate(s) if e == b]
                if not at or not bt:
                    continue
                resp = any(i < j for i in at for j in bt)
                if not resp:
                    continue
                out["response", a, b].add(t)
                prec = any(i < j for i in at for j in bt) and not any(j < at[0] for j in bt)
                if prec and (a != b or len(at) >= 2):
                    out["precedence", a, b].add(t)
                    out["succession", a, b].add(t)
                altr = a != b and all(any(x < j < y for j in bt) for x, y in zip(at, [*at[1:], len(s)]))
                altp = all(any(x < i < y for i in at) for x, y in zip([-1, *bt[:-1]], bt)) if a != b else len(at) >= 2
                chr_ = a != b and all(i + 1 < len(s) and s[i + 1] == b for i in at)
                chp = a != b and all(j > 0 and s[j - 1] == a for j in bt)
                for name, ok in (("alternate-response", altr), ("alternate-precedence", altp), ("alternate-succession", altr and altp), ("chain-response", chr_),
                                 ("chain-precedence", chp), ("chain-succession", chr_ and chp), ("not-chain-succession", altr and not chr_)):
                    if ok:
                        out[name, a, b].add(t)
    for (rule, a, b), ts in list(out.items()):
        if rule == "response" and set(traces) - ts:
            out["not-succession", a, b] = set(traces) - ts
    return dict(out)
