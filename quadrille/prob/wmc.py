"""Exact probability of a disjunction of proofs, and bounds for it: small pure functions for Python workers."""

from __future__ import annotations

from dataclasses import dataclass


class Budget(Exception):
    """More nodes than permitted."""


def probability(dnf, prob: dict[int, float], group: dict[int, int] | None = None, nodes: int | None = None) -> float:
    """Weighted model count by Shannon expansion with memo; proofs that share no seed and no group are counted apart.

    Seeds of one group exclude each other: at most one of them holds, with its own weight.
    """
    group = group or {}
    if not group and all(dnf) and (nodes is None or len(dnf) < nodes) and len({abs(x) for c in dnf for x in c}) == sum(map(len, dnf)):
        none = 1.0  # no two proofs share a seed
        for c in dnf:
            none *= 1 - weight(c, prob)
        return 1 - none
    memo: dict = {}
    count = 0
    members: dict[int, list[int]] = {}
    for x, g in group.items():
        members.setdefault(g, []).append(x)

    def given(d, true: frozenset, false: frozenset):
        out = set()
        for c in d:
            if any(-x in true or x in false if x > 0 else -x in true for x in c):
                continue
            left = frozenset(x for x in c if not (x in true or -x in false))
            if not left:
                return None  # a proof holds whatever else is
            out.add(left)
        return minimal(out)

    def independent(d) -> list:
        parent: dict = {}  # of seeds and groups

        def root(k):
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        firsts = []
        for c in d:
            keys = [("group", group[abs(x)]) if abs(x) in group else abs(x) for x in c]
            first = root(keys[0])
            for k in keys[1:]:
                parent[root(k)] = first
            firsts.append((keys[0], c))
        out: dict = {}
        for k, c in firsts:
            out.setdefault(root(k), []).append(c)
        return [frozenset(proofs) for proofs in out.values()]

    def grouped(d, g) -> float:
        """Cases of a group: each member that a proof names, and none of these, whose weight is what is left."""
        used: dict[int, list] = {}
        free, odd = [], []
        for c in d:
            own = [x for x in c if group.get(abs(x)) == g]
            if not own:
                free.append(c)
            elif len(own) == 1 and own[0] > 0:
                used.setdefault(own[0], []).append(c)
            else:  # several members, or one negated
                odd.append(c)
                for x in own:
                    used.setdefault(abs(x), [])
        everyone = frozenset(used)
        named = sum(prob[m] for m in used)
        unnamed = sum(prob[m] for m in members[g]) - named
        # members that no proof names are one case with none at all
        left = max(0.0, unnamed) + (rest if (rest := 1 - named - unnamed) > 1e-12 else 0.0)
        case = lambda m, own: given([*free, *own, *odd], frozenset([m]), everyone - {m} if odd else frozenset())
        out = sum(prob[m] * (1.0 if any(len(c) == 1 for c in own) else solve(case(m, own))) for m, own in used.items())
        return out + left * solve(given([*free, *odd], frozenset(), everyone)) if left > 0 else out

    def solve(d) -> float:
        nonlocal count
        if d is None:
            return 1.0
        if not d:
            return 0.0
        if d in memo:
            return memo[d]
        count += 1
        if nodes is not None and count > nodes:
            raise Budget(count)
        if len(d) == 1 and not any(abs(x) in group for c in d for x in c):
            memo[d] = weight(*d, prob)
            return memo[d]
        apart = independent(d)
        if len(apart) > 1:
            none = 1.0
            for x in apart:
                none *= 1 - solve(x)
            memo[d] = 1 - none
            return 1 - none
        uses: dict[int, int] = {}
        for c in d:
            for x in c:
                uses[abs(x)] = uses.get(abs(x), 0) + 1
        v = max(uses, key=lambda x: (uses[x], -x))
        if v in group:
            out = grouped(d, group[v])
        else:
            out = prob[v] * solve(given(d, frozenset([v]), frozenset())) + (1 - prob[v]) * solve(given(d, frozenset(), frozenset([v])))
        memo[d] = out
        return out

    start = frozenset(frozenset(c) for c in dnf)
    if any(not c for c in start):
        return 1.0
    return solve(frozenset(c for c in minimal(start) if not any(-x in c for x in c)))


def minimal(proofs) -> frozenset:
    """Without proofs that hold another one; of proofs of one size none does."""
    if len({len(c) for c in proofs}) < 2:
        return frozenset(proofs)
    by: dict[int, list] = {}  # proofs so far, by their least seed
    for c in sorted(proofs, key=len):
        if not any(o < c for x in c for o in by.get(x, ())):
            by.setdefault(min(c), []).append(c)
    return frozenset(c for own in by.values() for c in own)


def gradient(dnf, prob: dict[int, float], group: dict[int, int] | None = None) -> dict[int, float]:
    """Change of the probability per seed: with it less without it; in a group, with it."""
    group = group or {}
    out = {}
    for v in {abs(x) for c in dnf for x in c}:
        if v in group:
            members = [x for x in group if group[x] == group[v]]
            out[v] = probability(dnf, prob | {m: float(m == v) for m in members}, group)
        else:
            out[v] = probability(dnf, prob | {v: 1.0}, group) - probability(dnf, prob | {v: 0.0}, group)
    return out


def weight(proof, prob: dict[int, float]) -> float:
    out = 1.0
    for x in proof:
        out *= prob[x] if x > 0 else 1 - prob[-x]
    return out


def best_proofs(dnf, prob: dict[int, float], k: int) -> list:
    return sorted(dnf, key=lambda c: (-weight(c, prob), sorted(c)))[:k]


@dataclass(frozen=True)
class HybridOptions:
    threshold: float = 0.5
    policy: str = "fixed"
    band_epsilon: float = 0.02
    marginal_floor: float = 1e-4
    k_initial: int = 8
    k_max: int = 64
    k_growth: int = 2
    topk_budget_ms: float = 25
    sdd_budget_ms: float = 250
    node_budget: int = 100_000

    @staticmethod
    def of(options: dict) -> HybridOptions:
        known = {"threshold", "band_epsilon", "marginal_floor", "k_initial", "k_max", "k_growth", "topk_budget_ms", "sdd_budget_ms", "node_budget"}
        if extra := set(options) - known - {"provenance", "confidence"}:
            raise ValueError(f"unknown options {sorted(extra)}")
        o = {k: v for k, v in options.items() if k in known}
        policy, t = "fixed", o.get("threshold", 0.5)
        if isinstance(t, tuple):
            cost = t[1]
            policy, t = "auto:cost", cost["fp"] / (cost["fp"] + cost["fn"])
        o["threshold"] = float(t)
        for k in ("k_initial", "k_max", "k_growth", "node_budget"):
            if k in o:
                o[k] = int(o[k])
        out = HybridOptions(**o, policy=policy)
        if not 0 <= out.threshold <= 1 or not 1 <= out.k_initial <= out.k_max or out.k_growth < 2 or out.node_budget < 1:
            raise ValueError("hybrid options out of range")
        return out


def evaluate(dnf, prob: dict[int, float], group: dict[int, int], o: HybridOptions) -> dict:
    """Lower and upper bounds from the best proofs, more of them while that may decide, then exactly within the node budget."""
    def result(status, reason, lower, upper, estimate, k, exact):
        decision = "Alert" if lower >= o.threshold else "NoAlert" if upper < o.threshold else "Indeterminate"
        return {"status": status, "decision": decision, "reason": reason, "lower": lower, "upper": upper, "estimate": estimate, "k": k, "exact": exact}

    lower, upper, k = 0.0, 1.0, 0
    monotone = all(x > 0 for c in dnf for x in c) and not any(abs(x) in group for c in dnf for x in c)
    if monotone:
        ranked = best_proofs(dnf, prob, len(dnf))
        k, before = min(o.k_initial, o.k_max), None
        while True:
            lower = probability(ranked[:k], prob)
            upper = min(1.0, lower + sum(weight(c, prob) for c in ranked[k:]))
            if len(ranked) <= k:
                return result("Exact", "TopKExhausted", lower, lower, lower, k, False)
            if lower >= o.threshold or upper < o.threshold:
                return result("Bounded", "Threshold", lower, upper, (lower + upper) / 2, k, False)
            near, climbing = abs(o.threshold - lower) <= o.band_epsilon, before is None or lower - before >= o.marginal_floor
            if k >= o.k_max or not near and not climbing:
                break
            before, k = lower, min(k * o.k_growth, o.k_max)
    try:
        p = probability(dnf, prob, group, o.node_budget)
        return result("Exact", "ExactCompilation", p, p, p, k, True)
    except Budget:
        return result("NeedsExact", "NodeBudget", lower, upper, (lower + upper) / 2, k, True)
