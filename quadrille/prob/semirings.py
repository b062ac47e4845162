"""Tags of facts: how alternatives add up, how premises combine, and what negation is.

Lineage tags are disjunctions of proofs: sorted arrays of sorted arrays of seed numbers, negative
for negated seeds.  They are combined by array functions in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


@dataclass(frozen=True)
class Semiring:
    name: str
    plus: object  # column name -> aggregate
    plus2: object  # two columns
    times: object  # list of columns
    negate: object
    one: object
    nonzero: object
    differs: object
    idempotent: bool = True


def _noisy_or(c: str) -> Column:
    # log1p(-1) has no value in Spark
    return F.when(F.max(c) >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(F.col(c) < 1, F.col(c)).otherwise(F.lit(0.0))))))


_product = lambda cols: reduce(lambda a, b: a * b, cols)
_least = lambda cols: cols[0] if len(cols) == 1 else F.least(*cols)
_moved = lambda a, b: F.abs(a - b) > EPSILON

EMPTY = "array<array<bigint>>"


def once(c: Column, use) -> Column:
    """use(c) with c worked out once: a lambda's body would work it out again for each element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _minimal(sound: Column) -> Column:
    """Without proofs that hold another one; of proofs of one size none does."""
    sizes = F.transform(sound, F.size)
    smaller = lambda x: F.exists(sound, lambda y: (F.size(y) < F.size(x)) & (F.size(F.array_except(y, x)) == 0))
    return F.when(F.array_min(sizes) == F.array_max(sizes), sound).otherwise(F.filter(sound, lambda x: ~smaller(x)))


def prune(d: Column) -> Column:
    """Proofs without contradiction, each once, none that holds another; in order."""
    # the least seed comes first: only a proof with a negated one can contradict itself
    sound = lambda x: ~(F.coalesce(F.get(x, F.lit(0)) < 0, F.lit(False)) & F.exists(x, lambda l: F.array_contains(x, -l)))
    each = lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))
    return once(d, lambda d: F.when(F.size(d) < 2, F.filter(d, sound)).otherwise(once(F.filter(once(F.sort_array(d), each), sound), _minimal)))


def conjunction(a: Column, b: Column) -> Column:
    merged = lambda x, y: F.sort_array(F.array_union(x, y))
    simple = (F.size(a) == 1) & (F.size(b) == 1) & ~F.coalesce((F.get(F.get(a, F.lit(0)), F.lit(0)) < 0) | (F.get(F.get(b, F.lit(0)), F.lit(0)) < 0), F.lit(False))
    return F.when(simple, F.array(merged(F.get(a, F.lit(0)), F.get(b, F.lit(0))))).otherwise(prune(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: merged(x, y))))))


def lineage_one() -> Column:
    return F.array(F.array().cast("array<bigint>"))


def known(seeds: Column) -> Column:
    """Each seed once: structs of seed, prob (and grp) in order of the seeds."""
    each = lambda s: F.filter(s, lambda x, i: (i == 0) | (x["seed"] != F.get(s, i - 1)["seed"]))
    return once(F.sort_array(seeds), each)


def weighted(seed_type: str) -> Semiring:
    """Lineage that carries what is known of its seeds, d and w: no fact looks them up again."""
    pair = lambda d, w: F.named_struct(F.lit("d"), d, F.lit("w"), w)
    plus = lambda c: once(F.collect_list(c), lambda all_: pair(prune(F.flatten(F.transform(all_, lambda x: x["d"]))), known(F.flatten(F.transform(all_, lambda x: x["w"])))))
    plus2 = lambda a, b: pair(prune(F.concat(a["d"], b["d"])), known(F.concat(a["w"], b["w"])))
    times = lambda cols: pair(reduce(conjunction, [c["d"] for c in cols]), F.concat(*[c["w"] for c in cols]))
    one = lambda: pair(lineage_one(), F.array().cast(seed_type))
    return Semiring("weighted", plus, plus2, times, lambda a: pair(complement(a["d"]), a["w"]), one, lambda c: F.size(c["d"]) > 0, lambda a, b: a["d"] != b["d"])


def complement(d: Column) -> Column:
    """De Morgan: for each proof some seed of it is otherwise."""
    step = lambda acc, clause: F.flatten(F.transform(acc, lambda x: F.transform(clause, lambda l: F.array_sort(F.array_union(x, F.array(-l))))))
    return prune(F.aggregate(d, lineage_one(), step))


SEMIRINGS = {
    "minmax": Semiring("minmax", F.max, lambda a, b: F.greatest(a, b), _least, lambda a: 1 - a, lambda: F.lit(1.0), lambda c: c > 0, _moved),
    "addmult": Semiring("addmult", _noisy_or, lambda a, b: a + b - a * b, _product, lambda a: 1 - a, lambda: F.lit(1.0), lambda c: c > 0, _moved, False),
    "boolean": Semiring("boolean", F.bool_or, lambda a, b: a | b, lambda cols: reduce(lambda a, b: a & b, cols), lambda a: ~a, lambda: F.lit(True), lambda c: c, lambda a, b: a != b),
    "expiration": Semiring("expiration", F.max, lambda a, b: F.greatest(a, b), _least, lambda a: F.lit(0).cast("long"), lambda: F.lit(2**62).cast("long"), lambda c: c > 0, lambda a, b: a != b),
    "lineage": Semiring("lineage", lambda c: prune(F.flatten(F.collect_list(c))), lambda a, b: prune(F.concat(a, b)), lambda cols: reduce(conjunction, cols), complement, lineage_one, lambda c: F.size(c) > 0, lambda a, b: a != b),
}
SEMIRINGS["min"] = SEMIRINGS["minmax"]
SEMIRINGS["independent"] = SEMIRINGS["addmult"]
#: Names a rule may give, by how they are evaluated.
LINEAGE = ("topk", "wmc", "sdd", "hybrid")


def named(name: str) -> str:
    """The semiring's name; unknown ones are minmax."""
    return name if name in SEMIRINGS or name in LINEAGE else "minmax"
