"""Menu algebra and score algebra as column expressions over array columns; all stay in the JVM.

A menu is a pair of parallel arrays (option ids, and what belongs to each); positions count from 0. Order is meaning: the first of equal
maxima wins, and a reordering carries every parallel array along.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The floor of a probability under a logarithm, and the most options of a menu.
EPSILON, MOST_OPTIONS = 1e-12, 256


def total(xs: Column) -> Column:
    """Left-to-right sum of an array of doubles."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda an outer expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def top(q: Column) -> Column:
    """Position of the first maximum; null for an empty array."""
    return (F.array_position(q, F.array_max(q)) - 1).cast("int")


def at(xs: Column, position: Column) -> Column:
    return F.get(xs, position)


def softmax(z: Column, temperature: float = 1.0) -> Column:
    raised = let(F.array_max(z), lambda peak: F.transform(z, lambda x: F.exp((x - peak) / F.lit(float(temperature)))))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_sum_exp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda peak: peak + F.ln(total(F.transform(v, lambda x: F.exp(x - peak))))))


def log_softmax(z: Column) -> Column:
    return let(log_sum_exp(z), lambda bottom: F.transform(z, lambda x: x - bottom))


def renormalize(p: Column) -> Column:
    """p / sum(p); null where the sum is zero."""
    return let(p, lambda v: let(total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s))))


def rank_of(q: Column, position: Column) -> Column:
    """1 + the number of positions before this one in stable descending order."""
    return let(at(q, position), lambda mine: F.size(F.filter(q, lambda x, i: (x > mine) | ((x == mine) & (i < position)))) + 1)


def squared_error(q: Column, gold: Column) -> Column:
    return total(F.transform(q, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def entropy(p: Column, base: str = "e") -> Column:
    log = F.ln if base == "e" else F.log2
    return -total(F.transform(p, lambda x: F.when(x > 0, x * log(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0)))


def cumulative(p: Column) -> Column:
    """Running sums from the left, in double order."""
    empty = F.array().cast("array<double>")
    return F.aggregate(p, F.struct(F.lit(0.0).alias("s"), empty.alias("out")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out")), lambda a: a["out"])


def confidence(p: Column) -> Column:
    """(k max - 1) / (k - 1), cut to 0..1."""
    k = F.size(p)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(k * F.array_max(p) - 1, k - 1)))


def expectation(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def smoothed(target: Column, eps: float) -> Column:
    return F.transform(target, lambda t: (1 - eps) * t + F.lit(eps) / F.size(target))


def cross_entropy(log_p: Column, target: Column) -> Column:
    return -total(F.zip_with(log_p, target, lambda lp, t: F.when(t > 0, t * lp).otherwise(0.0)))


def one_hot(k: Column, gold: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == gold, 1.0).otherwise(0.0))


def taken(xs: Column, rows: Column) -> Column:
    """xs at `rows`, in that order."""
    return F.transform(rows, lambda r: F.get(xs, r))


def position_of(xs: Column, x: Column) -> Column:
    """0-based position, null if absent."""
    p = F.array_position(xs, x)
    return F.when(p > 0, (p - 1).cast("int"))


def alignment(a: Column, b: Column) -> Column:
    """For each option of a its row in b, null where b lacks it."""
    return F.transform(a, lambda c: position_of(b, c))


def uniform(*key: Column) -> Column:
    """A reproducible number in [0, 1) from a key: 52 bits of sha256, equal on any engine that has it."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def digest(*key: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)


def hash_order(xs: Column, *key: Column) -> Column:
    """Positions of xs in the order of sha256(key, element)."""
    pairs = F.transform(xs, lambda x, i: F.struct(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key], x.cast("string")), 256).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def compose_menu(gold: Column, pool: Column, k: Column, *key: Column) -> Column:
    """The gold option and k-1 others of the pool by hash order, shuffled by a second hash; k is cut to the pool's size."""
    others = F.filter(pool, lambda c: c != gold)
    chosen = F.slice(taken(others, hash_order(others, *key, F.lit("pick"))), 1, F.least(k, F.size(others) + 1) - 1)
    menu = F.concat(chosen, F.array(gold))
    return taken(menu, hash_order(menu, *key, F.lit("order")))


def draw_k(lo: int, hi: int, u: Column, log: bool = False) -> Column:
    """A menu length in lo..hi from a uniform number; log-uniform on request."""
    if not log or lo >= hi:
        return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("int")
    import math

    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.round(F.exp(F.lit(math.log(lo)) + u * (math.log(hi) - math.log(lo)))).cast("int")))


def shuffled(k: Column, *key: Column) -> Column:
    return hash_order(F.sequence(F.lit(0), k - 1), *key)


def partner_rows(k: Column, *key: Column) -> Column:
    """A second row order that surely differs from the first: an identity is rotated by one."""
    rows = shuffled(k, *key)
    same = rows == F.sequence(F.lit(0), k - 1)
    return F.when(same, F.concat(F.slice(rows, 2, F.greatest(k - 1, F.lit(0))), F.slice(rows, 1, 1))).otherwise(rows)


def reorder(menu: dict[str, Column], rows: Column) -> dict[str, Column]:
    """options, names, gold_idx, target and decoy after a reordering or a subset; target is renormalised, a decoy that is gone is null. Null
    gold_idx marks a row set that lost the gold row: a violation, see violations()."""
    out = {"options": taken(menu["options"], rows)}
    if "names" in menu:
        out["names"] = taken(menu["names"], rows)
    out["gold_idx"] = position_of(rows, menu["gold_idx"])
    if "target" in menu:
        out["target"] = renormalize(taken(menu["target"], rows))
    if "decoy" in menu:
        out["decoy"] = F.when(F.array_contains(out["options"], menu["decoy"]), menu["decoy"])
    return out


def top_rows(scores: Column, gold: Column, n: int) -> Column:
    """The gold row and the n-1 others with the largest scores, in menu order."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((i == gold).cast("int").alias("g"), (-s).alias("s"), i.alias("i"))))
    others = F.slice(F.filter(ranked, lambda r: r["g"] == 0), 1, n - 1)
    return F.array_sort(F.concat(F.transform(others, lambda r: r["i"]), F.array(gold)))


def random_rows(k: Column, gold: Column, n: int, *key: Column) -> Column:
    others = F.filter(F.sequence(F.lit(0), k - 1), lambda i: i != gold)
    return F.array_sort(F.concat(F.slice(taken(others, hash_order(others, *key)), 1, n - 1), F.array(gold)))


def codes(k: Column, *key: Column) -> Column:
    """k distinct codes of 0..255 by hash order."""
    return F.slice(hash_order(F.sequence(F.lit(0), F.lit(MOST_OPTIONS - 1)), *key), 1, k)


def violations(options: Column, gold_idx: Column, label: Column, target: Column | None = None, decoy: Column | None = None, codes_: Column | None = None) -> Column:
    """The names of the invariants that a menu row breaks."""
    checks = [
        ("too_many_options", F.size(options) > MOST_OPTIONS),
        ("gold_off_menu", gold_idx.isNull() | (gold_idx < 0) | (gold_idx >= F.size(options))),
        ("label_not_gold", ~F.get(options, gold_idx).eqNullSafe(label)),
    ]
    if target is not None:
        bad = (F.size(target) != F.size(options)) | (F.array_min(target) < 0) | (F.abs(total(target) - 1) > 1e-6)
        checks.append(("bad_target", target.isNotNull() & bad))
    if decoy is not None:
        checks.append(("bad_decoy", decoy.isNotNull() & (~F.array_contains(options, decoy) | (decoy == F.get(options, gold_idx)))))
    if codes_ is not None:
        bad = (F.size(codes_) != F.size(options)) | (F.size(F.array_distinct(codes_)) != F.size(codes_)) | (F.array_min(codes_) < 0) | (F.array_max(codes_) >= MOST_OPTIONS)
        checks.append(("bad_codes", codes_.isNotNull() & bad))
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks)))


def lr_scale(step: Column, warmup: int, total_steps: int, kind: str) -> Column:
    """Warm-up, then constant, linear or cosine decay to zero."""
    import math

    rise = step / max(1, warmup)
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total_steps - warmup))
    after = {"constant": F.lit(1.0), "linear": 1 - done, "cosine": 0.5 * (1 + F.cos(done * math.pi))}[kind]
    return F.when(step < warmup, rise).otherwise(after)
