"""The same tables as DuckDB SQL in long form, for the oracle."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import draws as D

SAMPLES = "samples AS (SELECT o_orderkey AS sample_ix, o_custkey AS cluster_key, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit FROM orders WHERE substr(o_orderpriority, 1, 1) BETWEEN '1' AND '4')"


def _values(name: str, values: Sequence[int]) -> str:
    return f"(VALUES {', '.join(f'({v})' for v in values)}) AS {name}_t({name})"


def pred(seeds: Sequence[int] = (43,), models: Sequence[int] = (0, 1), families: Sequence[int] = (0,), levels: Sequence[int] = (0,), head: str = "action", name: str = "pred") -> str:
    """CTE seed, model, family, level, sample_ix, cluster_key, class_ix, t, z."""
    labels, offset = (4, 0) if head == "action" else (21, 100)
    hit = "(class_ix = digit - 1 OR (sample_ix * 7 + class_ix * 3) % 11 = 0)" if head == "action" else "((sample_ix * 31 + class_ix * 17) % 100 < 12)"
    grid = ", ".join([_values("seed", seeds), _values("model", models), _values("family", families), _values("level", levels), f"range({labels}) AS class_t(class_ix)"])
    return f"""{name} AS (SELECT seed, model, family, level, sample_ix, cluster_key, digit, CAST(class_ix AS INTEGER) AS class_ix, CASE WHEN {hit} THEN 1 ELSE 0 END AS t,
      CAST((CASE WHEN {hit} THEN 300 ELSE -300 END) + ((sample_ix * 7919 + (class_ix + {offset}) * 104729 + CAST(seed AS BIGINT) * 1299709 + CAST(model AS BIGINT) * 15485863
        + (CASE WHEN level > 0 THEN CAST(family AS BIGINT) * 32452843 + CAST(level AS BIGINT) * 49979687 ELSE 0 END)) % 1201) - 600 AS DOUBLE) / 250 AS z
      FROM samples, {grid})"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


#: Per sample: e exact-set error, conf the greatest probability.
PER = """per AS (SELECT seed, model, family, level, sample_ix, cluster_key, max(CASE WHEN (z >= 0) <> (t = 1) THEN 1 ELSE 0 END) AS e,
      max(1 / (1 + exp(-z))) AS conf FROM pred GROUP BY ALL)"""


_MASK = D.MASK
_ROUNDS = (f"xor(x, x >> 16) * {D.FIRST} & {_MASK}", f"xor(x, x >> 15) * {D.SECOND} & {_MASK}", "xor(x, x >> 16)")


def _mixed(columns: str, x: str, source: str) -> str:
    """columns and x, mixed, from source; a round is a subquery, as each reads x twice."""
    out = f"SELECT {columns}, {x} AS x {source}"
    for step in _ROUNDS:
        out = f"SELECT {columns}, {step} AS x FROM ({out})"
    return out


def keyed(source: str, stream: int, columns: str = "rep") -> str:
    """columns of source, which has rep, with the two keys k1, k2 of each replicate."""
    first, second = (int(D.mix(D._u([stream + more]))[0]) for more in (0, D.SALT))
    one = _mixed(columns, f"xor({first}, rep)", f"FROM ({source})")
    two = _mixed(f"{columns}, k1", f"({second} + rep * {D.REPLICATE}) & {_MASK}", f"FROM (SELECT {columns}, x AS k1 FROM ({one}))")
    return f"SELECT {columns}, k1, x AS k2 FROM ({two})"


def word(columns: str, a: str, b: str, source: str) -> str:
    """columns and x: 32 random bits of the counter (a, b) for the keys k1, k2 of source."""
    inner = _mixed(f"{columns}, k1, k2" + (f", {b}" if b.isidentifier() else ""), f"xor(k1, {a})", f"FROM ({source})")
    return f"SELECT {columns}, x FROM ({_mixed(columns, f'(x + k2 + ({b}) * {D.STEP}) & {_MASK}', f'FROM ({inner})')})"


def draws_of(source: str, stream: int = D.CLUSTERS, name: str = "drawn") -> str:
    """CTEs of which name(rep, position, weight) has the draws of each (rep, n) of source: n out of n, by binary splitting."""
    whole = f"n // {D.LEAF} * {D.LEAF}"
    head = word("rep, n, slot", "slot", "0", f"SELECT rep, n, k1, k2, unnest(range(n)) AS slot FROM {name}_keys")
    bit = "CAST(floor(log2(xor(x, w))) AS BIGINT)"
    steps = f"list_transform(range(0, CAST((m + 31) // 32 AS BIGINT)), lambda k: (x + k2 + (k + 1) * {D.STEP}) & {_MASK})"
    for step in _ROUNDS:
        steps = f"list_transform({steps}, lambda x: {step})"
    ones = f"CAST(coalesce(list_sum(list_transform({steps}, lambda v, i: bit_count(v & ((CAST(1 AS BIGINT) << CAST(least(32, m - 32 * (i - 1)) AS INTEGER)) - 1)))), 0) AS BIGINT)"
    node = _mixed("rep, k1, k2, lo, size, m", "xor(k1, lo + size // 2)", f"FROM {name}_tree WHERE size > {D.LEAF}")
    leaf = word("rep, lo, size", f"(lo + {D.LEAF_MARK})", "j", f"SELECT rep, k1, k2, lo, size, unnest(range(m)) AS j FROM {name}_tree WHERE size <= {D.LEAF}")
    return f"""{name}_keys AS MATERIALIZED ({keyed(source, stream, "rep, n")}),
  {name}_heads AS (SELECT rep, lo, size, count(*) AS m FROM (SELECT rep, CASE WHEN x >= w THEN w ELSE w >> ({bit} + 1) << ({bit} + 1) END AS lo, CASE WHEN x >= w THEN n - w ELSE CAST(1 AS BIGINT) << {bit} END AS size FROM (SELECT rep, n, x * n >> 32 AS x, {whole} AS w FROM ({head}))) GROUP BY ALL),
  {name}_tree AS (SELECT rep, k1, k2, lo, size, m FROM {name}_heads JOIN {name}_keys USING (rep) UNION ALL SELECT rep, k1, k2, CASE side WHEN 0 THEN lo ELSE lo + size // 2 END, size // 2, CASE side WHEN 0 THEN l ELSE m - l END
    FROM (SELECT rep, k1, k2, lo, size, m, side, l FROM (SELECT rep, k1, k2, lo, size, m, {ones} AS l FROM ({node})), range(2) AS s(side)) WHERE CASE side WHEN 0 THEN l ELSE m - l END > 0),
  {name} AS (SELECT rep, lo + (x * size >> 32) AS position, count(*) AS weight FROM ({leaf}) GROUP BY ALL)"""


def draws(n: str, reps: int, name: str = "drawn", stream: int = D.CLUSTERS) -> str:
    """CTEs of name(rep, position, weight) for a scalar subquery n."""
    return draws_of(f"SELECT rep, n FROM ({n}) AS q(n), range({reps}) AS r(rep)", stream, name)


def choices(stream: int, reps: int, slots: int, n: int) -> str:
    """rep, slot and x, one of n, for each slot of each replicate."""
    return f"SELECT rep, slot, x * {n} >> 32 AS x FROM ({word('rep, slot', 'slot', '0', f'SELECT rep, k1, k2, slot FROM ({keyed(f"SELECT rep FROM range({reps}) AS r(rep)", stream)}), range({slots}) AS s(slot)')})"


def seed_slots(reps: int) -> str:
    return f"""slots AS (SELECT rep, slot, 43 + x AS seed FROM ({choices(D.SEEDS, reps, 5, 5)}))"""


def seed_draws(reps: int) -> str:
    return f"""{seed_slots(reps)}, seeds AS (SELECT rep, seed, count(*) AS times FROM slots GROUP BY ALL)"""
