"""Cross-validated least-squares scores of feature masks as SQL, and searches over them."""

from __future__ import annotations

from featurelab.plans.generation_sql import crossed, kept, mutated

REFUSED = "-1e36::DOUBLE"


def mask_scores(facts: str, masks: str, features: list[str], folds: int, max_features: int) -> list[str]:
    """Relations up to mask_scores (genome, score) for the genomes of ``masks``.

    ``facts`` has fold, the features and y. The normal equations of every mask and fold are
    solved by elimination, one feature after the other.
    """
    names = [*features, "y"]
    size, target = len(features), len(features)
    pairs = [(i, j) for i in range(size + 1) for j in range(size + 1)]
    sums = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS c_{i}_{j}" for i, j in pairs)
    means = ", ".join(f"avg({n}) AS m_{i}" for i, n in enumerate(names))
    ones = "length(replace(genome, '0', ''))"
    fits = f"{ones} BETWEEN 1 AND {max_features}"
    parts = [
        f"asked AS MATERIALIZED (SELECT DISTINCT genome FROM {masks})",
        f"moments AS MATERIALIZED (SELECT k, {sums}, {means} FROM {facts}, range(0, {folds}) t(k) WHERE fold <> k GROUP BY k)",
        "matrix AS MATERIALIZED ("
        + " UNION ALL ".join(f"SELECT k, {i} AS i, {j} AS j, c_{i}_{j} AS v FROM moments" for i, j in pairs)
        + ")",
        f"solved_0 AS MATERIALIZED (SELECT genome, k, i, j, v FROM asked, matrix WHERE {fits})",
    ]
    for p in range(size):
        parts.append(f"""
solved_{p + 1} AS MATERIALIZED (
  SELECT a.genome, a.k, a.i, a.j,
         CASE WHEN substr(a.genome, {p + 1}, 1) = '0' THEN a.v
              WHEN a.i = {p} THEN a.v / d.v ELSE a.v - c.v * r.v / d.v END AS v
  FROM solved_{p} a
  JOIN (SELECT genome, k, v FROM solved_{p} WHERE i = {p} AND j = {p}) d ON a.genome = d.genome AND a.k = d.k
  JOIN (SELECT genome, k, j, v FROM solved_{p} WHERE i = {p}) r ON a.genome = r.genome AND a.k = r.k AND a.j = r.j
  JOIN (SELECT genome, k, i, v FROM solved_{p} WHERE j = {p}) c ON a.genome = c.genome AND a.k = c.k AND a.i = c.i)""")
    weights = ", ".join(
        f"sum(CASE WHEN i = {i} AND substr(genome, {i + 1}, 1) = '1' THEN v ELSE 0 END) AS w_{i}" for i in range(size)
    )
    base = f"m_{target} - " + " - ".join(f"w_{i} * m_{i}" for i in range(size))
    predicted = "base + " + " + ".join(f"w_{i} * {n}" for i, n in enumerate(features))
    parts += [
        f"""
weights AS MATERIALIZED (
  SELECT genome, k, {base} AS base, {", ".join(f"w_{i}" for i in range(size))}
  FROM (SELECT genome, k, {weights} FROM solved_{size} WHERE j = {target} GROUP BY genome, k) JOIN moments USING (k))""",
        f"""
errors AS (SELECT genome, fold, avg(abs(y - greatest(0, {predicted}))) AS e FROM {facts} JOIN weights ON fold = k GROUP BY genome, fold)""",
        f"""
mask_scores AS MATERIALIZED (
  SELECT genome, -avg(e) - 0.00001::DOUBLE * {ones} AS score FROM errors GROUP BY genome
  UNION ALL SELECT genome, {REFUSED} FROM asked WHERE NOT ({fits}))""",
    ]
    return parts


def every_mask(size: int) -> str:
    return f"masks AS (SELECT lpad(bin(i), {size}, '0') AS genome FROM range(0, {2**size}) t(i))"


def search(source: str, size: int, count: int) -> tuple[list[str], str]:
    """Relations of a search from ``source`` (run_id, idx, genome, n, pc, pm) scored by
    mask_scores, and the name of the last population."""
    parts = [
        f"""
ranked AS MATERIALIZED (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, idx) - 1 AS idx, genome, score, n, pc, pm
  FROM {source} JOIN mask_scores USING (genome))"""
    ]
    parents = "ranked"
    for step in range(count):
        parts += [
            crossed(parents, size, step),
            mutated(f"crossed_{step}", size, step),
            f"children_{step} AS MATERIALIZED (SELECT * FROM mutated_{step} JOIN mask_scores USING (genome))",
            kept(parents, step, scored=f"children_{step}"),
        ]
        parents = f"kept_{step}"
    return parts, parents
