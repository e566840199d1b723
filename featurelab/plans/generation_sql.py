"""Generations of a genetic search as SQL, for comparison with the DataFrame steps.

A population is a relation (run_id, idx, genome, score, n, pc, pm). ``size`` is the number
of genes, ``step`` the generation, which enters the draws, and ``tag`` ends the names of the
relations.
"""

from __future__ import annotations

from featurelab.plans.fixtures import sql_draw, sql_int

ONES = "CAST(length(replace(genome, '0', '')) AS DOUBLE)"


def ranked(source: str, tag: str = "") -> str:
    """Population relation from (run_id, idx, genome, n, pc, pm), scored by OneMax."""
    return f"""
ranked{tag} AS MATERIALIZED (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, idx) - 1 AS idx, genome, score, n, pc, pm
  FROM (SELECT *, {ONES} AS score FROM {source}))"""


def crossed(source: str, size: int, step: int = 0, tag: str = "") -> str:
    t = f"{tag}_{step}"
    pair, half = "least(idx, n - 1 - idx)", f"CAST(round_even({size} / 2.0, 0) AS BIGINT)"

    def cut(genome: str, start: str, stop: str) -> str:
        return f"substr({genome}, CAST({start} + 1 AS INT), CAST({stop} - {start} AS INT))"

    slices = [
        cut("other", "0", "e"), cut("genome", "e", "c"), cut("other", "c", "s"), cut("genome", "s", str(size)),
    ]
    return f"""
pairs{t} AS (
  SELECT *, {pair} AS pair, {sql_int(f"{size} + 1", "run_id", str(step), pair, "'cut'")} AS c,
         {sql_draw("run_id", str(step), pair, "'cross'")} AS u FROM {source}),
cuts{t} AS (
  SELECT a.*, b.genome AS other, greatest(0, a.c + {half} - {size}) AS e, least(a.c + {half}, {size}) AS s
  FROM pairs{t} a JOIN pairs{t} b ON a.run_id = b.run_id AND b.idx = a.n - 1 - a.idx),
crossed{t} AS (
  SELECT run_id, idx, n, pc, pm,
         CASE WHEN pair < n // 2 AND u < pc THEN {" || ".join(slices)} ELSE genome END AS genome
  FROM cuts{t})"""


def mutated(source: str, size: int, step: int = 0, pm: str = "pm", tag: str = "") -> str:
    t = f"{tag}_{step}"
    gene = sql_int(str(size), "run_id", str(step), "idx", "'gene'")
    return f"""
drawn{t} AS (
  SELECT *, {gene} AS g, {sql_draw("run_id", str(step), "idx", "'mutate'")} AS u FROM {source}),
mutated{t} AS (
  SELECT * EXCLUDE (g, u, genome),
         CASE WHEN u < {pm} THEN substr(genome, 1, CAST(g AS INT))
                || translate(substr(genome, CAST(g + 1 AS INT), 1), '01', '10') || substr(genome, CAST(g + 2 AS INT))
              ELSE genome END AS genome
  FROM drawn{t})"""


def kept(parents: str, step: int = 0, tag: str = "", scored: str = "") -> str:
    """Best of parents and children, children first on equal scores.

    ``scored`` names children with a score; without it OneMax scores them.
    """
    t = f"{tag}_{step}"
    children = f"score, 0 AS source, n, pc, pm FROM {scored}" if scored else f"{ONES} AS score, 0 AS source, n, pc, pm FROM mutated{t}"
    return f"""
pool{t} AS (
  SELECT run_id, idx, genome, {children}
  UNION ALL SELECT run_id, idx, genome, score, 1, n, pc, pm FROM {parents}),
kept{t} AS MATERIALIZED (
  SELECT run_id, place AS idx, genome, score, n, pc, pm
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, source, idx) - 1 AS place FROM pool{t})
  WHERE place < n)"""


def steps(source: str, size: int, count: int, tag: str = "") -> tuple[list[str], str]:
    """Relations of ``count`` generations, and the name of the last population."""
    parts, parents = [ranked(source, tag)], f"ranked{tag}"
    for step in range(count):
        parts += [
            crossed(parents, size, step, tag),
            mutated(f"crossed{tag}_{step}", size, step, tag=tag),
            kept(parents, step, tag),
        ]
        parents = f"kept{tag}_{step}"
    return parts, parents


def generations(start: str, source: str, size: int, count: int, select: str) -> str:
    """``start`` defines ``source``; ``select`` reads from {last}."""
    parts, last = steps(source, size, count)
    return f"WITH {', '.join([start, *parts])} {select.format(last=last)}"


def settings_search(start: str, source: str, size: int, inner_size: int, inner: int, outer: int, settings: str, bits) -> str:
    """An outer search whose score of a genome is the inner search its settings describe.

    ``settings`` gives n, pc, pm of a settings genome; ``bits`` the first genes of (run, idx).
    """

    def swept(genomes: str, tag: str) -> list[str]:
        """(genome, score) of the distinct genomes of a relation."""
        parts, last = steps(f"inner{tag}", inner_size, inner, tag)
        return [
            f"""
inner{tag} AS (
  SELECT genome AS run_id, idx, {bits("genome", "idx")} AS genome, n, pc, pm
  FROM (SELECT *, {settings} FROM (SELECT DISTINCT genome FROM {genomes})), range(0, 32) t(idx) WHERE idx < n)""",
            *parts,
            f"""
swept{tag} AS MATERIALIZED (
  SELECT run_id AS genome, -({inner_size}::DOUBLE - max(score)) - 0.1::DOUBLE * {inner} AS score FROM {last} GROUP BY run_id)""",
        ]

    parts = [
        start,
        *swept(source, "_s"),
        f"""
outer_0 AS MATERIALIZED (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, idx) - 1 AS idx, genome, score, n, pc, pm
  FROM {source} JOIN swept_s USING (genome))""",
    ]
    parents = "outer_0"
    for step in range(outer):
        parts += [
            crossed(parents, size, step, "_o"),
            mutated(f"crossed_o_{step}", size, step, tag="_o"),
            *swept(f"mutated_o_{step}", f"_c{step}"),
            f"\nchildren_{step} AS (SELECT * FROM mutated_o_{step} JOIN swept_c{step} USING (genome))",
            kept(parents, step, "_o", scored=f"children_{step}"),
        ]
        parents = f"kept_o_{step}"
    return f"WITH {', '.join(parts)} SELECT run_id, idx, genome, score FROM {parents}"
