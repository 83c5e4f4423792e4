"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.scratch import written

#: The category of everything that a target does not name, null included.
REST = "*"


@dataclass(frozen=True)
class Mix:
    """Wanted shares of tokens by source, language and topic, and the tokens to take as a share of all.

    A category that no document has is left out and the rest scaled to 1. What a target does not name
    counts as "*"; without a share of its own, "*" gets none and such documents are not taken.
    topics: the topic of a text is the one whose stems occur most often in it, the first of equals,
    and "*" where none occurs.
    """

    sources: Mapping[str, float] = field(default_factory=lambda: {f"src{k}": 1.0 for k in range(20)} | {REST: 1.0})
    languages: Mapping[str, float] = field(default_factory=lambda: {"en": 50.0, "de": 15.0, "fr": 15.0, "es": 15.0, REST: 5.0})
    topics: Mapping[str, float] = field(default_factory=lambda: {"process": 30.0, "action": 30.0, "manner": 20.0, "state": 15.0, REST: 5.0})
    stems: Mapping[str, str] = field(default_factory=lambda: {"process": "tion", "action": "ing", "manner": "ment", "state": "ver"})
    take: float = 0.5
    rounds: int = 20
    seed: str = "mix"


def _category(column: Column, named: Mapping[str, float]) -> Column:
    names = [k for k in named if k != REST]
    return F.when(column.isin(names), column).otherwise(F.lit(REST)) if names else F.lit(REST)


def topic_of(text: Column, stems: Mapping[str, str]) -> Column:
    """The topic whose stem occurs most often in the text (without overlaps), the first of equals."""
    counts = [((F.length(text) - F.length(F.replace(text, F.lit(stem)))) / len(stem)).cast("long") for stem in stems.values()]
    if not counts:
        return F.lit(REST)
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.when(F.coalesce(most, F.lit(0)) == 0, F.lit(REST))
    for name, n in zip(stems, counts, strict=True):
        out = out.when(n == most, F.lit(name))
    return out


def features(df: DataFrame, mix: Mix) -> list[Column]:
    """_mix_source, _mix_lang, _mix_topic, _mix_tokens (words) and _mix_draw in [0, 1), from the id alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return [
        _category(F.col("source"), mix.sources).alias("_mix_source"),
        _category(F.col("lang"), mix.languages).alias("_mix_lang"),
        topic_of(text, mix.stems).alias("_mix_topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_mix_tokens"),
        draw.alias("_mix_draw"),
    ]


Cell = tuple[str, str, str]


def raked(tokens: Mapping[Cell, float], targets: list[Mapping[str, float]], rounds: int, most: float = float("inf")) -> dict[Cell, float]:
    """Shares of the cells, scaled to one target after the other, so many rounds; no cell gets over `most` times its share of tokens.

    A cell at its bound stays there, and the next rounds give what it lacks to the other cells of
    its categories, so that the targets are met wherever the bounds allow it. Sums to 1 where anything is wanted.
    """
    total = sum(tokens.values())
    share = {cell: n / total for cell, n in sorted(tokens.items()) if n > 0}
    bounds = {cell: most * x for cell, x in share.items()}
    goals = []
    for k, target in enumerate(targets):
        present = {c[k] for c in share}
        wanted = {name: w for name, w in target.items() if name in present and w > 0}
        goals.append({name: w / sum(wanted.values()) for name, w in wanted.items()})
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            sums: dict[str, float] = {}
            for cell, x in share.items():
                sums[cell[k]] = sums.get(cell[k], 0.0) + x
            share = {cell: min(bounds[cell], x * goal.get(cell[k], 0.0) / sums[cell[k]]) if sums[cell[k]] > 0 else 0.0 for cell, x in share.items()}
    whole = sum(share.values())
    return {cell: x / whole for cell, x in share.items()} if whole > 0 else share


def calibrated(tokens: Mapping[Cell, float], share: Mapping[Cell, float], take: float) -> dict[Cell, float]:
    """Inclusion probabilities min(1, c * share / tokens), with c such that the expected tokens are `take` of all, or all wanted ones."""
    budget = take * sum(tokens.values())
    cells = sorted((c for c in share if share[c] > 0), key=lambda c: (-share[c] / tokens[c], c))
    left = [0.0]  # shares from each cell on
    for cell in reversed(cells):
        left.append(left[-1] + share[cell])
    full, factor = 0.0, float("inf")
    for cell, rest in zip(cells, reversed(left)):
        if (budget - full) / rest * share[cell] / tokens[cell] <= 1 + 1e-9:
            factor = max(0.0, (budget - full) / rest)
            break
        full += tokens[cell]
    return {c: min(1.0, factor * share[c] / tokens[c]) for c in cells}


def _tokens_by_cell(cells: DataFrame) -> dict[Cell, float]:
    """From rows with _mix_ columns. The cells are at most one for each combination of named categories and "*", so their number does not grow with the data."""
    rows = cells.groupBy("_mix_source", "_mix_lang", "_mix_topic").agg(F.sum("_mix_tokens")).collect()
    return {(r[0], r[1], r[2]): float(r[3]) for r in rows if r[3]}


def _fitted(tokens: Mapping[Cell, float], mix: Mix) -> dict[Cell, float]:
    most = 1 / mix.take if mix.take > 0 else float("inf")
    return calibrated(tokens, raked(tokens, [mix.sources, mix.languages, mix.topics], mix.rounds, most), mix.take) if tokens else {}


def mix_report(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(dimension, category, target, available, expected): shares of tokens wanted, there, and expected in the sample.

    A category that no document has, or that is not wanted, has target 0; where expected stays off the
    target, the texts do not suffice for it at this `take`. No words at all: no rows.
    """
    tokens = _tokens_by_cell(documents.select(*features(documents, mix)))
    found = _fitted(tokens, mix)
    whole, drawn = sum(tokens.values()), sum(p * tokens[c] for c, p in found.items())
    rows = []
    for k, (dimension, target) in enumerate((("source", mix.sources), ("lang", mix.languages), ("topic", mix.topics))):
        present = {c[k] for c in tokens}
        wanted = sum(w for name, w in target.items() if name in present)
        for name in sorted(present | set(target)) if tokens else []:
            there = sum(n for c, n in tokens.items() if c[k] == name)
            taken = sum(p * tokens[c] for c, p in found.items() if c[k] == name)
            rows.append((dimension, name, target.get(name, 0.0) / wanted if name in present and wanted else 0.0, there / whole, taken / drawn if drawn else 0.0))
    return documents.sparkSession.createDataFrame(rows, "dimension string, category string, target double, available double, expected double")


def probabilities(cells: DataFrame, mix: Mix) -> dict[Cell, float]:
    """Inclusion probabilities by cell, from rows with _mix_ columns."""
    return _fitted(_tokens_by_cell(cells), mix)


def _chosen(df: DataFrame, found: Mapping[Cell, float]) -> DataFrame:
    """Joins the cells' probabilities, whose number is bounded by the targets, and keeps the rows drawn."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(*cell, p) for cell, p in sorted(found.items())], "_mix_source string, _mix_lang string, _mix_topic string, _mix_probability double")
    return df.join(F.broadcast(cells), ["_mix_source", "_mix_lang", "_mix_topic"]).where("_mix_draw < _mix_probability")


def sample_mix(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability) of the documents drawn, by their own categories ("*" for others).

    A document's draw depends on its id and the seed alone; rows of one id and one cell share a fate,
    and null ids draw alike. Documents without words count no tokens; they are drawn with their cell's
    probability, and not where the cell has no words at all. An empty table gives an empty result.
    """
    slim = written(documents.select("doc_id", *features(documents, mix)), "mix")
    out = _chosen(slim, probabilities(slim, mix))
    return out.select("doc_id", F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"), F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"), F.round("_mix_probability", 9).alias("probability"))


def keep_mix(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of documents that are drawn, with all their columns; rules as in sample_mix."""
    marked = documents.select("*", *features(documents, mix))
    return _chosen(marked, probabilities(documents.select(*features(documents, mix)), mix)).select(*documents.columns)


def sample_sql(mix: Mix = Mix(), documents: str = "documents") -> str:
    """sample_mix in DuckDB SQL: one common table expression for each scaling step."""

    def case(column: str, named: Mapping[str, float]) -> str:
        return f"CASE WHEN {column} IN ({', '.join(f"'{k}'" for k in named if k != REST)}) THEN {column} ELSE '{REST}' END"

    counts = {name: f"((length(t) - length(replace(t, '{stem}', ''))) // {len(stem)})" for name, stem in mix.stems.items()}
    most = f"greatest({', '.join(counts.values())})"
    topic = f"CASE WHEN {most} = 0 THEN '{REST}' " + " ".join(f"WHEN {n} = {most} THEN '{name}'" for name, n in counts.items()) + " END"
    parts = [
        f"""d AS (SELECT doc_id, {case('source', mix.sources)} AS source, {case('lang', mix.languages)} AS lang, {topic} AS topic,
            CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
            CAST(CAST('0x' || substr(md5('{mix.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS draw
            FROM (SELECT *, coalesce(text, '') AS t FROM {documents}))""",
        "n AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        f"s0 AS (SELECT *, n / sum(n) OVER () AS x, n / sum(n) OVER () / {mix.take!r} AS most FROM n)",
    ]
    for key, target in (("source", mix.sources), ("lang", mix.languages), ("topic", mix.topics)):
        values = ", ".join(f"('{k}', {float(w)!r})" for k, w in target.items())
        parts.append(f"g_{key} AS (SELECT k, w / sum(w) OVER () AS goal FROM (VALUES {values}) v(k, w) WHERE w > 0 AND k IN (SELECT {key} FROM n))")
    step = 0
    for _ in range(mix.rounds):
        for key in ("source", "lang", "topic"):
            parts.append(f"s{step + 1} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, s.n, s.most, CASE WHEN sum(s.x) OVER (PARTITION BY s.{key}) > 0 THEN least(s.most, s.x * coalesce(g.goal, 0) / sum(s.x) OVER (PARTITION BY s.{key})) ELSE 0 END AS x FROM s{step} s LEFT JOIN g_{key} g ON g.k = s.{key})")
            step += 1
    parts += [
        f"f AS (SELECT source, lang, topic, n, x / sum(x) OVER () AS x, {mix.take!r} * sum(n) OVER () AS budget FROM s{step})",
        "o AS (SELECT *, row_number() OVER w AS k, (budget - (sum(n) OVER w - n)) / sum(x) OVER (ORDER BY x / n DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM f WHERE x > 0 WINDOW w AS (ORDER BY x / n DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))",
        "c AS (SELECT coalesce((SELECT greatest(c, 0) FROM o WHERE c * x / n <= 1 + 1e-9 ORDER BY k LIMIT 1), 'inf'::DOUBLE) AS c)",
        "p AS (SELECT source, lang, topic, least(1.0, c.c * x / n) AS probability FROM o, c)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.probability, 9) AS probability FROM d JOIN p USING (source, lang, topic) WHERE d.draw < p.probability"
