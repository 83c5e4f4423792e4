"""URL filter: allow and block rules by host and path; URLs without a rule go to a logistic regression on hashed n-grams.

Everything is DataFrame functions. The model is trained on a small labelled URL table in its dual form:
gradient steps from zero keep the weights a sum of the examples' n-gram counts, so each step updates one
number for each example, and the whole training is one expression over one row of arrays. The weights go
into the scoring plan as a scalar subquery, so nothing passes through Python. Pages are not shuffled.

Defined cases: a URL that is null or has no `://` has an empty host and path, no rule, and the verdict of
the model's bias. Repeated rows are judged one by one. An empty labelled table gives weights 0, and a margin
of 0 allows. Of rules of equal length the one with the longer host wins, then block before allow. Other
columns of the pages don't matter, whatever their names; only the id and the URL are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of hashed n-grams; a power of two.
BUCKETS = 1 << 14
#: Lengths of n-grams in characters.
SIZES = (3, 4, 5)
#: Labelled rows used at most, those with the smallest hash of the URL; training needs their square in numbers.
MOST_LABELLED = 300
STEPS = 100
#: Shrinks the examples' shares a little at each step.
DECAY = 0.001
#: Rule lists up to this length are tried one by one in each row; longer ones are joined by host.
INLINE_RULES = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query, (action, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# The small labelled URL table of the registered query, (url, 1 to block).
LABELLED = (
    ("https://www.casino-royal.example.com/en/17", 1), ("http://casino-win.example.org/de/3021.html", 1), ("https://m.grand-casino.example.net/fr/11?page=2&ref=x", 1), ("http://online-casino.example.net/es/2250/", 1),
    ("https://free-bets.example.org/en/81", 1), ("http://www.best-bets.example.com/fr/905#top", 1), ("https://blog.sports-bets.example.net/de/77/", 1), ("http://m.bets-now.example.com/es/5120", 1),
    ("http://cheap-pills.example.net/en/640.html", 1), ("https://www.diet-pills.example.org/es/9", 1), ("https://m.pills-shop.example.com/de/4108?utm_source=feed", 1), ("http://blog.pills-now.example.org/fr/31/", 1),
    ("http://blog.adult-x.example.com/en/5021", 1), ("https://adult-chat.example.org/de/18/", 1), ("http://www.adult-video.example.net/fr/790.html", 1), ("https://m.adult-x.example.org/es/6", 1),
    ("https://spam-farm.example.net/en/3/", 1), ("http://m.spam-links.example.org/fr/870", 1), ("http://www.link-spam.example.com/de/4410#top", 1), ("https://blog.spam-farm.example.org/es/52.html", 1),
    ("https://ads-track.example.org/en/12?utm_source=feed", 1), ("http://www.ads-click.example.net/de/9902", 1), ("https://m.track-ads.example.com/fr/61/", 1), ("http://blog.ads-serve.example.org/es/743.html", 1),
    ("https://www.library.example.org/en/17", 0), ("http://museum.example.net/de/3021.html", 0), ("https://m.weather.example.com/fr/11?page=2&ref=x", 0), ("http://garden.example.net/es/2250/", 0),
    ("https://history.example.org/en/81", 0), ("http://www.kitchen.example.com/fr/905#top", 0), ("https://blog.mountain.example.net/de/77/", 0), ("http://m.science.example.com/es/5120", 0),
    ("http://school.example.net/en/640.html", 0), ("https://www.theatre.example.org/es/9", 0), ("https://m.railway.example.com/de/4108?utm_source=feed", 0), ("http://blog.painting.example.org/fr/31/", 0),
    ("http://blog.thorand.example.com/en/5021", 0), ("https://reading.example.org/de/18/", 0), ("http://www.station.example.net/fr/790.html", 0), ("https://m.therein.example.org/es/6", 0),
    ("https://nation.example.net/en/3/", 0), ("http://m.thousand.example.org/fr/870", 0), ("http://www.stone.example.com/de/4410#top", 0), ("https://blog.ration.example.org/es/52.html", 0),
    ("https://thestable.example.org/en/12?utm_source=feed", 0), ("http://www.handed.example.net/de/9902", 0), ("https://m.another.example.com/fr/61/", 0), ("http://blog.those.example.org/es/743.html", 0),
    ("https://www.river.example.net/en/2291/", 0), ("http://harbour.example.org/fr/18#top", 0), ("https://m.thinker.example.net/de/600", 0), ("http://blog.orchard.example.com/es/7441.html", 0),
    ("https://ththat.example.org/en/5104", 0), ("http://m.tionly.example.net/fr/38?page=2&ref=x", 0), ("https://www.hearing.example.org/de/1290/", 0), ("http://sheand.example.net/es/77.html", 0),
)


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def labelled_table(spark: SparkSession) -> DataFrame:
    """(url, label) of the small table above."""
    return spark.sql(f"SELECT * FROM (VALUES {_values(LABELLED)}) AS t(url, label)")


def rule_table(spark: SparkSession) -> DataFrame:
    """(action, rule) of the rules above."""
    return spark.sql(f"SELECT * FROM (VALUES {_values(RULES)}) AS t(action, rule)")


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL: what stands behind the first `://` up to / ? # and from there up to ? #."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lowered(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def _grams(text: Column, seed: int, buckets: int) -> Column:
    """Buckets of the character n-grams of ^text$, repeats included; the hash is plain integer arithmetic on code points."""
    shift = (1 << 32) // buckets

    def of_size(codes: Column, n: int) -> Column:
        def bucket(i: Column) -> Column:
            key = reduce(lambda h, k: (h * 131 + F.get(codes, i + k)) % (1 << 31), range(n), F.lit(seed + n).cast("long"))
            return F.floor((key * 2654435761) % (1 << 32) / shift).cast("int")

        return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), bucket)).otherwise(F.array().cast("array<int>"))

    codes = F.transform(F.regexp_extract_all(F.concat(F.lit("^"), _lowered(text), F.lit("$")), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    # an array of one element, so that the codes are a variable of the lambda and are made once
    return F.flatten(F.transform(F.array(codes), lambda c: F.concat(*(of_size(c, n) for n in SIZES))))


def url_grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the n-grams of host and path; those of the two parts are hashed apart."""
    return F.concat(_grams(host, 1, buckets), _grams(path, 101, buckets))


def train(labelled: DataFrame, buckets: int = BUCKETS, most: int = MOST_LABELLED, steps: int = STEPS, decay: float = DECAY) -> DataFrame:
    """One row (weights): an array of buckets + 1 doubles, the last of them the bias, fitted on at most `most` rows of (url, label).

    A URL with both labels counts as 1; rows without URL or with another label are left out.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64("url"), "url").limit(most)
    host, path = host_and_path(F.col("url"))
    counts = picked.select("url", "y", F.explode(F.concat(url_grams(host, path, buckets), F.array(F.lit(buckets)))).alias("k")).groupBy("url", "y", "k").agg(F.count("*").cast("double").alias("n"))
    other = counts.select(F.col("url").alias("other"), "k", F.col("n").alias("m"))
    likeness = counts.join(other, "k").groupBy("url", "y", "other").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    rows = likeness.groupBy("url", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "s"))), lambda x: x["s"]).alias("row"), F.sum("s").alias("total"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "row"))).alias("x"), (4.0 / F.max("total")).alias("rate"))

    def step(shares: Column) -> Column:
        def moved(r: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(r["row"], shares, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return F.get(shares, i) * (1 - decay) + F.col("rate") * (r["y"] - 1 / (1 + F.exp(-margin)))

        return F.transform("x", moved)

    fitted = one.select("x", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("x", lambda r: F.lit(0.0)), lambda a, _: step(a)).alias("a"))
    shares = fitted.select(F.explode(F.arrays_zip(F.transform("x", lambda r: r["url"]).alias("url"), F.col("a").alias("a"))).alias("e")).select("e.url", "e.a")
    sums = counts.join(shares, "url").groupBy("k").agg(F.sum(F.col("n") * F.col("a")).alias("w"))
    every = labelled.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("k")).join(sums, "k", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda e: e["w"]).alias("weights"))


def _rules(rules: DataFrame) -> DataFrame:
    at = F.instr("rule", "/")
    return rules.where(F.col("rule").isNotNull() & F.col("action").isin("allow", "block")).select(
        "action", "rule", F.when(at > 0, _lowered(F.substring(F.col("rule"), F.lit(1), at - 1))).otherwise(_lowered(F.col("rule"))).alias("_h"), F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise("").alias("_p")
    )


def with_rule(urls: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """urls (with host and path) and columns rule and action of the longest rule that fits, null where none does.

    A rule (action, rule), the rule written as host and path, fits its host and all hosts below it if the path
    starts with the rule's. Up to `inline` rules are a literal in the plan. Longer lists are joined: the distinct
    pairs of host and path are spread over their host suffixes, no longer than the longest rule's.
    """
    known = _rules(rules)
    few = known.limit(inline + 1).collect()
    if not few:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    if len(few) <= inline:
        few = sorted(few, key=lambda r: (len(r["rule"]), len(r["_h"]), r["action"], r["rule"]), reverse=True)
        fits = [((F.col("host") == r["_h"]) | F.endswith("host", F.lit("." + r["_h"]))) & F.startswith("path", F.lit(r["_p"])) for r in few]
        pick = lambda name: F.coalesce(*(F.when(f, F.lit(r[name])) for f, r in zip(fits, few)))
        return urls.withColumns({"rule": pick("rule"), "action": pick("action")})
    deepest = known.agg(F.max(F.size(F.split("_h", r"\.")))).first()[0]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    pairs = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_h"))
    found = pairs.join(known, "_h").where(F.startswith("path", F.col("_p"))).groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length("_h"), "action", "rule")).alias("_r"))
    return urls.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_r.rule"), "action": F.col("_r.action")}).drop("_r")


def filter_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame, id: str = "page_id", url: str = "url", buckets: int = BUCKETS, inline: int = INLINE_RULES) -> DataFrame:
    """(id, host, path, rule, verdict): allow or block by the longest rule that fits, else by the model trained on labelled."""
    host, path = host_and_path(F.col(url))
    judged = with_rule(pages.select(F.col(id), host.alias("host"), path.alias("path")), rules, inline)
    judged = judged.select("*", train(labelled, buckets).scalar().alias("_weights"))
    margin = F.aggregate(url_grams(F.col("host"), F.col("path"), buckets), F.get("_weights", F.lit(buckets)), lambda s, k: s + F.get("_weights", k))
    return judged.select(id, "host", "path", "rule", F.coalesce("action", F.when(margin > 0, "block").otherwise("allow")).alias("verdict"))


def filter_sql() -> str:
    """The registered query in DuckDB: the same regression as a recursive table of the examples' shares."""
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"

    def grams(source: str) -> str:
        parts = []
        for column, seed in (("host", 1), ("path", 101)):
            for n in SIZES:
                key = reduce(lambda h, k: f"(({h} * 131 + unicode(c[i + {k}])) % 2147483648)", range(n), f"{seed + n}::BIGINT")
                parts.append(f"SELECT url, ({key} * 2654435761 % 4294967296) // {(1 << 32) // BUCKETS} AS k FROM (SELECT url, c, unnest(range(1, len(c) - {n} + 2)) AS i FROM (SELECT url, regexp_extract_all('^' || {lower(column)} || '$', '(?s).') AS c FROM {source}))")
        return " UNION ALL ".join([*parts, f"SELECT url, {BUCKETS} FROM {source}"])

    split = f"""SELECT *, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM """
    return f"""WITH RECURSIVE t AS ({split} (VALUES {_values(LABELLED)}) v(url, y))), f AS (SELECT url, k, count(*)::DOUBLE AS n FROM ({grams("t")}) GROUP BY ALL),
        s AS (SELECT a.url AS u, b.url AS v, sum(a.n * b.n) AS s FROM f a JOIN f b USING (k) GROUP BY ALL),
        z AS (SELECT 4 / max(q) AS rate FROM (SELECT sum(s) AS q FROM s GROUP BY u)),
        r AS (SELECT 0 AS step, url, 0::DOUBLE AS a FROM t UNION ALL
            SELECT max(r.step) + 1, s.u, sum(CASE WHEN s.u = s.v THEN r.a ELSE 0 END) * {1 - DECAY} + max(z.rate) * (max(t.y) - 1 / (1 + exp(-sum(s.s * r.a))))
            FROM r JOIN s ON s.v = r.url JOIN t ON t.url = s.u CROSS JOIN z WHERE r.step < {STEPS} GROUP BY s.u),
        w AS (SELECT k, sum(n * a) AS w FROM f JOIN r USING (url) WHERE step = {STEPS} GROUP BY k),
        p AS ({split} (SELECT page_id, coalesce(url, '') AS url FROM pages))), u AS (SELECT DISTINCT url, host, path FROM p),
        m AS (SELECT url, sum(w) AS margin FROM ({grams("u")}) LEFT JOIN w USING (k) GROUP BY url),
        g AS (SELECT action, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_values(RULES)}) v(action, rule)),
        b AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM u JOIN g ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY url)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b USING (url) LEFT JOIN m USING (url)"""
