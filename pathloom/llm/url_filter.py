"""URL filtering by hashed host-suffix and path-prefix expressions.

Each URL is split into host and path. Its *expressions* are the strings
``suffix of the host`` + ``prefix of the path``; a rule ``host/path`` fits if it
equals one of them. Only shapes (labels of the host, characters of the path)
that some rule has are made, so a URL makes a bounded number of expressions,
however long it is. Expressions and rules meet in an equi-join on the first
32 bits of their SHA-256; the full digest confirms a hit, and the longest rule
decides. Everything is DataFrame expressions: no Python runs on executors.

URLs are judged once for each distinct (host, head of the path) and the verdict
is joined back, so the keys of a hot host are combined before the shuffle, and
the side with one row per key is the one that is joined on; adaptive execution
splits the other side.

Defined results: null URLs and URLs without ``://`` have empty host and path,
fit no rule and get the default verdict; repeated rows each get their verdict;
of two rules with the same string the blocking one counts; of two rules of the
same length the one with the longer host, then the blocking one. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathloom.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from pairs (verdict, ``host/path``); the host ends at the first slash."""
    parts = [(v, *r.partition("/")[::2]) for v, r in rules]
    return spark.createDataFrame([(h, "/" + p, v) for v, h, p in parts], "host string, path string, verdict string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has the columns host, path and verdict and may be of any size.
    """
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host is not null and r_verdict is not null")
    known = known.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # 'block' > 'allow'
    known = known.withColumn("r_digest", _digest(F.concat_ws("\n", "r_host", "r_path")))
    known = known.withColumn("r_short", F.substring("r_digest", 1, 8))

    # The shapes in use: at most (labels of a host) x (lengths of a path) many, whatever the number of rules.
    shape = F.struct(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars"))
    shapes = [(s["labels"], s["chars"]) for s in known.select(shape.alias("s")).distinct().select("s.*").collect()]
    head = max([c for _, c in shapes], default=0)

    # A column of the same name that isn't the URL gives way; the URL itself is read first.
    whole, first, of_host, of_head = (free_name(pages, n) for n in ("__url", "__head", "__h", "__p"))
    with_url = pages.withColumn(whole, F.col(url).cast("string"))
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    judged = with_url.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col(whole)).alias("host"), path_of(F.col(whole)).alias("path"))
    judged = judged.withColumn(first, F.substring("path", 1, head))

    keys = judged.where("host <> ''").select("host", F.col(first).alias("head")).distinct()
    labels = F.split("host", r"\.")
    pieces = [
        F.when(
            (F.size("__labels") >= n) & (F.length("head") >= c),
            F.concat_ws("\n", F.array_join(F.slice("__labels", -n, n), "."), F.substring("head", 1, c)),
        )
        for n, c in shapes
    ]
    expressions = F.filter(F.array(*pieces), lambda x: x.isNotNull()) if pieces else F.array().cast("array<string>")
    asked = keys.withColumn("__labels", labels).select("host", "head", F.explode(expressions).alias("expression"))
    asked = asked.withColumn("digest", _digest(F.col("expression"))).withColumn("short", F.substring("digest", 1, 8))
    hits = asked.join(known, asked["short"] == known["r_short"]).where("digest = r_digest")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_verdict")
    decided = hits.groupBy("host", "head").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best")
    )
    decided = decided.select(F.col("host").alias(of_host), F.col("head").alias(of_head), F.col("best").alias(free_name(pages, "__best")))
    out = judged.join(decided, (judged["host"] == decided[of_host]) & (judged[first] == decided[of_head]), "left")
    best = F.col(free_name(pages, "__best"))
    return out.select(*(F.col(f"`{c}`") for c in kept), "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
