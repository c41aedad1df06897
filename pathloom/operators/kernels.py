"""Kernel (similarity) matrices over sparse path features, and matrix functions.

A kernel is long-form (i, j, k) with ``j <= i``. Products of the feature matrix
with its transpose are equi-joins on the feature; a feature that all of n graphs
have makes n*n/2 rows, so the join is aggregated by pair and length only, lambda
comes in last, and counts stay integers until then. The settings (length cap,
indicator or count, all or core paths, direction, order) are columns derived from
that one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathloom.operators.paths import is_core, reverse_direction
from pathloom.scratch import materialise

# Fixed values of the 64 settings.
LAMBDA = 0.9
CAPS = (15, 50)
SEED = 0.001


def hashed(paths: DataFrame) -> DataFrame:
    """(g, len, freq, core, own_a, own_b, turned_a, turned_b): paths told by 128 bits of hash, of the path and of it backwards (cleaved and formed
    swapped), so that no later step moves their text."""
    told = lambda path, name: (F.xxhash64(path).alias(f"{name}_a"), F.xxhash64(F.lit("path"), path).alias(f"{name}_b"))
    paths = reverse_direction(paths.withColumn("kept", F.col("path"))).withColumnsRenamed({"path": "back", "kept": "path"})
    return paths.select("g", "len", "freq", is_core(F.col("path")).alias("core"), *told("path", "own"), *told("back", "turned"))


def products(facts: DataFrame, other: str) -> DataFrame:
    """(i, j, len, core, float, ind): dot products of path counts and indicators of all ordered pairs of graphs, by length and
    kind of path; the second graph's paths are its ``own`` or its ``turned`` ones."""
    a = facts.select(F.col("g").alias("i"), "own_a", "own_b", "len", "core", F.col("freq").alias("fa"))
    b = facts.select(F.col("g").alias("j"), F.col(f"{other}_a").alias("met_a"), F.col(f"{other}_b").alias("met_b"), F.col("freq").alias("fb"))
    grouped = a.join(b, (F.col("own_a") == F.col("met_a")) & (F.col("own_b") == F.col("met_b"))).groupBy("i", "j", "len", "core")
    return grouped.agg(F.sum(F.col("fa") * F.col("fb")).alias("float"), F.count("*").alias("ind"))


def path_products(facts: DataFrame) -> DataFrame:
    """Products of forward with forward, forward with backward and backward with backward ``hashed`` paths of all ordered pairs.

    Backward paths are the forward ones with cleaved and formed swapped, which leaves equality of two paths as it
    is: backward with backward equals forward with forward, and backward with forward is the transpose of the other.
    """
    forward = products(facts, "own").withColumn("dir", F.lit("ff"))
    cross = products(facts, "turned").withColumn("dir", F.lit("fb"))
    return forward.unionByName(cross)


def path_kernels(paths: DataFrame, lam: float = LAMBDA, caps: tuple[int, ...] = CAPS, seed: float = SEED) -> DataFrame:
    """The 64 kernels (l, dp, paths, type, power, i, j, k), lower triangle, normalised.

    types: f, forward; fb, forward against backward; tensor, ff*bb + fb*bf + bf*fb + bb*ff; max, the greatest of the
    three. Each cross kernel is scaled once by the diagonals. The seed keeps diagonals above zero.
    """
    paths = materialise(hashed(paths), "paths")  # read by each side of each product
    cells = []
    for cap in caps:
        for dp in ("ind", "float"):
            for kind in ("allpaths", "corepaths"):
                use = (F.col("len") <= cap) & (F.col("core") if kind == "corepaths" else F.lit(True))
                value = F.when(use, F.pow(F.lit(lam), F.col("len")) * F.col(dp)).otherwise(0.0)
                cells.append((cap, dp, kind, value))
    sums = [F.sum(F.when(F.col("dir") == d, v).otherwise(0.0)).alias(f"{d}{n}") for n, (*_, v) in enumerate(cells) for d in ("ff", "fb")]
    # Each ordered pair has a row, all zeros where no path is shared.
    graphs = paths.select("g").distinct()
    none = graphs.select(F.col("g").alias("i")).crossJoin(graphs.select(F.col("g").alias("j")))
    none = none.select("i", "j", F.lit(0).alias("len"), F.lit(False).alias("core"), F.lit(0).cast("long").alias("float"), F.lit(0).cast("long").alias("ind"), F.lit("").alias("dir"))
    wide = materialise(path_products(paths).unionByName(none).groupBy("i", "j").agg(*sums), "path-products")
    settings = F.array(*[F.struct(F.lit(c).alias("l"), F.lit(d).alias("dp"), F.lit(p).alias("paths"), (F.col(f"ff{n}") + seed).alias("ff"), (F.col(f"fb{n}") + seed).alias("fb")) for n, (c, d, p, _) in enumerate(cells)])
    long = wide.select("i", "j", F.explode(settings).alias("s")).select("i", "j", "s.*")
    keys = ["l", "dp", "paths"]
    diagonal = long.where("i = j").select(*keys, F.col("i").alias("d"), F.col("ff").alias("dff"))
    turned = long.select(*keys, F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("fb").alias("bf"))
    turned = turned.select(*keys, F.col("tj").alias("i"), F.col("ti").alias("j"), "bf")
    joined = long.where("j <= i").join(turned, [*keys, "i", "j"])
    for side in ("i", "j"):
        d = diagonal.select(*keys, F.col("d").alias(side), F.col("dff").alias(f"d{side}"))
        joined = joined.join(d, [*keys, side])
    scale = F.sqrt(F.col("di") * F.col("dj"))  # the backward diagonal equals the forward one
    joined = joined.withColumns({"cross": F.col("fb") / scale, "back": F.col("bf") / scale})
    tensor = 2 * F.col("ff") * F.col("ff") + 2 * F.col("cross") * F.col("back")
    raw = joined.select(*keys, "i", "j", "di", "dj", "ff", "cross", tensor.alias("tensor"), F.greatest("ff", "cross").alias("max"))
    # Diagonals of tensor and max, for their own normalisation.
    own_diagonal = raw.where("i = j").select(*keys, F.col("i").alias("d"), F.col("tensor").alias("dt"), F.col("max").alias("dm"))
    for side in ("i", "j"):
        raw = raw.join(own_diagonal.select(*keys, F.col("d").alias(side), F.col("dt").alias(f"dt{side}"), F.col("dm").alias(f"dm{side}")), [*keys, side])
    types = {"f": F.col("ff") / F.sqrt(F.col("di") * F.col("dj")), "fb": F.col("cross"), "tensor": F.col("tensor") / F.sqrt(F.col("dti") * F.col("dtj")), "max": F.col("max") / F.sqrt(F.col("dmi") * F.col("dmj"))}
    # A normalised kernel has a unit diagonal, so its square is normalised already.
    out = [F.struct(F.lit(t).alias("type"), F.lit(p).alias("power"), (v if p == 1 else v * v).alias("k")) for t, v in types.items() for p in (1, 2)]
    return raw.select(*keys, "i", "j", F.explode(F.array(*out)).alias("o")).select(*keys, "o.type", "o.power", "i", "j", "o.k")


def normalized(kernel: DataFrame) -> DataFrame:
    """K_ij / sqrt(K_ii K_jj); 0 where a diagonal is 0."""
    d = kernel.where("i = j").select(F.col("i").alias("d"), F.col("k").alias("dk"))
    joined = kernel.join(d.select(F.col("d").alias("i"), F.col("dk").alias("di")), "i", "left").join(d.select(F.col("d").alias("j"), F.col("dk").alias("dj")), "j", "left")
    scale = F.sqrt(F.coalesce("di", F.lit(0.0)) * F.coalesce("dj", F.lit(0.0)))
    return joined.select("i", "j", F.when(scale > 0, F.col("k") / scale).otherwise(0.0).alias("k"))


def squared(kernel: DataFrame) -> DataFrame:
    return kernel.withColumn("k", F.col("k") * F.col("k"))


def transposed(kernel: DataFrame) -> DataFrame:
    return kernel.select(F.col("j").alias("i"), F.col("i").alias("j"), "k")


def combined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Entry by entry: ``max``, ``product`` or ``sum``; a missing entry is 0."""
    joined = left.select("i", "j", F.col("k").alias("a")).join(right.select("i", "j", F.col("k").alias("b")), ["i", "j"], "full_outer").na.fill(0.0)
    value: Column = {"max": F.greatest("a", "b"), "product": F.col("a") * F.col("b"), "sum": F.col("a") + F.col("b")}[how]
    return joined.select("i", "j", value.alias("k"))


def feature_kernel(features: DataFrame, how: str = "dot") -> DataFrame:
    """Kernel of (g, feature, n): ``dot`` sum of products, ``ind`` common features, ``min`` sum of minima, ``minnorm``
    minima over the roots of both graphs' totals of the feature's size (``features`` then has ``size``)."""
    extra = ["size"] if how == "minnorm" else []
    a = features.select(F.col("g").alias("i"), "feature", *extra, F.col("n").alias("a"))
    b = features.select(F.col("g").alias("j"), F.col("feature").alias("fb"), F.col("n").alias("b"))
    joined = a.join(b, F.col("feature") == F.col("fb")).where("j <= i")
    if how == "minnorm":
        totals = features.groupBy("g", "size").agg(F.sum("n").alias("t"))
        joined = joined.join(totals.select(F.col("g").alias("i"), "size", F.col("t").alias("ti")), ["i", "size"]).join(totals.select(F.col("g").alias("j"), "size", F.col("t").alias("tj")), ["j", "size"])
    value = {"dot": F.col("a") * F.col("b"), "ind": F.lit(1), "min": F.least("a", "b"), "minnorm": F.least("a", "b") / (F.sqrt(F.col("ti").cast("double")) * F.sqrt(F.col("tj").cast("double"))) if how == "minnorm" else F.lit(0)}[how]
    return joined.groupBy("i", "j").agg(F.sum(value.cast("double")).alias("k"))
