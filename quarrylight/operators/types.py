"""Types as joins: names by precedence, ancestors with bound type variables, inherited members, overrides.

A type expression is the array of its tokens (``List``, ``<``, ``T``, ``>``), so that binding type variables
replaces tokens.  The ancestors of all types come from rounds that double their reach: the stretches as long as the
reach are joined with those above them, and the arguments of the upper one are rewritten by those of the lower one.
Every round writes what it adds; a hierarchy of depth d takes about log2(d) of them, and every pair arises once for
each of its ways over a type at that distance.  Pairs are written in buckets by their lower type, each moved once:
rounds, overrides and inherited members bring what they look for to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.sources.tables import InBuckets, written

TOKENS = r"[\p{L}\p{N}_$.]+|[<>,?&\[\]]"
PRIMITIVES = ("void", "boolean", "byte", "char", "short", "int", "long", "float", "double")


def tokens(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(f"({TOKENS})"))


def bound(expression: Column, parameters: Column, arguments: Column) -> Column:
    """The tokens of a type with each of ``parameters`` replaced by its argument; a raw type's are of the root of all types."""

    def one(token: Column) -> Column:
        at = F.array_position(parameters, token).cast("int")
        return F.when(at > 0, F.coalesce(F.get(arguments, at - 1), F.array(F.lit("Object")))).otherwise(F.array(token))

    return F.flatten(F.transform(expression, one))


# lists of tokens as text, in the order of the lists: every token ends with the one, every expression with the other
_TOKEN_END, _END = "\x01", "\x00"
TYPES_PER_BUCKET = 20_000


def _split(text: Column, end: str) -> Column:
    parts = F.split(text, end)
    return F.slice(parts, 1, F.size(parts) - 1)


def _packed(expressions: Column) -> Column:
    one = lambda e: F.concat(F.array_join(F.transform(e, lambda t: F.concat(t, F.lit(_TOKEN_END))), ""), F.lit(_END))
    return F.array_join(F.transform(expressions, one), "")


def _unpacked(text: Column) -> Column:
    return F.transform(_split(text, _END), lambda e: _split(e, _TOKEN_END))


def _bound(text: Column, parameters: Column, arguments: Column) -> Column:
    """``bound`` for packed expressions, parameters and arguments."""
    # the lists are taken apart once, not for each token
    lists = F.array(F.struct(_split(parameters, _TOKEN_END).alias("p"), _split(arguments, _END).alias("a")))

    def one(token: Column, by: Column) -> Column:
        at = F.array_position(by.p, token).cast("int")
        return F.when(at > 0, F.coalesce(F.get(by.a, at - 1), F.lit("Object" + _TOKEN_END))).otherwise(F.concat(token, F.lit(_TOKEN_END)))

    whole = lambda by: F.transform(_split(text, _END), lambda e: F.concat(F.array_join(F.transform(_split(e, _TOKEN_END), lambda t: one(t, by)), ""), F.lit(_END)))
    return F.array_join(F.transform(lists, whole)[0], "")


def ancestors(types: DataFrame, supertypes: DataFrame, bind: bool = True) -> DataFrame:
    """(type, above, distance, parameters, arguments): every ancestor of a type once, with its type variables and what they are bound to.

    types: (type, parameters array<string>); supertypes: (type, above, arguments array<array<string>>).  Of several ways to
    an ancestor the shortest counts, of equal ones that with the least arguments (of what the stretches that meet there are
    bound to); a type on a cycle is no ancestor of itself.  Without ``bind`` the pairs and distances alone, which take fewer bytes.
    """
    carried = ["parameters", "arguments"] if bind else []
    first = Window.partitionBy("low", "above").orderBy("distance", *reversed(carried))

    def shortest(rows: DataFrame) -> DataFrame:
        # one sort behind one exchange; a minimum of structs would sort in front of the exchange as well
        return rows.withColumn("better", F.lag("distance").over(first)).where(F.col("better").isNull()).drop("better").withColumnRenamed("low", "type")

    other = F.col("type") != F.col("above")
    own = types.select(F.col("type").alias("above"), *([F.array_join(F.transform("parameters", lambda t: F.concat(t, F.lit(_TOKEN_END))), "").alias("parameters")] if bind else []))
    edges = supertypes.where(other).select("type", "above", *([_packed(F.col("arguments")).alias("arguments")] if bind else []))
    start = edges.join(own, "above").select(F.col("type").alias("low"), "above", F.lit(1).alias("distance"), *carried)
    n = types.count()
    # small hierarchies take few tasks, large ones as many as keep a bucket small
    buckets = max(2, min(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n // 5_000), min(n // TYPES_PER_BUCKET, 4_000))
    dealt = lambda rows: written(InBuckets(rows, "type", buckets), "ancestors")
    known = outer = dealt(shortest(start.repartition(buckets, "low")))
    reach = 1
    while True:
        # what lies beyond the reach is met by the stretches of just that length and those above them: each distance arises once
        lower = outer.where(F.col("distance") == reach)
        if lower.isEmpty():
            break
        upper = known.select(F.col("type").alias("middle"), F.col("above").alias("top"), F.col("distance").alias("more"), *(F.col(c).alias(f"top_{c}") for c in carried))
        lower = lower.select(F.col("type").alias("low"), "above", "distance", *carried)
        further = lower.repartition(buckets, "above").join(upper, (F.col("above") == F.col("middle")) & (F.col("low") != F.col("top")))
        values = [F.col("top_parameters").alias("parameters"), _bound(F.col("top_arguments"), F.col("parameters"), F.col("arguments")).alias("arguments")] if bind else []
        further = further.select("low", F.col("top").alias("above"), (F.col("distance") + F.col("more")).alias("distance"), *values).repartition(buckets, "low")
        # a pair that is known lies nearer and comes first
        nothing = known.select(F.col("type").alias("low"), "above", "distance", *(F.lit(None).cast("string").alias(c) for c in carried))
        outer = dealt(shortest(nothing.unionByName(further)).where(F.col("distance") > reach))
        known = known.unionByName(outer)
        reach *= 2
    return known.withColumns({"parameters": _split(F.col("parameters"), _TOKEN_END), "arguments": _unpacked(F.col("arguments"))}) if bind else known


def _same(a: Column | str, b: Column | str) -> Column:
    """Whether both are equal, for joins: no key, so that rows stay where the keys have put them."""
    return F.array_contains(F.array(a), F.col(b))


def overriding(methods: DataFrame, above: DataFrame, lower: DataFrame | None = None) -> DataFrame:
    """(method, overridden, distance) of methods that override one of an ancestor.

    methods: (method, type, package, name, modifiers array<string>, parameters array<array<string>>, returns array<string>),
    types by the names that expressions use.  An overridden method is neither static nor private, and visible: of the same
    package where nothing is said.  With the ancestor's variables bound, parameters are equal and the result is the same, or a
    type below the other one.  lower: (head, result_head) of such types, if expressions do not name types as ``above`` does.
    """
    m = methods.where(~F.array_contains("modifiers", "static") & ~F.array_contains("modifiers", "private"))
    own = m.select("method", F.col("type").alias("own_type"), F.col("name").alias("own_name"), "package", F.size("parameters").alias("own_n"), F.col("parameters").alias("own_parameters"), F.col("returns").alias("own_returns"))
    other = m.select(F.col("method").alias("overridden"), F.col("type").alias("top"), "name", F.col("package").alias("home"), F.size("parameters").alias("n"), "modifiers", F.col("parameters").alias("takes"), "returns")
    # names alone go along all pairs to the ancestors; what meets there comes back to its type, and takes arguments and methods there
    named = m.select(F.col("type").alias("low"), "name", F.size("parameters").alias("n")).distinct()
    pairs = above.select(F.col("type").alias("below"), F.col("above").alias("top"))
    hits = named.join(pairs, F.col("low") == F.col("below")).select("low", "top", "name", "n").join(other, ["top", "name", "n"])
    met = hits.join(above.withColumnRenamed("type", "below"), (F.col("low") == F.col("below")) & _same("top", "above"))
    met = met.join(own, (F.col("low") == F.col("own_type")) & _same("name", "own_name") & _same("n", "own_n"))
    bind = lambda e: bound(e, F.col("parameters"), F.col("arguments"))
    visible = F.arrays_overlap("modifiers", F.array(F.lit("public"), F.lit("protected"))) | (F.col("home") == F.col("package"))
    met = met.where(visible & _same(F.transform("takes", bind), "own_parameters")).select("method", "overridden", "distance", "own_returns", bind(F.col("returns")).alias("returns"))
    met = met.withColumns({"head": F.col("own_returns")[0], "result_head": F.col("returns")[0]})
    if lower is None:
        # of all pairs, those that are asked for
        met = written(met, "met")
        asked = met.select(F.col("head").alias("low"), "result_head").distinct()
        lower = asked.join(above.select(F.col("type").alias("head"), F.col("above").alias("top")), (F.col("low") == F.col("head")) & _same("result_head", "top"))
    lower = lower.select("head", "result_head", F.lit(True).alias("below"))
    met = met.join(lower, ["head", "result_head"], "left")
    reference = ~F.col("head").isin(*PRIMITIVES) & ~F.col("result_head").isin(*PRIMITIVES)
    fits = (F.col("own_returns") == F.col("returns")) | (reference & ((F.col("result_head") == "Object") | F.col("below").isNotNull()))
    return met.where(fits).select("method", "overridden", "distance")


def members(calls: DataFrame, methods: DataFrame, above: DataFrame) -> DataFrame:
    """(call, target, state, reason) of calls (call, type, name, n): the method of the type itself or of its nearest ancestor.

    methods: (method, type, name, n).  Several methods at the least distance are ambiguous.  The ancestors are joined
    as they are: a type's own methods come as distance 0 beside them.  Where methods have (modifiers, package) and calls a package,
    private methods are not inherited, and those without a word for it only within their package.
    """
    seen = "modifiers" in methods.columns
    reach = F.when(F.array_contains("modifiers", "private"), "OWN").when(F.arrays_overlap("modifiers", F.array(F.lit("public"), F.lit("protected"))), "ALL").otherwise("PACKAGE") if seen else F.lit("ALL")
    have = methods.groupBy(F.col("type").alias("above"), "name", "n", reach.alias("reach"), (F.col("package") if seen else F.lit(None).cast("string")).alias("home")).agg(F.min("method").alias("target"), F.count(F.lit(1)).alias("copies"))
    own = calls.select("call", "type", "name", "n", (F.col("package") if seen else F.lit(None).cast("string")).alias("package"))
    itself = own.select("call", "name", "n", "package", F.col("type").alias("above"), F.lit(0).alias("distance"))
    inherited = own.join(above.select(F.col("type").alias("below"), "above", "distance"), F.col("type") == F.col("below")).select("call", "name", "n", "package", "above", "distance")
    found = itself.unionByName(inherited).join(have, ["above", "name", "n"])
    found = found.where((F.col("distance") == 0) | (F.col("reach") == "ALL") | ((F.col("reach") == "PACKAGE") & F.col("home").eqNullSafe(F.col("package"))))
    # how many methods lie at each distance, then the least distance: sums with partial steps, no list of candidates
    each = found.groupBy("call", "distance").agg(F.sum("copies").alias("copies"), F.min("target").alias("target"))
    best = each.groupBy("call").agg(F.min_by(F.struct("copies", "target"), "distance").alias("b"), F.min("distance").alias("distance"))
    rows = calls.join(best, "call", "left")
    sure = F.col("b.copies") == 1
    reason = F.when(sure, None).when(F.col("b.copies") > 1, "AMBIGUOUS_TARGET").otherwise("MISSING_TYPE")
    return rows.select("call", F.when(sure, F.col("b.target")).alias("target"), F.when(sure, F.col("distance")).alias("distance"), F.when(sure, "STATIC_RESOLVED").otherwise("UNRESOLVED").alias("state"), reason.alias("reason"))


def resolved_names(wanted: DataFrame, platform: DataFrame, sources: DataFrame, archives: DataFrame) -> DataFrame:
    """(name, origin, target, reason) of wanted names: the platform first, then the sources, then the archives in their order.

    platform: (name, target); sources: (name, target), where a name declared twice is no type at all and hides the archives;
    archives: (name, artifact_order, target).  One ranked aggregate over the union of all three.
    """
    rows = (
        platform.select("name", F.lit("PLATFORM").alias("origin"), F.lit(0).alias("level"), F.lit(0).alias("artifact_order"), "target")
        .unionByName(sources.select("name", F.lit("SOURCE").alias("origin"), F.lit(1).alias("level"), F.lit(0).alias("artifact_order"), "target"))
        .unionByName(archives.select("name", F.lit("ARCHIVE").alias("origin"), F.lit(2).alias("level"), "artifact_order", "target"))
    )
    best = rows.groupBy("name").agg(F.min_by(F.struct("origin", "target"), F.struct("level", "artifact_order", "target")).alias("b"), F.count_if(F.col("level") == 1).alias("copies"))
    found = wanted.select("name").distinct().join(best, "name", "left")
    twice = (F.col("b.origin") == "SOURCE") & (F.col("copies") > 1)
    reason = F.when(F.col("b").isNull(), "MISSING_TYPE").when(twice, "DUPLICATE_SOURCE_TYPE")
    return found.select("name", F.when(reason.isNull(), F.col("b.origin")).alias("origin"), F.when(reason.isNull(), F.col("b.target")).alias("target"), reason.alias("reason"))
