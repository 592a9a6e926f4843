"""The diff of two builds: blocking, anchors, neighbours, assignment, verification, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators.anchors import seed_anchors
from kindred.operators.assign import assign
from kindred.operators.lsh import nearest
from kindred.operators.similarity import class_similarity, compared
from kindred.operators.simhash import signatures, with_abstract
from kindred.plans.lineage import cut, kept, sent
from kindred.schema import CALL_SITE_FLOOR, MAX_REFS, MAX_ROUNDS, TOP_K, DiffOptions

_CLASS = ("pos", "descriptor", "package", "name", "source_file", "access", "superclass", "interfaces", "strings", "fields", "methods", "sequence")


def in_scope(classes: DataFrame, package: str | None) -> DataFrame:
    """Classes of a package and its sub-packages."""
    return classes.where(S.in_package("package", package)) if package else classes


def quality_filter(classes: DataFrame, opts: DiffOptions) -> DataFrame:
    keep = F.lit(True)
    if opts.synthetic_skipping:
        keep = keep & ~F.col("is_synthetic")
    if opts.skip_boilerplate:
        keep = keep & ~S.is_boilerplate()
    if opts.inner_skipping:
        keep = keep & ~F.col("is_inner")
    if opts.external_skipping:
        keep = keep & ~F.col("is_external")
    if opts.min_inst_size_threshold:
        keep = keep & (S.total_instructions() >= opts.min_inst_size_threshold)
    return classes.where(keep)


def prepared(classes: DataFrame, opts: DiffOptions) -> DataFrame:
    """(pool, pos, descriptor, sig, c): what the diff joins; c is the class with its abstract sequence, its methods without bytecode.

    Rows that come with a signature (a fingerprint store) are not signed again.
    """
    rows = with_abstract(quality_filter(classes, opts))
    # what the code is made of is told by then: no later step reads it
    rows = rows.withColumn("methods", F.transform("methods", lambda m: m.dropFields("bytecode")))
    rows = rows if "sig" in rows.columns else signatures(rows)
    rows = rows.withColumn("sequence", S.abstract_sequence())
    pool = S.pool_key("package", opts.cluster, opts.find_obfuscated_packages)
    return rows.select(pool.alias("pool"), "pos", "descriptor", "sig", F.struct(*_CLASS).alias("c"))


def _pairs(pairs: DataFrame, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """Pairs (pool, l, r, ...) with both classes as a and b."""
    left = lhs.select(F.col("pos").alias("l"), F.col("c").alias("a"))
    right = rhs.select(F.col("pos").alias("r"), F.col("c").alias("b"))
    return pairs.join(left, "l").join(right, "r")


def _slim(side: DataFrame) -> DataFrame:
    """A side whose classes lack the abstract sequence, which candidates alone are ranked by."""
    return side.withColumn("c", F.struct(*[F.col(f"c.{n}").alias(n) for n in side.schema["c"].dataType.names if n != "sequence"]))


def _shape(side: DataFrame) -> DataFrame:
    """(pool, pos, sig, c): of the classes only what class_similarity looks at, since each of them travels to every candidate."""
    fields = F.transform("c.fields", lambda f: F.struct(f["type_desc"].alias("type_desc")))
    methods = F.transform("c.methods", lambda m: F.struct(m["return_type"].alias("return_type"), m["arg_count"].alias("arg_count")))
    own = [F.col(f"c.{n}").alias(n) for n in ("access", "superclass", "interfaces", "sequence")]
    return side.select("pool", "pos", "sig", F.struct(*own, fields.alias("fields"), methods.alias("methods")).alias("c"))


def _ranked(near: DataFrame, lhs: DataFrame, rhs: DataFrame, score: Column) -> DataFrame:
    return _pairs(near, lhs, rhs).select("pool", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), score.alias("score"))


def pool_table(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """(pool, n_lhs, n_rhs): the full co-group of blocking keys."""
    one = lhs.groupBy("pool").agg(F.count("*").alias("n_lhs"))
    two = rhs.groupBy("pool").agg(F.count("*").alias("n_rhs"))
    return one.join(two, "pool", "full").select("pool", F.coalesce("n_lhs", F.lit(0)).alias("n_lhs"), F.coalesce("n_rhs", F.lit(0)).alias("n_rhs"))


_FLAG = {"anchored": "anchored", "call_site": "call_site_anchored", "propagated": "propagated"}


def _as_matches(rows: DataFrame) -> DataFrame:
    """Compared pairs as match rows; how a pair was found is a flag of its breakdown too."""
    flag = F.coalesce(*[F.when(F.col("provenance") == k, F.lit(v)) for k, v in _FLAG.items()])
    breakdown = F.when(flag.isNotNull(), F.map_concat("breakdown", F.map_from_arrays(F.array(F.coalesce(flag, F.lit("-"))), F.array(F.lit(1.0))))).otherwise(F.col("breakdown"))
    return rows.select("pool", "l", "r", F.col("a.descriptor").alias("lhs"), F.col("b.descriptor").alias("rhs"), "similarity", breakdown.alias("breakdown"), "method_rows", "provenance", "ord", "a", "b")


#: Places that are sent to every task, some 30 bytes each, so that the classes are not shuffled to find those at them.
MOST_PLACES = 2_000_000


def _alone(side: DataFrame, paired: DataFrame, left: bool) -> DataFrame:
    key, own, other = ("l", "a", "b") if left else ("r", "b", "a")
    # places alone are shuffled to tell which are left
    places = sent(side.select("pos").join(paired.select(F.col(key).alias("pos")).hint("merge"), "pos", "left_anti"), MOST_PLACES)
    rest = side.join(places, "pos", "left_semi")
    none = F.lit(None)
    kind = side.schema["c"].dataType
    cols = {
        "pool": F.col("pool"), "l": F.col("pos") if left else none.cast("int"), "r": none.cast("int") if left else F.col("pos"),
        "lhs": F.col("descriptor") if left else none.cast("string"), "rhs": none.cast("string") if left else F.col("descriptor"),
        "similarity": F.lit(0.0), "breakdown": none.cast("map<string,double>"), "method_rows": none.cast("array<struct<l:int,r:int,score:double,status:string>>"),
        "provenance": F.lit("deleted" if left else "added"), "ord": none.cast("struct<product:bigint,pool:string,stage:int,nth:bigint>"),
        own: F.col("c"), other: none.cast(kind),
    }
    return rest.select(*[cols[n].alias(n) for n in ("pool", "l", "r", "lhs", "rhs", "similarity", "breakdown", "method_rows", "provenance", "ord", "a", "b")])


def _order(product: Column, stage: Column, nth: Column) -> Column:
    return F.struct(product.cast("long").alias("product"), F.col("pool"), stage.cast("int").alias("stage"), nth.cast("long").alias("nth"))


def structural_diff(lhs: DataFrame, rhs: DataFrame, threshold: float, opts: DiffOptions) -> DataFrame:
    """Paired rows of prepared sides, all pools in one plan."""
    pools = pool_table(lhs, rhs).withColumn("product", -F.col("n_lhs") * F.col("n_rhs"))
    rest_l, rest_r, anchored = _shape(lhs), _shape(rhs), None
    if opts.anchoring:
        anchored = cut(seed_anchors(lhs, rhs))
        # kept: the rest is read many times, by its signatures and then by its shapes
        rest_l = kept(rest_l.join(anchored.select("pool", F.col("l").alias("pos")), ["pool", "pos"], "left_anti"))
        rest_r = kept(rest_r.join(anchored.select("pool", F.col("r").alias("pos")), ["pool", "pos"], "left_anti"))
    ids = lambda df: df.select("pool", F.col("pos").alias("id"), "sig")
    near = nearest(ids(rest_l), ids(rest_r), opts.top_match_threshold, opts.buckets, opts.probe_radius)
    scored = cut(_ranked(near, rest_l, rest_r, class_similarity(F.col("a"), F.col("b"))))
    chosen = assign(scored, rest_l.groupBy("pool").agg(F.count("*").alias("n_left")), opts.assignment)
    pairs = chosen.select("pool", "l", "r", F.lit("structural").alias("provenance"), F.lit(1).alias("stage"), "nth")
    if anchored is not None:
        pairs = pairs.unionByName(anchored.select("pool", "l", "r", F.lit("anchored").alias("provenance"), F.lit(0).alias("stage"), "nth"))
    # pools are joined while pairs are places alone
    pairs = pairs.join(pools.select("pool", "product"), "pool").select("pool", F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "provenance", _order(F.col("product"), F.col("stage"), F.col("nth")).alias("ord"))
    rows = kept(_as_matches(compared(_pairs(pairs, _slim(lhs), _slim(rhs)))))
    # told of what is kept: a filter beneath would compare each pair twice
    return rows.where((F.col("provenance") == "anchored") | (F.col("similarity") >= threshold))


def referenced_descriptors(c: Column) -> Column:
    """A class' distinct references in order: superclass, interfaces, field types, prototypes; at most 32."""
    one = F.when(F.coalesce(c["superclass"], F.lit("")) != "", F.array(c["superclass"])).otherwise(F.array().cast("array<string>"))
    typed = F.flatten(F.transform(c["fields"], lambda f: S.object_types(f["type_desc"])))
    proto = F.flatten(F.transform(c["methods"], lambda m: S.object_types(m["descriptor"])))
    return F.slice(F.array_distinct(F.concat(one, c["interfaces"], typed, proto)), 1, MAX_REFS)


def call_sites(side: DataFrame) -> DataFrame:
    """(pos, method, i, descriptor): what the methods of a prepared side's classes instantiate, by place."""
    made = side.select("pos", F.posexplode("c.methods").alias("method", "m")).select("pos", "method", F.col("m.instantiates").alias("x"))
    return made.select("pos", "method", F.posexplode("x").alias("i", "descriptor"))


def site_claims(frontier: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(lhs, rhs, claim: ord, m, i): of pairs (l, r, ord, method_rows) and both sides' call sites, positional pairs
    of what matched methods instantiate, each where it is met first."""
    both = F.filter("method_rows", lambda x: x["l"].isNotNull() & x["r"].isNotNull())
    met = frontier.select("l", "r", "ord", F.posexplode(both).alias("m", "x")).select("l", "r", "ord", "m", F.col("x.l").alias("ml"), F.col("x.r").alias("mr"))
    one = left.select(F.col("pos").alias("l"), F.col("method").alias("ml"), "i", F.col("descriptor").alias("lhs"))
    two = right.select(F.col("pos").alias("r"), F.col("method").alias("mr"), "i", F.col("descriptor").alias("rhs"))
    return met.join(one, ["l", "ml"]).join(two, ["r", "mr", "i"]).groupBy("lhs", "rhs").agg(F.min(F.struct("ord", "m", "i")).alias("claim"))


def call_site_claims(frontier: DataFrame) -> DataFrame:
    """site_claims of rows that carry their classes as a and b."""
    rows = frontier.withColumn("l", F.monotonically_increasing_id()).withColumn("r", F.col("l"))
    rows = cut(rows)
    side = lambda c: call_sites(rows.select(F.col("l").alias("pos"), F.struct(f"{c}.methods").alias("c")))
    return site_claims(rows.select("l", "r", "ord", "method_rows"), side("a"), side("b"))


def class_references(side: DataFrame) -> DataFrame:
    """(pos, i, descriptor): the references of a prepared side's classes in their order."""
    return side.select("pos", F.posexplode(referenced_descriptors(F.col("c"))).alias("i", "descriptor"))


#: Rows of a round's joins that are sent to every task, at most some 150 bytes each; a round has a dozen such joins.
MOST_DEALT = 10_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows, n of them, that meet a whole side: sent to every task where they are few, else shuffled with it.

    Either way the side itself is not broadcast: a checkpoint tells the size of the files that it was read from, so
    that the planner takes a side of millions of classes for one of a few MB.
    """
    return F.broadcast(rows) if n <= MOST_DEALT else rows.hint("merge")


def _found_pairs(pairs: DataFrame, n: int, lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """_pairs of rows that are computed already, n of them: only the classes that they name are shuffled where they are few."""
    left = lhs.select(F.col("pos").alias("l"), F.col("c").alias("a")).join(_dealt(pairs, n), "l")
    right = rhs.select(F.col("pos").alias("r"), F.col("c").alias("b")).join(_dealt(pairs.select("r"), n), "r", "left_semi")
    return left.join(right.hint("merge"), "r")


def _sites_of(sites: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The call sites of the classes at places (pos), n of them."""
    return sites.join(_dealt(places, n), "pos", "left_semi").hint("merge")


def _free(side: DataFrame, told: DataFrame, n: int, paired: DataFrame, n_paired: int) -> DataFrame:
    """The rows of a side (pos, descriptor, sig) that are told by descriptor, n of them, and whose places are not paired yet."""
    return side.join(_dealt(told, n), "descriptor").join(_dealt(paired, n_paired), "pos", "left_anti")


def _first_referenced(frontier: DataFrame, n: int, references: DataFrame, side: DataFrame, paired: DataFrame, n_paired: int) -> DataFrame:
    """(id, pos, sig): the free classes that the frontier (pos, ord), n rows, refers to, numbered over sorted ranges by where they are first referred to."""
    told = cut(references.join(_dealt(frontier, n), "pos").groupBy("descriptor").agg(F.min(F.struct("ord", "i")).alias("first")))
    free = _free(side, told, told.count(), paired, n_paired)
    return cut(free.select("first", "pos", "sig").orderBy("first", "pos").select(F.monotonically_increasing_id().alias("id"), "pos", "sig"))


_SCORED = ("l", "r", "similarity", "breakdown", "method_rows")


def propagate(matches: DataFrame, lhs: DataFrame, rhs: DataFrame, threshold: float, mode: str = "auto", most_rounds: int = MAX_ROUNDS, most_frontier: int | None = None) -> DataFrame:
    """Spreads pairs along call sites and type references until a round brings nothing new.

    matches: paired rows; lhs, rhs: prepared sides. Returns the new pairs. Rounds carry places, signatures and
    scores; references and call sites are taken from the classes once, the classes join a pair to score it, and the
    found ones at the end. What a round asks for goes to the sides, which stay where they are unless it is much. `most_frontier` leaves type references out where a side refers to more free classes
    (other readers of the same definition stop at 50,000); None sets no limit.
    """
    flat = lambda df: cut(df.select("pos", "descriptor", "sig"))
    left, right = flat(lhs), flat(rhs)
    sites_l, sites_r, refs_l, refs_r = cut(call_sites(lhs)), cut(call_sites(rhs)), cut(class_references(lhs)), cut(class_references(rhs))
    called = not sites_l.isEmpty() and not sites_r.isEmpty()
    frontier = cut(matches.select("l", "r", "ord", "method_rows"))
    found, n_found, paired, n_frontier = None, 0, frontier.select("l", "r"), frontier.count()
    n_paired = n_frontier
    at = lambda rows, key: rows.select(F.col(key).alias("pos"))
    scored = lambda df, *more: compared(_found_pairs(df, df.count(), lhs, rhs)).select(*_SCORED, *more)
    for round_no in range(most_rounds):
        paired = cut(paired)
        taken, n_taken = paired, n_paired
        claims = None
        if called:
            claims = cut(site_claims(frontier, _sites_of(sites_l, at(frontier, "l"), n_frontier), _sites_of(sites_r, at(frontier, "r"), n_frontier)))
            n_claims = claims.count()
            free = lambda side, name, key: _free(side, claims.select(F.col(name).alias("descriptor")).distinct(), n_claims, at(paired, key), n_paired).select(F.col("descriptor").alias(name), F.col("pos").alias(key)).hint("merge")  # noqa: B023, E731
            claims = cut(claims.join(free(left, "lhs", "l"), "lhs").join(free(right, "rhs", "r"), "rhs").select("l", "r", "claim"))
            claims = cut(scored(claims, "claim").where(F.col("similarity") >= CALL_SITE_FLOOR))
        new = None
        if claims is not None and not claims.isEmpty():
            # first wins: a claim's place in the sorted order is its (negated) score
            claims = cut(claims.orderBy("claim").withColumn("place", F.monotonically_increasing_id()))
            ranked = claims.select(F.lit("").alias("pool"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), (-F.col("place")).cast("double").alias("score"))
            won = assign(ranked, ranked.groupBy("pool").agg(F.countDistinct("l").alias("n_left")), "greedy")
            new = claims.join(_dealt(won.select(F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "nth"), claims.count()), ["l", "r"])
            new = cut(new.select(*_SCORED, F.lit("call_site").alias("provenance"), F.lit(2 * round_no + 2).alias("stage"), "nth"))
            taken, n_taken = paired.unionByName(new.select("l", "r")), n_paired + new.count()
        asked = lambda key: frontier.select(F.col(key).alias("pos"), "ord")  # noqa: B023, E731
        one = _first_referenced(asked("l"), n_frontier, refs_l, left, at(taken, "l"), n_taken)
        two = _first_referenced(asked("r"), n_frontier, refs_r, right, at(taken, "r"), n_taken)
        n_left, n_right = one.count(), two.count()
        if n_left and n_right and (most_frontier is None or max(n_left, n_right) <= most_frontier):
            pool = lambda df: df.select(F.lit("").alias("pool"), "id", "sig")
            near = nearest(pool(one), pool(two), TOP_K).select(F.col("l").alias("li"), F.col("r").alias("ri"))
            near = near.join(_dealt(one.select(F.col("id").alias("li"), F.col("pos").alias("l")), n_left), "li").join(_dealt(two.select(F.col("id").alias("ri"), F.col("pos").alias("r")), n_right), "ri")
            near = cut(scored(cut(near), "li", "ri"))
            ranked = near.select(F.lit("").alias("pool"), F.col("li").cast("long").alias("l"), F.col("ri").cast("long").alias("r"), F.col("similarity").alias("score"))
            chosen = assign(ranked, _one_pool(ranked, n_left), mode).select(F.col("l").alias("li"), F.col("r").alias("ri"), "nth")
            more = near.join(_dealt(chosen, min(n_left, n_right)), ["li", "ri"]).where(F.col("similarity") >= threshold)
            more = more.select(*_SCORED, F.lit("propagated").alias("provenance"), F.lit(2 * round_no + 3).alias("stage"), "nth")
            new = more if new is None else new.unionByName(more)
        if new is None:
            break
        new = new.withColumn("pool", F.lit("")).withColumn("ord", _order(F.lit(0), F.col("stage"), F.col("nth")))
        new = cut(new.select("pool", *_SCORED, "provenance", "ord"))
        n_frontier = new.count()
        if not n_frontier:
            break
        found, n_found, n_paired = new if found is None else found.unionByName(new), n_found + n_frontier, n_paired + n_frontier
        paired, frontier = paired.unionByName(new.select("l", "r")), new.select("l", "r", "ord", "method_rows")
    return _as_matches(_found_pairs(found, n_found, lhs, rhs)) if found is not None else matches.limit(0)


def _one_pool(rows: DataFrame, n: int) -> DataFrame:
    """(pool, n_left) of the one pool of propagated candidates."""
    return rows.sparkSession.createDataFrame([("", n)], "pool string, n_left long")


def diff(lhs: DataFrame, rhs: DataFrame, threshold: float = 0.8, options: DiffOptions | dict | None = None) -> DataFrame:
    """Match rows of two builds: paired, deleted (rhs null) and added (lhs null).

    Columns: pool, l, r (places), lhs, rhs (descriptors), similarity (1 is identical), breakdown,
    method_rows, provenance, ord (order in which pairs were found), a, b (the classes, their methods without bytecode).
    """
    opts = options if isinstance(options, DiffOptions) else DiffOptions.from_dict(options)
    left, right = kept(prepared(lhs, opts)), kept(prepared(rhs, opts))
    pairs = structural_diff(left, right, threshold, opts)
    left, right = _slim(left), _slim(right)
    if opts.propagation:
        more = kept(propagate(pairs, left, right, threshold, opts.assignment, most_frontier=opts.max_frontier))
        pairs = pairs.unionByName(more)
    return pairs.unionByName(_alone(left, pairs, True)).unionByName(_alone(right, pairs, False))
