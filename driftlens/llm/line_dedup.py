"""Fuzzy line deduplication by MinHash over character shingles. DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bitmap_filter, release, settled, small, spread, written

#: Characters to a shingle and least Jaccard similarity.
SHINGLE, SIMILARITY = 8, 0.8
#: Greatest distance of a link.
FAR = 1 - SIMILARITY + 1e-9
#: Minima of a signature, and the threes of them that form its bands: no two minima are together twice.
MINIMA = 12
BANDS = [(1, 5, 10), (2, 4, 6), (3, 7, 11), (0, 8, 9), (4, 8, 10), (3, 5, 9), (0, 2, 7), (1, 6, 11), (2, 5, 11), (1, 7, 8), (6, 9, 10), (0, 3, 4)]
#: Minima in common that a pair needs to be verified.
AGREE = 5
#: Distinct lines in a bucket beyond which its pairs are taken only between lines that no links tie yet, and those beyond which that goes by turns and tasks.
CROWD, CHUNK = 32, 2048
#: Of such a bucket about how many lines have had their turn after each but the last.
TURNS = (64, 1024)
#: Shingles of a line that are folded before they meet the aggregate.
TOGETHER = 8
#: Words of 64 bits in the sketch of a line.
SKETCH = 8
_draw = random.Random(1905)
#: An order of 32-bit hashes each: by their distance, bit by bit from the highest, to a random point.
_POINTS = [_draw.getrandbits(31) for _ in range(MINIMA // 2)]


def normal_line(line: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank; the pattern runs only where there is such a run."""
    low = F.lower(line)
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def line_rows(df: DataFrame, text_col: str) -> DataFrame:
    """Explode texts to lines: other columns, ``line_no`` from 0, ``line``. A null text is one empty line."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return df.select(*[c for c in df.columns if c != text_col], F.posexplode(lines).alias("line_no", "line"))


def shingles(line: Column) -> Column:
    """The character shingles of a line as 64-bit hashes, with repeats; a shorter line is its own shingle."""
    # Four bytes a character: a shingle is then a slice, whatever stands before it. As a lambda's variable they are made once.
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.octet_length(w) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    hashes = lambda w: F.transform(at(w), lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SHINGLE))))
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), hashes), 1)


def sketches(lines: DataFrame) -> DataFrame:
    """Of each ``cid`` with its ``line`` the number ``n`` of distinct shingles, and ``s0``, ``s1``, ...: whether each of 64 ``SKETCH`` cells has an odd number of them.

    Two sketches differ in at most as many bits as the lines have shingles not in common.
    """
    each = lines.select("cid", F.explode(F.array_distinct(shingles(F.col("line")))).alias("h"))
    each = each.select("cid", F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"), F.expr(f"cast(shiftrightunsigned(h, 6) & {SKETCH - 1} as int)").alias("at"))
    return each.groupBy("cid").agg(F.count("*").cast("int").alias("n"), *[F.bit_xor(F.when(F.col("at") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)])


def signatures(lines: DataFrame) -> DataFrame:
    """MinHash minima ``m0``, ``m1``, ... of ``line`` by long ``row``.

    ``TOGETHER`` shingles are a row of one codegen stage: each hashed once,
    then folded to all minima, first with each other and then by a hash
    aggregate before the exchange. All shingles of a line sign it, whatever its
    length. The hash nearest to a random point, and the
    farthest, in the order of their differing bits is each any shingle of the
    line with equal chance.
    """
    # Two bytes a character: a shingle is then a slice, whatever stands before it.
    rows = lines.select("row", F.encode("line", "UTF-16BE").alias("w"))
    rows = rows.withColumn("last", F.greatest(F.octet_length("w") - (2 * SHINGLE - 1), F.lit(1)))
    at = F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * TOGETHER)))
    few, each = range(TOGETHER), rows.select("row", "w", "last", at.alias("i"))
    # Past the last shingle it comes again, which no minimum minds.
    each = each.select("row", *[F.hash(F.substring(F.col("w"), F.least(F.col("i") + 2 * j, F.col("last")), F.lit(2 * SHINGLE))).alias(f"h{j}") for j in few])
    each = each.select("*", *[F.hash(f"h{j}").alias(f"g{j}") for j in few])
    apart = lambda k: [F.col(f"{'hg'[k // 2 % 2]}{j}").bitwiseXOR(F.lit(_POINTS[k // 2])) for j in few]
    return each.groupBy("row").agg(*[F.min(F.least(*apart(k))).alias(f"m{k}") if k % 2 else F.max(F.greatest(*apart(k))).alias(f"m{k}") for k in range(MINIMA)])


def _agreement(p: Column, q: Column) -> Column:
    """In how many of their five-bit parts two packed signatures agree."""
    x = p.bitwiseXOR(q)
    folded = x
    for k in range(1, 5):
        folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
    return MINIMA - F.bit_count(folded.bitwiseAND(F.lit(sum(1 << 5 * k for k in range(MINIMA)))))


def _packed(minima: Column) -> Column:
    """The lowest five bits of each minimum in one long."""
    low = lambda k: F.shiftleft(F.element_at(minima, k + 1).cast("long").bitwiseAND(F.lit(31)), 5 * k)
    out = low(0)
    for k in range(1, MINIMA):
        out = out.bitwiseOR(low(k))
    return out


def _within(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` within small buckets that agree in ``AGREE`` minima."""
    packed = members.join(heads.select("cid", "p"), "cid")
    side = lambda at: packed.select("key", F.col("cid").alias(at), F.col("p").alias(f"p_{at}"))
    both = side("a").join(side("b"), "key").where("a < b")
    return both.where(_agreement(F.col("p_a"), F.col("p_b")) >= AGREE).select("a", "b")


def _seeds(crowded: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` that are likely to tie a crowded bucket together, two a row: each line with the bucket's first and with the one before it in the order of the minima.

    The order begins with another minimum from bucket to bucket.
    """
    rows = crowded.join(heads.select("cid", "p"), "cid").withColumn("turned", F.expr("shiftleft(p, cast(5 * pmod(key, 12) as int))"))
    rows = rows.withColumn("before", F.lag("cid").over(Window.partitionBy("key").orderBy("turned", "p", "cid")))
    pairs = rows.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("cid").alias("b")), F.struct(F.least("before", "cid").alias("a"), F.greatest("before", "cid").alias("b")))).alias("x"))
    return pairs.select("x.a", "x.b").where("a < b").distinct()


def _rest(crowded: DataFrame, heads: DataFrame, judged: DataFrame, comps: DataFrame, drawn: DataFrame, turn: int) -> DataFrame | None:
    """A written table of pairs ``a`` < ``b`` of crowded buckets that aren't ``judged`` nor tied by ``comps`` yet, agree in ``AGREE`` minima and aren't ruled out by their sketches.

    In a bucket of up to ``CHUNK`` lines those outside its largest component are
    held against all. In a larger one as many lines as ``TURNS`` names at
    ``turn`` are held against all that had no turn, in the last turn all that
    are left, so that most are tied by then. A bucket of one component costs
    nothing; None if all are. A head whose star isn't of one component counts as
    one of its own: ``_crossing`` goes by the pairs of such heads. Its bound by a
    star's largest distance is kept too.
    """
    of = lambda at: comps.select(F.col("id").alias(at), F.col("component").alias(f"c_{at}"))
    odd = F.max(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).alias("odd")
    stars = judged.where("star").select("a", "b", "d")
    stars = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").groupBy(F.col("a").alias("cid")).agg(F.max("d").alias("most"), odd)
    big, last = F.col("size") > CHUNK, turn == len(TURNS)
    rows = crowded.select("key", "cid", F.col("n").alias("size")).where(big | F.lit(turn == 0))
    rows = rows.join(comps.withColumnRenamed("id", "cid"), "cid", "left").join(stars, "cid", "left")
    # Ids are not negative.
    rows = rows.withColumn("label", F.when(F.col("odd"), -1 - F.col("cid")).otherwise(F.coalesce("component", "cid"))).withColumn("most", F.coalesce("most", F.lit(0.0)))
    kinds = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("kinds"))
    rows = rows.join(kinds.where("kinds > 1").select("key", "main"), "key").withColumn("rest", F.col("label") != F.col("main"))
    place, when = F.pmod(F.xxhash64("key", "cid"), "size"), F.lit(len(TURNS))
    for k, most in reversed(list(enumerate(TURNS))):
        when = F.when(place < most, k).otherwise(when)
    rows = rows.withColumn("slot", F.when(big, when).otherwise(0)).where(F.col("slot") >= turn).select("key", "cid", "label", "rest", "most", "slot", "size")
    rows = settled(rows.join(heads.select("cid", "p"), "cid").join(drawn, "cid"), "untied")
    out = None
    if rows.limit(1).count():
        ways, whole = F.ceil(F.col("size") / CHUNK).cast("int"), ~big | F.lit(last)
        side = lambda d, at: d.select("key", "s", *[F.col(c).alias(f"{c}_{at}") for c in rows.columns if c != "key"])
        few = side(rows.where((F.col("slot") == turn) & (F.col("rest") | ~whole)).withColumn("s", F.explode(F.sequence(F.lit(0), ways - 1))), "a")
        many = side(rows.withColumn("s", F.pmod(F.xxhash64("cid"), ways).cast("int")), "b")
        once = F.when((F.col("size_a") <= CHUNK) | F.lit(last), ~F.col("rest_b")).otherwise(F.col("slot_b") > turn) | (F.col("cid_a") < F.col("cid_b"))
        both = few.join(many, ["key", "s"]).where(F.col("label_a") != F.col("label_b")).where(once)
        both = both.where(_agreement(F.col("p_a"), F.col("p_b")) >= AGREE).where(_least() - F.col("most_a") - F.col("most_b") <= FAR)
        both = both.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()
        out = settled(both.join(judged.select("a", "b"), ["a", "b"], "left_anti").withColumn("star", F.lit(False)), "rest")
    release(rows)
    return out


def _least() -> Column:
    """What the distance of two lines is at least, by their sketches ``n_a``, ``s0_a``, ... and ``n_b``, ``s0_b``, ..."""
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(1, SKETCH)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    apart = F.greatest(apart, F.abs(F.col("n_a") - F.col("n_b")))
    return 2 * apart / (F.col("n_a") + F.col("n_b") + apart)


def _crossing(judged: DataFrame, comps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a``, ``b`` of lines that only their heads stood for: candidates that are not judged yet nor of one component.

    ``judged``: ``a``, ``b``, ``star`` (``b`` has the signature of head ``a``;
    else both are heads), distance ``d``, null where it wasn't taken (not of
    stars), and ``least``, which it is at least; ``comps``: ``id``,
    ``component``. Distance 1 - Jaccard is a metric: pairs that the distances by
    way of their heads put too far apart are left out.
    """
    far = 1 - similarity + 1e-9
    stars = judged.where("star").select(F.col("a").alias("head"), F.col("b").alias("cid"), "d")
    heads = judged.select(F.col("a").alias("cid")).unionByName(judged.where("not star").select(F.col("b").alias("cid"))).distinct()
    members = stars.unionByName(heads.select(F.col("cid").alias("head"), "cid", F.lit(0.0).alias("d")))
    members = members.join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("c", F.coalesce("component", "cid")).drop("component")
    members = settled(members, "members")
    spans = members.groupBy("head").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("d").alias("most"), F.count("*").alias("n"))
    side = lambda d, at, more: d.select(F.col("head").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in more])
    own = spans.where("n > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(0.0).alias("d"), F.lit(0.0).alias("least"))
    groups = judged.where("not star").select("a", "b", "d", "least").unionByName(own)
    of = ["low", "high", "most", "n"]
    groups = groups.join(side(spans, "a", of), "a").join(side(spans, "b", of), "b").where("n_a > 1 or n_b > 1")
    groups = groups.where(F.least("low_a", "low_b") < F.greatest("high_a", "high_b"))
    groups = groups.where(F.col("least") - F.col("most_a") - F.col("most_b") <= far)
    both = groups.select("a", "b", "d", "least").join(side(members, "a", ["cid", "c", "d"]), "a").join(side(members, "b", ["cid", "c", "d"]), "b")
    # The greatest passes over nulls.
    apart = F.greatest(F.col("least") - F.col("d_a") - F.col("d_b"), F.col("d_a") - F.col("d_b") - F.col("d"), F.col("d_b") - F.col("d_a") - F.col("d"), F.lit(0.0))
    new = F.when(F.col("a") == F.col("b"), (F.col("cid_a") < F.col("cid_b")) & (F.col("cid_a") != F.col("a"))).otherwise((F.col("cid_a") != F.col("a")) | (F.col("cid_b") != F.col("b")))
    return both.where("c_a <> c_b").where(new & (apart <= far)).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (``id``, ``component``) after further links: union-find over the components only."""
    of = lambda at: comps.select(F.col("id").alias(at), F.col("component").alias(f"c_{at}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    roots = connected_components(both.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    moved = comps.join(roots.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    lone = roots.join(comps, "id", "left_anti")
    return written(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(lone.select("id", "component")), "components")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link lines whose character shingles have a Jaccard similarity of 0.8 or more; keep one of each component.

    Lines are cut at newlines and compared in lower case with runs of white
    space as one blank; equal ones are folded first. Twelve bands of three of
    the ``MINIMA`` minima make candidates of a pair at 0.8 with a chance of
    0.993, those of fewer than ``AGREE`` equal minima left out. In a bucket over
    ``CROWD`` distinct lines a few pairs a line come first; the others are taken
    where no links tie their lines by then, whatever the bucket's size.
    Candidates whose sketches don't rule 0.8 out are verified by exact Jaccard
    of their shingles' 64-bit hashes. Of lines with all minima in common one
    goes to the bands; the others' pairs are compared then where their
    components are still apart.

    Returns a row per line: ``id_col``, ``line_no``, ``class_row`` (the line
    that its class keeps: the first by row of the table and line number),
    ``class_size`` and ``kept``. Blank lines, and those of null or empty texts,
    are no one's duplicates and kept. Repeated rows are documents of their own;
    extra columns are ignored; an empty table gives no rows.
    """
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    exploded = line_rows(source, "text").select("id", "line_no", normal_line(F.col("line")).alias("line"))
    keyed = exploded.withColumn("digest", F.when(F.col("line") != "", F.unhex(F.md5(F.encode("line", "UTF-8")))))
    lines = written(keyed.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("row")), "lines")
    ids = settled(lines.where("digest is not null").groupBy("digest").agg(F.min("row").alias("cid"), F.count("*").alias("n")), "distinct")
    # A few rows besides pass the filter; they are the same lines again and drop out when texts are joined.
    distinct = bitmap_filter(lines.where("digest is not null").select("row", "line", "h"), "h", ids.select(F.xxhash64("cid").alias("h")), "may").where("may")
    narrow = F.array(*[F.col(f"m{k}").cast("int") for k in range(MINIMA)])
    signed = signatures(distinct).select(F.col("row").alias("cid"), narrow.alias("minima"))
    signed = settled(signed.withColumn("sig", F.xxhash64("minima")).withColumn("p", _packed(F.col("minima"))), "signatures")
    # Lines of one signature are near each other all but surely: a star stands for them, whatever their number.
    shared = written(signed.groupBy("sig").agg(F.min("cid").alias("a"), F.count("*").alias("n")).where("n > 1").select("sig", "a"), "shared")
    few = small(shared, 16)
    starred = spread(signed.select("sig", "cid"), shared, ["sig"], "inner") if few is shared else signed.select("sig", "cid").join(few, "sig")
    marked = written(starred.where("a <> cid").select("a", F.col("cid").alias("b")), "stars")
    heads = settled(signed.join(marked.select(F.col("b").alias("cid")), "cid", "left_anti"), "heads")
    release(signed)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(b), *[F.element_at("minima", k + 1) for k in band]) for b, band in enumerate(BANDS)]))
    bucket = Window.partitionBy("key")
    met = heads.select(keys.alias("key"), "cid").withColumns({"n": F.count("*").over(bucket), "first": F.min("cid").over(bucket)}).where("n > 1")
    members = settled(met, "members")
    crowded = members.where(F.col("n") > CROWD)
    met = _within(members.where(F.col("n") <= CROWD), heads).unionByName(_seeds(crowded, heads)).distinct()
    pairs = settled(met.select("a", "b", F.lit(False).alias("star")).unionByName(marked.select("a", "b", F.lit(True).alias("star"))), "pairs")
    release(shared, marked)
    wanted = written(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct().join(ids.select("cid"), "cid"), "wanted")
    some = bitmap_filter(lines.select(F.col("row").alias("cid"), "line", "h"), "h", wanted.select(F.xxhash64("cid").alias("h")), "may").where("may")
    texts = settled(some.select("cid", "line").join(small(wanted, 8), "cid"), "texts")
    drawn = settled(sketches(texts), "sketches")
    release(wanted)
    words = ["n", *[f"s{k}" for k in range(SKETCH)]]
    of = lambda table, at, more: table.select(F.col("cid").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in more])

    def verified(pairs: DataFrame) -> DataFrame:
        """A written table of pairs with their distance ``d``, null where the sketches put them too far apart, and ``least``, which it is at least."""
        # Only a star's head may have very many pairs; a line is a member of one star.
        both = spread(pairs, of(drawn, "a", words), ["a"], "inner").join(of(drawn, "b", words), "b")
        held = settled(both.select(*pairs.columns, (F.col("n_a") + F.col("n_b")).alias("all"), _least().alias("least")), "held")
        open_ = near(F.col("least")) | F.col("star") if "star" in pairs.columns else near(F.col("least"))
        both = spread(held.where(open_), of(texts, "a", ["line"]), ["a"], "inner").join(of(texts, "b", ["line"]), "b")
        sizes = both.select(*pairs.columns, "all", F.size(F.array_intersect(shingles(F.col("line_a")), shingles(F.col("line_b")))).alias("n"))
        d = 1 - F.col("n") / (F.col("all") - F.col("n"))
        exact = sizes.select(*pairs.columns, d.alias("d"), d.alias("least"))
        out = settled(exact.unionByName(held.where(~open_).select(*pairs.columns, F.lit(None).cast("double").alias("d"), "least")), "judged")
        release(held)
        return out

    near = lambda d: d <= FAR
    judged = first = verified(pairs)
    comps = written(connected_components(judged.where(near(F.col("d"))).select("a", "b")), "components")
    later = []
    for turn in range(len(TURNS) + 1) if crowded.limit(1).count() else ():
        rest = _rest(crowded, heads, judged, comps, drawn, turn)
        if rest is None:
            break
        later += [rest, verified(rest)]
        judged = judged.unionByName(later[-1])
        comps = _merged(comps, later[-1].where(near(F.col("d"))).select("a", "b"))
    release(members, heads)
    if pairs.where("star").limit(1).count():
        more = settled(_crossing(judged, comps), "crossing")
        if more.limit(1).count():
            comps = _merged(comps, verified(more).where(near(F.col("d"))).select("a", "b"))
        release(more)
    release(texts, drawn, first, pairs, *later)
    of_line = ids.join(small(comps.withColumnRenamed("id", "cid"), 16), "cid", "left")
    linked = F.col("component").isNotNull().alias("linked")
    classed = settled(of_line.select("digest", "n", linked, F.coalesce("component", "cid").alias("component")), "classed")
    sizes = classed.groupBy("component").agg(F.sum("n").alias("size"))
    sized = classed.where("n > 1 or linked").select("component", "digest")
    sized = sized.join(sizes, "component")
    return spread(lines.select("id", "line_no", "row", "digest"), sized, ["digest"]).select(
        F.col("id").alias(id_col),
        "line_no",
        F.coalesce("component", "row").alias("class_row"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("component", "row") == F.col("row")).alias("kept"),
    )


def keep_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` (whose ids are unique) with only the kept lines of each text, in order; a null text stays null."""
    judged = dedup_lines(df, id_col, text_col)
    gone = judged.where("not kept").groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    out = df.join(gone, df[id_col] == gone["__id"], "left")
    lines = F.split(text_col, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("__gone", s["i"]))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return out.withColumn(text_col, text).drop("__id", "__gone")
