"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of all words, at most `most` times its own, the excess dealt out again by
weight. Within a source, size classes share the target the same way, longer documents at a lower weight, so documents have
unequal expected numbers of copies. The whole part of that number is certain; for the rest, with inclusion probability pi,
documents rank by (u / (1 - u)) / (pi / (1 - pi)), u a hash of id, source, text and, of rows equal in these, their number; those
of least rank are taken as long as the words stay within the target. The last place goes to one of the next NEXT ranks, that
which brings the words nearest to the target. The rank's cut is found by two rounds of histograms and a look at the one bin
that is left, so no source is sorted whole. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txintel.llm.text import neutral
from txintel.runtime import checkpoint, table

WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a rank, and of each histogram round.
RANK_BITS, ROUND_BITS = 40, 12
#: Ranks after the cut among which the last place is given.
NEXT = 16
#: Rows up to which a counted table of sources or classes is broadcast; larger ones join by shuffle.
SMALL_ROWS = 50_000


def _small(df: DataFrame) -> DataFrame:
    held = checkpoint(df)
    return F.broadcast(held) if held.count() <= SMALL_ROWS else held


def word_count(text: str | Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def with_chance(docs: DataFrame, id_col: str, source_col: str, text_col: str, name: str = "__u") -> DataFrame:
    """docs with name: a number in (0, 1) from a hash of id, source and text, nulls counting as empty, and the row's number among
    rows equal in these. Only rows that have equals are numbered, by partition and then over partitions, so that a very common
    row isn't gathered in one task; which of them gets which number makes no difference to what is taken."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, source_col)]
    digest = F.md5(F.concat_ws(":", *parts, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    keyed = docs.withColumn("__digest", digest)
    repeats = checkpoint(keyed.groupBy("__digest").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("__digest").alias("__again")))
    number = repeats.count()
    if not number:
        numbered = keyed.withColumn("__number", F.lit(0).cast("bigint"))
    else:
        again = F.broadcast(repeats) if number <= SMALL_ROWS else repeats
        same = F.col("__digest") == F.col("__again")
        held = checkpoint(keyed.join(again, same, "left_semi").withColumn("__part", F.spark_partition_id()))
        counts = held.groupBy("__digest", "__part").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__digest").orderBy("__part")) - F.col("__n")
        offsets = counts.select("__digest", "__part", before.alias("__before"))
        turn = F.row_number().over(Window.partitionBy("__digest", "__part").orderBy(F.lit(0))) - 1
        some = held.withColumn("__turn", turn).join(offsets, ["__digest", "__part"]).withColumn("__number", (F.col("__before") + F.col("__turn")).cast("bigint"))
        single = keyed.join(again, same, "left_anti").withColumn("__number", F.lit(0).cast("bigint"))
        numbered = single.unionByName(some.select(*single.columns))
    drawn = F.md5(F.concat_ws(":", "__digest", "__number").cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return numbered.withColumn(name, u).select(*docs.columns, name)


def share_out(rows: DataFrame, by: list[str], total: str, cap: str, weight: str, share: str) -> DataFrame:
    """rows with share = least(cap, level * weight), the level of each group such that shares sum to total or all are at cap."""
    order = Window.partitionBy(*by).orderBy(F.col("__full"), F.col(weight), F.col(cap))
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    full = rows.withColumn("__full", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(0.0))
    levels = full.withColumn("__level", F.when(rest > 0, (F.col(total) - before) / rest))
    top = F.max(F.when(F.col("__full") > F.col("__level"), F.col("__level"))).over(Window.partitionBy(*by))
    return levels.withColumn("__top", top).withColumn(share, F.when(F.col("__top").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("__top") * F.col(weight)))).drop("__full", "__level", "__top")


@dataclass
class Mix:
    """classes: source, class, certain, pi, source_size, target; cuts: source, cut, extra."""

    classes: DataFrame
    cuts: DataFrame


def _size_class(size: str) -> Column:
    return (F.length(F.bin(F.col(size) + 1)) - 1).cast("int")


def _rank(u_col: str, pi: str) -> Column:
    """Rank in [0, 2 ^ RANK_BITS): random odds over inclusion odds q, as q / (1 + q); null without a chance."""
    u = F.col(u_col)
    q = u / (1.0 - u) * (1.0 - F.col(pi)) / F.col(pi)
    return F.when(F.col(pi) > 0, F.least(F.floor(q / (1.0 + q) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)))


def plan_mix(sizes: DataFrame, u_col: str, source_col: str, size_col: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Mix:
    """From one row a document. Sources in code-point order, null last, take the weights in turn."""
    rows = sizes.select(F.col(source_col).alias("source"), F.col(u_col).alias("u"), F.col(size_col).alias("size"), _size_class(size_col).alias("class"))
    classes = checkpoint(rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    dealt = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((turn - 1) % len(weights) + 1).cast("int")))
    dealt = dealt.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double")).withColumn("cap", F.col("source_size") * float(most))
    targets = share_out(dealt, [], "total", "cap", "weight", "target").select("source", "source_size", "target")
    pairs = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "class", "words", "source_size", "target")
    pairs = pairs.withColumn("cap", F.col("words") * float(most)).withColumn("weight", F.col("words") * (64.0 - F.col("class")))
    copies = share_out(pairs, ["source"], "target", "cap", "weight", "share").withColumn("copies", F.when(F.col("words") > 0, F.col("share") / F.col("words")).otherwise(0.0))
    certain = F.floor(F.col("copies") + 1e-9)
    planned = copies.select("source", "class", "words", "source_size", "target", certain.cast("int").alias("certain"), F.greatest(F.col("copies") - certain, F.lit(0.0)).alias("pi"))
    planned = planned.withColumn("pi", F.when(F.col("pi") > 1e-9, F.col("pi")).otherwise(0.0))
    held = _small(planned)
    left = held.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("words"))).alias("left"))
    drawn = rows.alias("r").join(held.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.class") == F.col("p.class"))).filter("pi > 0").select("r.source", "size", _rank("u", "pi").alias("rank"))
    return Mix(held, _small(_cuts(drawn, left)))


def _cuts(drawn: DataFrame, left: DataFrame) -> DataFrame:
    """(source, cut, extra): ranks up to cut don't exceed what is left of the target; of the NEXT ranks after them the one that
    comes nearest to it, if any comes nearer, is extra."""
    state = _small(left.select("source", "left", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("base")))
    for done in range(ROUND_BITS, 2 * ROUND_BITS + 1, ROUND_BITS):
        width = RANK_BITS - done
        inside = _inside(drawn, state, width + ROUND_BITS).withColumn("bin", F.shiftright("rank", width))
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"))
        each = bins.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bin", "words", "left", "base")
        upto = each.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        reached = upto.withColumn("over", F.col("upto") >= F.col("left"))
        first = reached.groupBy("source").agg(
            F.min(F.when(F.col("over"), F.struct("bin", (F.col("upto") - F.col("words")).alias("base")))).alias("hit"),
            F.max(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"))).alias("last"),
            F.first("left").alias("left"),
        )
        at = F.coalesce("hit", "last")
        state = _small(first.select("source", "left", F.shiftleft(at["bin"], width).alias("low"), at["base"].alias("base")))
    tail = _inside(drawn, state, RANK_BITS - 2 * ROUND_BITS).groupBy("source", "rank").agg(F.sum("size").alias("words"))
    each = tail.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "rank", "words", "left", "base", "low")
    ends = each.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    none = state.select("source", (F.col("low") - 1).alias("rank"), F.col("base").alias("upto"), "left")
    under = ends.filter("upto <= left").select("source", "rank", "upto", "left").unionByName(none).groupBy("source").agg(F.max(F.struct("rank", "upto", "left")).alias("x"))
    cuts = _small(under.select("source", F.col("x.rank").alias("cut"), (F.col("x.left") - F.col("x.upto")).alias("gap")))
    later = drawn.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("rank") > F.col("cut"))).select("d.source", "rank", F.abs(F.col("gap") - F.col("size")).alias("off"), "gap")
    near = later.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("rank", "off"))).filter(F.col("turn") <= NEXT)
    fits = near.filter("off < gap").groupBy("source").agg(F.min(F.struct("off", "rank")).alias("best"))
    return cuts.alias("c").join(fits.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")), "left").select("c.source", "cut", F.col("best.rank").alias("extra"))


def _inside(drawn: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """Drawn rows within the bin of 2 ^ bits ranks that their source's state points at."""
    return drawn.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.lit(1 << bits))).select("d.source", "size", "rank")


def with_copies(rows: DataFrame, mix: Mix, u_col: str, source_col: str, size_col: str, prefix: str = "") -> DataFrame:
    """rows with prefix + source_size, target and copies."""
    a = rows.withColumn("__class", _size_class(size_col))
    p = mix.classes.select(F.col("source").alias("__p_source"), F.col("class").alias("__p_class"), "certain", "pi", F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    p = F.broadcast(p) if mix.classes.count() <= SMALL_ROWS else p
    c = mix.cuts.select(F.col("source").alias("__c_source"), F.col("cut").alias("__cut"), F.col("extra").alias("__extra"))
    c = F.broadcast(c) if mix.cuts.count() <= SMALL_ROWS else c
    renamed = p.withColumnsRenamed({"certain": "__certain", "pi": "__pi"})
    joined = a.join(renamed, F.col(source_col).eqNullSafe(F.col("__p_source")) & (F.col("__class") == F.col("__p_class")), "left").join(c, F.col(source_col).eqNullSafe(F.col("__c_source")), "left")
    rank = _rank(u_col, "__pi")
    copies = F.col("__certain") + F.when((rank <= F.col("__cut")) | (rank == F.col("__extra")), 1).otherwise(0)
    return joined.withColumns({prefix + "source_size": F.col("__size"), prefix + "target": F.col("__target"), prefix + "copies": copies}).select(*rows.columns, prefix + "source_size", prefix + "target", prefix + "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row.

    Null texts have size 0 and, like all documents without words, no copies; null sources are a source. Rows that share an id
    or are equal altogether are drawn each by itself. An empty table gives no rows. Reruns agree, as ranks come from the rows'
    content.
    """
    drawn = with_chance(docs.select(id_col, F.col(source_col).alias("__source"), F.col(text_col).alias("__text")), id_col, "__source", "__text")
    sizes = checkpoint(drawn.select(id_col, "__source", word_count(F.col("__text")).alias("size"), "__u"))
    plan = plan_mix(sizes, "__u", "__source", "size")
    return with_copies(sizes, plan, "__u", "__source", "size").select(id_col, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs' rows, each as often as the mix takes it; mix says what nulls, empty texts and repeats give."""
    plain, (row_id, source, text), named = neutral(docs, id_col, source_col, text_col)
    sizes = with_chance(plain, row_id, source, text).withColumn("__words", word_count(F.col(text)))
    plan = plan_mix(checkpoint(sizes.select("__u", source, "__words")), "__u", source, "__words")
    counted = with_copies(sizes, plan, "__u", source, "__words", "__")
    return named(counted.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document of the whole table; mix says what odd rows give."""
    return mix(table(spark, sf_dir, "documents")).drop("copies")


OP5_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
rows AS (
  SELECT doc_id, source, size, length(bin(size + 1)) - 1 AS class,
         md5(digest || ':' || (row_number() OVER (PARTITION BY digest) - 1)) AS drawn FROM docs),
classes AS (SELECT source, class, sum(size)::BIGINT AS words FROM rows GROUP BY ALL),
sources AS (
  SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS turn
  FROM classes GROUP BY source),
dealt AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(turn - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM sources)::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, cap / weight AS full_at,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, weight, cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM dealt),
targets AS (
  SELECT source, source_size, least(cap, coalesce(max(level) FILTER (full_at > level) OVER () * weight, cap)) AS target FROM levels),
pairs AS (
  SELECT c.source, class, words, source_size, target, words * 3.0::DOUBLE AS cap, words * (64.0::DOUBLE - class) AS weight
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
ratios AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 0 END AS full_at FROM pairs),
pair_levels AS (
  SELECT *, sum(weight) OVER (PARTITION BY source ORDER BY full_at, weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         coalesce(sum(cap) OVER (PARTITION BY source ORDER BY full_at, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ratios),
tops AS (
  SELECT *, max(CASE WHEN rest > 0 THEN (target - before) / rest END) FILTER (rest > 0 AND full_at > (target - before) / rest)
            OVER (PARTITION BY source) AS top FROM pair_levels),
shares AS (
  SELECT *, CASE WHEN words > 0 THEN coalesce(least(cap, top * weight), cap) / words ELSE 0 END AS copies FROM tops),
planned AS (
  SELECT source, class, words, source_size, target, floor(copies + 1e-9::DOUBLE)::INT AS certain,
         CASE WHEN copies - floor(copies + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN copies - floor(copies + 1e-9::DOUBLE) ELSE 0 END AS pi
  FROM shares),
goal AS (SELECT source, max(target) - sum(certain * words)::DOUBLE AS goal FROM planned GROUP BY source),
ranked AS (
  SELECT r.*, p.source_size, p.target, certain, pi, goal,
         ((('0x' || substr(drawn, 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM rows r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source AND r.class = p.class
  JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
odds AS (SELECT *, CASE WHEN pi > 0 THEN u / (1.0::DOUBLE - u) * (1.0::DOUBLE - pi) / pi END AS q FROM ranked),
placed AS (SELECT *, least(floor(q / (1.0::DOUBLE + q) * 1099511627776.0::DOUBLE), 1099511627775) AS place FROM odds),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed WHERE pi > 0),
cuts AS (
  SELECT source, max({place: place, upto: upto}).place AS cut, max(goal) - max({place: place, upto: upto}).upto AS gap FROM (
    SELECT source, place, upto, goal FROM running WHERE upto <= goal UNION ALL
    SELECT source, -1, 0, goal FROM goal) GROUP BY source),
extras AS (
  SELECT source, min({off: off, place: place}).place AS extra FROM (
    SELECT p.source, place, abs(gap - size) AS off, gap, row_number() OVER (PARTITION BY p.source ORDER BY place, abs(gap - size)) AS turn
    FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
    WHERE pi > 0 AND place > cut) WHERE turn <= 16 AND off < gap GROUP BY source)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN pi > 0 AND (place <= cut OR place = extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p LEFT JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source
LEFT JOIN extras e ON p.source IS NOT DISTINCT FROM e.source
"""
