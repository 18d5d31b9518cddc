"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Equal lines form a class (128-bit hash), aggregated before anything is shuffled by line. Classes whose
texts differ by at most ``MAX_EDITS`` edit are linked: cut into ``MAX_EDITS + 1`` = 2 segments, two
such lines share one segment at the same place from the start or the end, so every line is indexed by
its segments for its own length and probes those of lines one shorter (length-aware substring keys).
Members of a key are compared in bounded arrays by finer segments, and the pairs left are verified by a
banded bit-parallel automaton. A key with more than ``HOT`` members is cut finer, level by level
(``SEGMENTS``), so that a line with very many variants is never one task's group; once segments are single
letters, the members of a key that have its own length are within one edit by construction, and those that
have a letter more are compared with them by the line with each letter left out.

A line goes if an equal line stands earlier (by doc_id, then place), or if its class is linked to a
class that began earlier. Lines of white space alone stay; lines under ``MIN_CHARS`` code points without
outer white space go as equal lines only, since one edit makes another word of them.

A line that stands very often is counted where it is read, and where its places meet its class the places
are dealt out by that count.

Defined cases: null text has no lines and stays null; an empty text stays empty; ``doc_id`` may have any
type with an order, null sorts last; rows with the same doc_id have the same places, so repeated rows are
treated alike; lines of any length are compared whole; the empty table gives no rows; extra columns are
kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.llm._frames import meet, plain, written

MAX_EDITS, MIN_CHARS, HOT = 1, 20, 256
SEGMENTS = (2, 8, 64, 512, 4096, 1 << 15, 1 << 18, 1 << 21, 1 << 24, 1 << 27, 1 << 30)
FINE = 8
#: Ids up to which the candidates' texts are found with a broadcast; beyond, with a shuffle.
BROADCAST_IDS = 1_000_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, _h, pos, line``: the lines that take part; ``_h`` tells texts of one id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(_letters() > 0)


def _letters() -> Column:
    return F.length(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _cut(i: Column, length: Column, k: Column) -> Column:
    """Where segment i of k begins in a line of ``length`` letters."""
    return F.floor(i.cast("long") * length / k).cast("int")


def _keys(line: Column, length: Column, k: int) -> Column:
    """Keys of the line, read as one of ``length`` letters, with one of k segments left out each.

    A line of fewer than k letters has a segment for each letter.
    """
    used = F.greatest(F.lit(1), F.least(F.lit(k), length))
    return F.transform(
        F.sequence(F.lit(0), used - 1),
        lambda i: F.xxhash64(used, length, i, F.left(line, _cut(i, length, used)), F.right(line, length - _cut(i + 1, length, used))),
    )


def _keyed(line: Column, k: int) -> Column:
    """``key, own`` of a line: for its own length, and for lines one letter shorter."""
    n = F.length(line)
    own = F.transform(_keys(line, n, k), lambda x: F.struct(x.alias("key"), F.lit(True).alias("own")))
    less = F.transform(_keys(line, n - 1, k), lambda x: F.struct(x.alias("key"), F.lit(False).alias("own")))
    return F.concat(own, less)


def _halves(line: Column) -> list[Column]:
    """The four keys of ``_keyed`` for two segments, as plain columns that Spark compiles."""
    n, cut, less = F.length(line), F.expr("length(line) div 2").cast("int"), F.expr("(length(line) - 1) div 2").cast("int")
    tail = lambda at: F.substring(line, at + 1, n)
    key = lambda length, i, left, right: F.xxhash64(F.lit(2), length, F.lit(i), left, right)
    return [
        key(n, 0, F.lit(""), tail(cut)).alias("k0"), key(n, 1, F.left(line, cut), F.lit("")).alias("k1"),
        key(n - 1, 0, F.lit(""), tail(less + 1)).alias("k2"), key(n - 1, 1, F.left(line, less), F.lit("")).alias("k3"),
    ]


def _place(rows: DataFrame) -> Column:
    """doc_id and place of a line as one sortable value, null ids last; a number where ids are integers."""
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos")
    wide = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(10,0)")
    return F.coalesce(wide.cast("decimal(38,0)"), F.lit(Decimal(10**37)) + F.col("pos"))


def classes(docs: DataFrame) -> DataFrame:
    """``h1, h2, n, first`` and the keys ``k0`` to ``k3``: every distinct line and its first place.

    Short lines have no keys. With integer ids all values are of fixed width, so that Spark aggregates
    them by hash, on both sides of the shuffle.
    """
    rows = _lines(docs)
    rows = rows.select(*_hashes(F.col("line")), _place(rows).alias("place"), *[F.when(_letters() >= MIN_CHARS, k).alias(f"k{i}") for i, k in enumerate(_halves(F.col("line")))])
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])


def _split_hot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has partners and few members, and those whose key has too many."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"), F.count_if("own").alias("_own")).where("_n > 1 AND _own > 0").select("key", "_n")
    sizes = written(sizes, "keys")
    few = rows.join(sizes.where(F.col("_n") <= HOT).select("key"), "key")
    return few, rows.join(sizes.where(F.col("_n") > HOT).select("key"), "key")


def _texts(docs: DataFrame, ids: DataFrame, held: DataFrame) -> DataFrame:
    """``h1, h2, line, first`` of the classes with these ``h1``."""
    ids = written(ids.select("h1").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    found = _lines(docs).select(*_hashes(F.col("line")), "line")
    if few:
        found = found.join(F.broadcast(ids), "h1", "left_semi")
    found = found.groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    if not few:  # after the frequent lines were counted down to one
        found = found.join(ids, "h1", "left_semi")
    return written(found.join(held.select("h1", "h2", "first"), ["h1", "h2"]), "texts")


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs ``early, late`` of members (key, own, h1, h2, first, line) that finer segments let stand,
    each with the parts ``a`` and ``b`` outside of which the two lines agree.
    """
    groups = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "h1", "h2", "own", "line"))).alias("m"))

    def differ(x: Column, y: Column) -> Column:
        """Segment of the shorter line outside of which both agree, as start and end; null if none."""
        n = F.least(F.length(x["line"]), F.length(y["line"]))
        k = F.greatest(F.lit(1), F.least(F.lit(FINE), n))
        at = lambda i: F.struct(_cut(i, n, k).alias("lo"), (n - _cut(i + 1, n, k)).alias("tail"))
        fits = lambda s: (F.left(x["line"], s["lo"]) == F.left(y["line"], s["lo"])) & (F.right(x["line"], s["tail"]) == F.right(y["line"], s["tail"]))
        return F.get(F.filter(F.transform(F.sequence(F.lit(0), k - 1), at), fits), F.lit(0))

    def partners(m: Column) -> Column:
        near = lambda x, y: (x["own"] | y["own"]) & (F.abs(F.length(x["line"]) - F.length(y["line"])) <= MAX_EDITS) & ((x["h1"] != y["h1"]) | (x["h2"] != y["h2"]))
        part = lambda x, s: F.substring(x["line"], s["lo"] + 1, F.length(x["line"]) - s["lo"] - s["tail"])
        one = lambda x, y: _let(
            F.when(near(x, y), differ(x, y)),
            lambda s: F.when(
                s.isNotNull(),
                F.struct(F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")).alias("early"), F.struct(y["h1"].alias("h1"), y["h2"].alias("h2")).alias("late"), part(x, s).alias("a"), part(y, s).alias("b")),
            ),
        )
        return F.flatten(F.transform(m, lambda x, i: F.filter(F.transform(F.slice(m, i + 2, HOT), lambda y: one(x, y)), lambda p: p.isNotNull())))

    return groups.select(F.explode(_let(F.col("m"), partners)).alias("p")).select("p.*").dropDuplicates(["early", "late"])


def within(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Whether the edit distance is at most ``edits``: a bit-parallel automaton on the diagonal band.

    Bit d of level e says that e edits suffice to read j letters of ``b`` and j + d - edits of ``a``.
    A letter moves all levels at once; only 2 * edits + 1 diagonals can still end in time.
    """
    mask = (1 << (2 * edits + 1)) - 1
    letters = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1))).otherwise(F.array().cast("array<string>"))
    levels = [1 << edits]
    for _ in range(edits):
        levels.append((levels[-1] | levels[-1] << 1) & mask)
    start = F.array(*[F.lit(x) for x in levels])

    def run(pa: Column, pb: Column) -> Column:
        def step(r: Column, j: Column) -> Column:
            same = F.lit(0)
            for d in range(2 * edits + 1):
                same = same + F.when(F.get(pa, j + (d - edits)) == F.get(pb, j), 1 << d).otherwise(0)

            def after(hit: Column) -> Column:
                done = F.array(F.get(r, F.lit(0)).bitwiseAND(hit))
                for e in range(1, edits + 1):
                    old, below = F.get(r, F.lit(e - 1)), F.get(done, F.lit(e - 1))
                    new = F.get(r, F.lit(e)).bitwiseAND(hit).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(F.lit(mask))
                    done = F.concat(done, F.array(new))
                return done

            return _let(same, after)

        end = lambda r: F.get(r, F.lit(edits))
        reached = F.when(F.size(pb) > 0, F.aggregate(F.sequence(F.lit(0), F.size(pb) - 1), start, step, end)).otherwise(F.lit(levels[-1]))
        return reached.bitwiseAND(F.element_at(F.array(*[F.lit(1 << d) for d in range(2 * edits + 1)]), F.size(pa) - F.size(pb) + edits + 1)) != 0

    near = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(near, _let(letters(a), lambda pa: _let(letters(b), lambda pb: run(pa, pb)))).otherwise(F.lit(False))


def _inserted(rows: DataFrame, most: int) -> DataFrame:
    """``h1, h2`` of the later of every two lines (h1, h2, first, line) of which one is the other, of at
    most ``most`` letters, with a letter put in.
    """
    n, age = F.length("line"), lambda x: F.struct(f"{x}.first", f"{x}.h1", f"{x}.h2")
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*_hashes(F.concat(F.left("line", i - 1), F.right("line", n - i)))))
    longer = rows.where(n <= most + 1).select("h1", "h2", "first", F.explode(F.array_distinct(without)).alias("key"))
    shorter = rows.where(n <= most).select("h1", "h2", "first")
    pairs = longer.alias("x").join(shorter.alias("y"), (F.col("key.h1") == F.col("y.h1")) & (F.col("key.h2") == F.col("y.h2")))
    late = F.when(age("x") > age("y"), F.struct("x.h1", "x.h2")).otherwise(F.struct("y.h1", "y.h2"))
    return pairs.select(late.alias("late")).select("late.h1", "late.h2")


def losers(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``h1, h2`` of the classes that are within ``MAX_EDITS`` of a class that began earlier."""
    keys = F.inline(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i < 2).alias("own")) for i in range(4)]))
    rows = held.select("h1", keys).where("key IS NOT NULL")
    few, hot = _split_hot(rows)
    few, hot = written(few, "few"), written(hot, "hot")
    texts = _texts(docs, few.select("h1").union(hot.select("h1")), held)
    pairs = _pairs(few.join(texts, "h1"))
    found = written(pairs.where(within(F.col("a"), F.col("b"))).select("late.h1", "late.h2"), "late")
    left = texts.join(hot.select("h1").distinct(), "h1", "left_semi")
    for k in SEGMENTS[1:]:
        if hot.isEmpty():
            break
        rows = left.select("h1", "h2", "first", "line", F.explode(_keyed(F.col("line"), k)).alias("k")).select("k.key", "k.own", "h1", "h2", "first", "line")
        few, hot = _split_hot(rows)
        found = found.union(written(_pairs(few).where(within(F.col("a"), F.col("b"))).select("late.h1", "late.h2"), "late"))
        hot = written(hot, "hot")
        # Segments of one letter: all members of a key's own length are within one edit, so the first one stays.
        whole = hot.where(F.col("own") & (F.length("line") <= k))
        first = whole.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("_first"))
        found = found.union(written(whole.join(first, "key").where(F.struct("first", "h1", "h2") != F.col("_first")).select("h1", "h2"), "late"))
        found = found.union(written(_inserted(hot.select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"]), k), "late"))
        hot = hot.where(F.length("line") > k)
        left = written(hot.select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"]), "left")
    return found.distinct()


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, _h, gone``: places of the lines to take out, for each document that has some."""
    held = written(classes(docs), "classes")
    late = losers(docs, held).withColumn("_late", F.lit(True))
    acts = held.select("h1", "h2", "n", "first").join(late, ["h1", "h2"], "left").where("n > 1 OR _late").select("h1", "h2", "n", F.when(F.col("_late").isNull(), F.col("first")).alias("first"))
    acts = written(acts.withColumnRenamed("n", "_n"), "acts")
    lines = _lines(docs).select("doc_id", "_h", "pos", *_hashes(F.col("line")))
    gone = meet(lines, acts, ["h1", "h2"]).where(F.col("first").isNull() | (F.col("first") != _place(lines)))
    return gone.groupBy("doc_id", "_h").agg(F.collect_set("pos").alias("gone"))  # a document's own lines


def deduplicate(docs: DataFrame, counts: bool = False) -> DataFrame:
    """The documents, all columns, with the repeated lines taken out of ``text``; with ``counts`` the
    columns doc_id, text, ``n_lines`` and ``n_removed`` instead.
    """
    gone = written(removed(docs.select("doc_id", "text")), "gone").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "gone")
    named, back = plain(docs)
    hashed = named.withColumn("_h", F.xxhash64("text"))
    joined = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["_id"]) & (hashed["_h"] == gone["_hash"]), "left")
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), kept))
    if counts:
        n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
        return joined.select("doc_id", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return back(joined.withColumn(f"_c{docs.columns.index('text')}", text))
