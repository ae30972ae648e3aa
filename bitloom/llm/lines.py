"""Removal of lines that repeat or nearly repeat an earlier line: an exact set-similarity join, in DataFrame operations only.

A line's set holds its distinct lower-case tokens (what spaces separate). Lines match if 100 * |intersection| >= PERCENT *
|union|; a line goes if it matches one that stands earlier, by document id and then by place. Lines without tokens stay.

Lines of equal sets count as one, whose first place is kept; sets too small to match another one are done with that. Tokens
are ordered by rarity, by counts in a table of CELLS cells, and then by hash. The first token that two matching lines share
stands within the first n - ceil(n * PERCENT / 100) + 1 tokens of each (the prefix filter), so lines are posted under those
only. A token that occurs HOT times or more is posted together with each later token of a prefix that is one token longer,
among which is the second token they share; so no list grows without bound with the corpus. Pairs in a posting list must pass
the length filter, the positional filter at the first shared token, and a bound on what their sets do not share: a token
flips one of 64 bits, so the bits of two lines differ in no more places than the lines have tokens alone. The full token sets of the few pairs that are left are compared.

Before that, the lists of the HEADS rarest tokens of each line are joined to their earliest lines alone, which settles large
groups of near copies in linear work; only lines that are not settled so meet the other earlier lines of their lists.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common
from bitloom.llm.common import cells, maybe

PERCENT = 80
#: Tokens of a line whose lists are joined to their earliest lines first.
HEADS = 3
#: Cells of the table of rarities; a token of a cell that counts HOT or more is posted in pairs. Cells that count less than FEW
#: are all alike, so a small corpus sends few of them to the driver.
CELLS, HOT, FEW = 1 << 20, 4096, 16
#: Slices of the tokens that are joined one after the other.
SLICES = 2
#: Cells of the broadcast table that tells which lines may be concerned.
MARKS = 1 << 20


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), " ")


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1).cast("long"))


def _level(n: int) -> int:
    """Twice the binary logarithm of a count."""
    return (n * n).bit_length() - 1 if n else 0


def _constant(values: Iterable[int], kind: str) -> Column:
    """An array as a constant of the plan, of a bounded number of values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _ranks(texts: DataFrame) -> Column:
    """An array with the rarity of each cell: the level of how many tokens of the corpus fall into it."""
    token = F.explode(_tokens(F.replace("text", F.lit("\n"), F.lit(" "))))
    found = texts.select(token.alias("t")).select(_cell(F.xxhash64("t")).cast("int").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    ranks = bytearray(CELLS)
    for batch in found.where(F.col("n") >= FEW).toArrow().to_batches():
        for cell, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ranks[cell] = _level(n)
    return _constant(ranks, "bigint")


def _parity(words: Column) -> Column:
    """A long of which each hash flips one bit."""
    bits = F.array(*(F.lit(1 << k if k < 63 else -1 << 63).cast("long") for k in range(64)))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bits[h.bitwiseAND(F.lit(63).cast("long"))]))


def _sets(texts: DataFrame, percent: int) -> DataFrame:
    """The lines that have tokens: doc_id, pos, h and g (hashes of the set), n, bits, prefix and cool.

    prefix holds the rarest tokens, one more than the prefix filter asks for; the first cool of them are not frequent.
    """
    ranks = _ranks(texts)
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    words = F.array_remove(F.array_distinct(F.transform(_tokens(F.col("line")), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))
    key = lambda h: F.shiftleft(ranks[_cell(h)], 55).bitwiseOR(F.shiftrightunsigned(h, 9))
    keyed = lines.select("doc_id", "pos", words.alias("words"))
    keyed = keyed.select("doc_id", "pos", _parity(F.col("words")).alias("bits"), F.sort_array(F.transform("words", key)).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.ceil(n * percent / 100).cast("int") + 2)
    out = keyed.select("doc_id", "pos", F.xxhash64("keys").alias("h"), F.hash("keys").alias("g"), n.alias("n"), "bits", prefix.alias("prefix"))
    cool = F.size(F.filter("prefix", lambda k: k < F.lit(_level(HOT) << 55).cast("long")))
    return out.select("doc_id", "pos", "h", "g", "n", "bits", F.transform("prefix", lambda k: F.hash(k)).alias("prefix"), cool.alias("cool"))


def matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, pos): the lines to be removed. docs has doc_id and text."""
    if not 60 <= percent <= 100:
        raise ValueError("percent is from 60 to 100")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    every = common.stored(_sets(texts, percent))
    first = every.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("copies"))
    first = common.stored(first.where("copies > 1").select("h", "g", F.col("f.doc_id").alias("d"), F.col("f.pos").alias("p")))
    found = cells(first.select("h", "g"))
    some = maybe(every, found, ["h", "g"]).join(first, ["h", "g"], "left")
    copies = common.stored(some.where("d is not null and (doc_id <> d or pos <> p)").select("doc_id", "pos"))
    columns = ("doc_id", "pos", "n", "bits", "prefix", "cool")
    whole = maybe(every, found, ["h", "g"], "left_anti").select(*columns).unionAll(some.where("d is null or (doc_id = d and pos = p)").select(*columns))
    whole = common.stored(whole.where(F.col("n") * (100 - percent) >= percent), every, first)

    few = whole.select(F.posexplode(F.slice("prefix", 1, HEADS)).alias("k", "token"), "doc_id", "pos", "n", "bits")
    few = few.select("token", "doc_id", "pos", "n", (F.col("n") - F.col("k") - 1 + HEADS).alias("left"), "bits")
    heads = few.groupBy("token").agg(F.min(F.struct("doc_id", "pos", "n", "left", "bits")).alias("h"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("token", *(F.col(f"h.{c}").alias(e) for c, e in _EARLIER.items()))
    stars = _close(_filtered(few.join(heads.hint("merge"), "token"), percent), whole, percent)
    settled = _verified(texts, stars.drop("shared"), percent)
    place = ["doc_id", "pos"]
    found = cells(settled, MARKS)
    rest = maybe(whole, found, place, cells=MARKS).join(settled, place, "left_anti").select(*columns)
    open_ = common.stored(maybe(whole, found, place, "left_anti", MARKS).select(*columns).unionAll(rest))
    parts = []
    for k in range(SLICES):  # one after the other, for less disk
        x, y = (_posted(t, percent).where(F.pmod("token", F.lit(SLICES)) == k) for t in (open_, whole))
        y = y.select("token", *(F.col(c).alias(e) for c, e in _EARLIER.items()))
        parts.append(common.stored(_filtered(x.join(y.hint("merge"), "token"), percent)))
    common.drop(open_)
    pairs = common.stored(_close(reduce(DataFrame.unionAll, parts).distinct(), whole, percent), *parts, whole)
    best = pairs.groupBy("doc_id", "pos").agg(F.max(F.struct("shared", "d", "p")).alias("b")).select("doc_id", "pos", "b.d", "b.p")
    likely = _verified(texts, best, percent)
    others = _verified(texts, pairs.drop("shared").join(likely, ["doc_id", "pos"], "left_anti"), percent)
    return common.stored(copies.unionAll(settled).unionAll(likely).unionAll(others).distinct(), copies, settled, likely, others, pairs)


#: The names of an earlier line's columns beside those of a line.
_EARLIER = {"doc_id": "d", "pos": "p", "n": "m", "left": "more", "bits": "q"}


def _posted(lines: DataFrame, percent: int) -> DataFrame:
    """A row for each key of each line: token, the line, and how many tokens it can share (left) if it shares the key's and
    none before."""
    last = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1  # place of the first shared token at most
    own = ("doc_id", "pos", "n")
    single = lines.select(F.posexplode(F.slice("prefix", 1, F.least("cool", last))).alias("k", "token"), *own, "bits")
    single = single.select("token", *own, (F.col("n") - F.col("k")).alias("left"), "bits")
    hot = lines.where(F.col("cool") < last).select(F.posexplode("prefix").alias("k", "t"), "prefix", "cool", last.alias("last"), *own, "bits")
    hot = hot.where((F.col("k") >= F.col("cool")) & (F.col("k") < F.col("last"))).select("t", "k", F.slice("prefix", F.col("k") + 2, F.size("prefix")).alias("rest"), *own, "bits")
    hot = hot.select("t", "k", F.posexplode("rest").alias("more", "u"), *own, "bits")
    return single.unionAll(hot.select(F.hash("t", "u").alias("token"), *own, (F.col("n") - F.col("k") - F.col("more")).alias("left"), "bits"))


def _need(percent: int) -> Column:
    """Tokens that sets of n and m share at least if they match."""
    return F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))


def _filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line (doc_id, pos, with n tokens, of which it can share left, bits) and an earlier one (d, p, m, more, q) that
    may match."""
    both = F.col("n") + F.col("m")
    earlier = (F.col("d") < F.col("doc_id")) | ((F.col("d") == F.col("doc_id")) & (F.col("p") < F.col("pos")))
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("q"))) <= both - 2 * _need(percent)
    length = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    found = pairs.where(earlier & (F.least("left", "more") * (100 + percent) >= both * percent) & length & near)
    return found.select("doc_id", "pos", "d", "p").distinct()


def _close(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs that may match by their prefixes, with the number of prefix tokens they share: of one of the two lines, all
    shared tokens that its prefix has are in the other's prefix too."""
    pairs = common.stored(pairs)
    ends = pairs.select("doc_id", "pos").unionAll(pairs.select(F.col("d").alias("doc_id"), F.col("p").alias("pos")))
    ends = maybe(whole, cells(ends, MARKS), ["doc_id", "pos"], cells=MARKS)
    x = ends.select("doc_id", "pos", "n", F.col("prefix").alias("s"))
    y = ends.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("n").alias("m"), F.col("prefix").alias("t"))
    shared = F.size(F.array_intersect("s", "t")) + F.size("s") - F.size(F.array_distinct("s"))
    both = pairs.join(x, ["doc_id", "pos"]).join(y, ["d", "p"])
    both = both.select("doc_id", "pos", "d", "p", F.inline(F.array(F.struct(shared.alias("shared"), F.greatest(F.col("n") - F.size("s"), F.col("m") - F.size("t")).alias("rest"), _need(percent).alias("need")))))
    return both.where("shared + rest >= need").select("doc_id", "pos", "d", "p", "shared").distinct()


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, pos) of the lines in pairs whose token sets match the earlier line's."""
    pairs = common.stored(pairs)
    ends = pairs.select("doc_id", "pos").unionAll(pairs.select(F.col("d").alias("doc_id"), F.col("p").alias("pos"))).distinct()
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = common.stored(maybe(lines, cells(ends, MARKS), ["doc_id", "pos"], cells=MARKS).join(ends, ["doc_id", "pos"], "left_semi"))
    both = pairs.join(lines, ["doc_id", "pos"]).join(lines.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("line").alias("other")), ["d", "p"])
    words = lambda c: F.array_remove(F.array_distinct(_tokens(F.col(c))), "")
    # inline keeps each step apart, so that no expression is computed twice
    both = both.select("doc_id", "pos", F.inline(F.array(F.struct(words("line").alias("s"), words("other").alias("t")))))
    both = both.select("doc_id", "pos", F.inline(F.array(F.struct(F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("shared")))))
    both = both.where((F.col("shared") * 100 >= (F.col("n") + F.col("m") - F.col("shared")) * percent))
    return common.stored(both.select("doc_id", "pos").distinct(), pairs, lines)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, removed_col: str | None = None) -> DataFrame:
    """docs without the lines that match an earlier one; all rows and columns stay.

    Documents are ordered by id. Rows of one id share their lines' fate, so a repeated row loses nothing to its twin. A text
    that is null stays null, one that loses all lines becomes empty, and a row with a null id stays as it is. removed_col
    names a new column for the number of lines removed. An empty table gives no rows.
    """
    gone = matches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), percent)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    found = cells(gone.select("doc_id"))
    places = gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    left = maybe(packed, found, ["doc_id"]).join(places.hint("shuffle_hash"), "doc_id", "left").select("row", "gone")
    rest = maybe(packed, found, ["doc_id"], "left_anti").select("row", F.lit(None).cast("array<int>").alias("gone"))
    both = left.unionAll(rest)
    kept = F.filter(F.split(F.col(f"row.`{text_col}`"), "\n"), lambda _, k: ~F.array_contains("gone", k))
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    extra = [F.coalesce(F.size("gone"), F.lit(0)).alias(removed_col)] if removed_col else []
    return both.select(*out, *extra)
