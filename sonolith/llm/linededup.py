"""Fuzzy line dedup by MinHash, with DataFrame functions only.

A line's shingles are its runs of `width` characters. One hash deals them into bins; the
smallest of each bin make the line's signature, an empty bin taking the next one's. Bands of
`ROWS` bins are the first keys. Lines that share a key are candidates if their signatures
agree in about half of the bins, candidates are verified by the Jaccard similarity of all their
shingles, links are closed by a distributed union-find, and one line of each component stays.

Up to `FEW` lines under a key are compared with each other. A larger group's key is made
longer, bin by bin around the signature, and in each group that is still larger every line is
held against two centres, the one with the most and the one with the fewest companions. A group
whose lines are all surely near a centre is settled; others go on to the next length. So rows
stay at a few for each line, whatever a group's size. What this leaves open is then compared in
full: under every key of a large group, lines that are not yet in one component are held against
each other in blocks, so that no candidate of any group is dropped. A first join tells only which
lines have a companion there, a row a line at most; those alone get their parities and are paired.
Families of near copies fill large groups with lines whose signatures agree but which are not
similar; these make no rows, since the parities of their shingles prove how many they do not
share. The rows stay few; the comparisons grow with the square of such lines under one key, but
not with those of the group's largest component.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import components

WIDTH = 12
BINS, ROWS = 32, 4
BANDS = BINS // ROWS
#: Lengths of the longer keys in bins.
LONGER = (6, 9, 13, 18, 24)
#: Groups of so many lines give all their pairs.
FEW = 8
#: Lines of a group that one task holds against as many others.
BLOCK = 2048
#: Columns of the parities, 64 bits each.
PARITY = [f"p{i}" for i in range(16)]
#: How many of a line's hashes reach the aggregation, on average; a longer line's others are too large to be smallest.
SAMPLE = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def occurrences(docs: DataFrame, *, width: int = WIDTH, short: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, pos, h1, h2, line): every line of at least `width` characters; with `short`, every line but empty ones.

    th, a hash of the text, tells rows with equal ids apart; h1 and h2 identify the line.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _held(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), "doc_id", th=F.xxhash64("text"), lines=_lines(F.col("text")))
    rows = rows.select("doc_id", "th", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where("line <> ''" if short else F.length("line") >= width)
    return rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _held(df: DataFrame, *kept: str, **values: Column) -> DataFrame:
    """`kept` and `values` as columns that the optimiser does not compute again where they are used."""
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def _hashed_shingles(line: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the runs of `width` characters, or of a shorter line as a whole.

    In UTF-32 a run starts at four times its number, so that none is searched for. The outer
    function holds that form, which would be copied for each run if it were a column.
    """

    def hashes(wide: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - 4 * width, F.lit(0)) + 1, F.lit(4))
        return F.transform(places, lambda k: F.xxhash64(F.substring(wide, k, F.lit(4 * width))))

    return F.array_distinct(F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), hashes), 1))


def _minima(lines: DataFrame, width: int, sample: int | None) -> DataFrame:
    """(id, n, m0, m1, ...): the number of runs of each line and the smallest hash of each bin, null where it has none.

    With `sample`, only hashes below a bound that leaves about so many of a line's go into the
    minima: a smallest hash above it is left out, never replaced by another.
    """
    wide = lines.select("id", F.encode("line", "UTF-32").alias("wide"))
    last = F.greatest((F.octet_length("wide") / 4).cast("int") - width, F.lit(0))
    runs = wide.select("id", "wide", last.alias("n"))
    bound = F.lit(1 << 32) if sample is None else F.when(F.col("n") < sample, F.lit(1 << 32)).otherwise((F.lit(2.0**32 * sample) / (F.col("n") + 1)).cast("long"))
    runs = runs.select("id", "wide", "n", bound.alias("bound"), F.explode(F.sequence(F.lit(0), "n")).alias("k"))
    hashed = runs.select("id", "n", "k", "bound", F.xxhash64(F.substring("wide", 4 * F.col("k") + 1, F.lit(4 * width))).alias("h"))
    below = F.shiftrightunsigned("h", 32) < F.col("bound")
    # the first run of a line always passes, so that each line has a row, but counts in a bin only below the bound
    dealt = hashed.where(below | (F.col("k") == 0)).select("id", "n", F.when(below, F.col("h").bitwiseAND(BINS - 1).cast("int")).alias("bin"), F.shiftrightunsigned("h", 33).cast("int").alias("h"))
    # FILTER: a row costs each column but its own a comparison; a condition inside min() would rewrite all of them
    return dealt.groupBy("id", "n").agg(*(F.expr(f"min(h) filter (where bin = {i})").alias(f"m{i}") for i in range(BINS)))


def signatures(lines: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """(id, n, m0, m1, ...): one row for each distinct line (id, line), without a shuffle of texts.

    An empty bin takes the next one's hash. Lines of many runs but few different ones, which
    the bound may leave without hashes, are signed again without it.
    """

    def whole(rows: DataFrame) -> DataFrame:
        filled = reduce(add, (F.col(f"m{i}").isNotNull().cast("int") for i in range(BINS)))
        columns = [f"m{i}" for i in range(BINS)]
        rows = rows.select("id", "n", filled.alias("filled"), *columns)
        for far in (1, 2, 4, 8, 16):  # each step doubles how far the next hash may be
            rows = rows.select("id", "n", "filled", *(F.coalesce(columns[i], columns[(i + far) % BINS]).alias(columns[i]) for i in range(BINS)))
        return rows

    some = materialise(whole(_minima(lines, width, SAMPLE)), "signatures")
    poor = (F.col("n") >= SAMPLE) & (F.col("filled") < BINS // 2)
    again = some.where(poor).select("id")
    if not again.isEmpty():
        some = some.where(~poor).unionByName(materialise(whole(_minima(lines.join(_small(again), "id", "left_semi"), width, None)), "signatures"))
    return some.drop("filled")


def _key(start: int) -> Column:
    """Key of the band that starts at a bin; its last bits tell which band it is."""
    return F.xxhash64(F.lit(start), *(F.col(f"m{start + j}") for j in range(ROWS))).bitwiseAND(-BANDS).bitwiseOR(start // ROWS)


def _longer_key(bins: int) -> Column:
    """Key of the lines that share the band in column `band` and the sketches of so many bins from there, around the signature."""
    own = [F.col(f"s{i // 2}") if i % 2 == 0 else F.shiftrightunsigned(f"s{i // 2}", 32) for i in range(BANDS)]
    around = F.array(*(x.bitwiseAND((1 << 32) - 1) for x in own + own))
    from_band = [F.get(around, (F.col("band").bitwiseAND(BANDS - 1) + i).cast("int")) for i in range(-(-bins // ROWS))]
    if bins % ROWS:
        from_band[-1] = from_band[-1].bitwiseAND((1 << 8 * (bins % ROWS)) - 1)
    return F.xxhash64("band", *from_band)


def _sketch() -> list[Column]:
    """A byte of each bin, as longs s0, s1, ..."""
    byte = lambda i, j: F.shiftleft(F.col(f"m{8 * i + j}").bitwiseAND(255).cast("long"), 8 * j)
    return [reduce(lambda x, y: x.bitwiseOR(y), (byte(i, j) for j in range(8))).alias(f"s{i}") for i in range(BINS // 8)]


SKETCH = [f"s{i}" for i in range(BINS // 8)]


def _agreeing(left: str, right: str) -> Column:
    """In how many bins the sketches of two column prefixes agree.

    Eight bytes are told at once: the sum of a byte's halves and 31 reaches 32 unless the byte is zero.
    """
    every = lambda byte: F.lit(int.from_bytes(bytes([byte] * 8)))

    def apart(s: str) -> Column:
        x = F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))
        halves = x.bitwiseAND(every(15)) + F.shiftrightunsigned(x, 4).bitwiseAND(every(15))
        return F.bit_count((halves + every(31)).bitwiseAND(every(32)))

    return BINS - reduce(add, map(apart, SKETCH))


def _alike(bins: Column, n: Column) -> Column:
    """Whether lines that agree in so many bins may reach 0.8: 25.6 of 32 do on average, and short lines scatter more."""
    return bins >= F.when(n < SAMPLE, F.lit(18)).otherwise(F.lit(19))


def _small(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """Marked for broadcast if it has at most `rows` rows of a few longs; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _verified(pairs: DataFrame, lines: DataFrame, parities: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those pairs (a, b) of line ids whose lines reach the similarity over all their shingles."""
    side = lambda df, x: df.select(*(F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in df.columns))
    maybe = pairs.join(side(parities, "a"), "a", "left").join(side(parities, "b"), "b", "left").where(_within(threshold)).select("a", "b")
    both = maybe.join(side(lines, "a"), "a").join(side(lines, "b"), "b")
    both = _held(both, "a", "b", x=_hashed_shingles(F.col("a_line"), width), y=_hashed_shingles(F.col("b_line"), width))
    both = _held(both, "a", "b", common=F.size(F.array_intersect("x", "y")), either=F.size("x") + F.size("y"))
    return materialise(both.where(F.col("common") >= threshold * (F.col("either") - F.col("common"))).select("a", "b"), "line-links")


def _several(rows: DataFrame) -> DataFrame:
    """Candidates (a, b) among all pairs of each key's lines; rows: (key, id, runs, s0, ...), at most `FEW` of a key."""
    side = lambda x: rows.select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "id", "runs", *SKETCH)))
    match = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")) & _alike(_agreeing("a_", "b_"), F.least("a_runs", "b_runs"))
    return side("a").join(side("b").hint("shuffle_hash"), match).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _starred(rows: DataFrame, longer: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) of each group, and the rows of groups that go on to their next key.

    rows: (key, band, id, runs, pop, s0, ...); the next key has `longer` bins, or there is none.
    Rows of a group go on together unless each of them agrees with a centre in 27 bins of 32 or more.
    """
    who = F.struct("pop", "id", *SKETCH)
    centres = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(who).alias("c"), F.min(who).alias("d")).where("size > 1")
    centres = centres.select("key", "size", *(F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "cd" for y in ("id", *SKETCH)))
    held = rows.select("key", "band", "id", "runs", "pop", *(F.col(s).alias(f"own_{s}") for s in SKETCH)).join(centres, "key")
    held = held.select("key", "size", "band", "id", "runs", "pop", *(F.col(f"own_{s}").alias(s) for s in SKETCH), "c_id", "d_id", _agreeing("own_", "c_").alias("with_c"), _agreeing("own_", "d_").alias("with_d"))
    held = materialise(held, "held")
    many = held.where(f"size > {FEW}")
    near = lambda x: F.when(_alike(F.col(f"with_{x}"), F.col("runs")) & (F.col("id") != F.col(f"{x}_id")), F.struct(F.least("id", f"{x}_id").alias("a"), F.greatest("id", f"{x}_id").alias("b")))
    pairs = many.select(F.inline(F.array_compact(F.array(near("c"), near("d"))))).union(_several(held.where(f"size <= {FEW}")))
    if longer is None:
        return pairs, many.limit(0)
    loose = many.where("greatest(with_c, with_d) < 27").select("key").distinct()
    rest = many.join(loose, "key", "left_semi").select(_longer_key(longer).alias("key"), "band", "id", "runs", "pop", *SKETCH)
    return pairs, materialise(rest, "rest")


def _parities(lines: DataFrame, width: int) -> DataFrame:
    """(id, n, p0, p1, ...): the number of shingles of each line (id, line), and for each remainder of a hash whether an odd number of them has it."""
    each = _held(lines, "id", shingles=_hashed_shingles(F.col("line"), width)).select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(len(PARITY) - 1)
    each = each.select("id", "n", bit.alias("bit"), word.cast("int").alias("word"))
    return each.groupBy("id", "n").agg(*(F.expr(f"coalesce(bit_xor(bit) filter (where word = {i}), 0L)").alias(p) for i, p in enumerate(PARITY)))


def _within(threshold: float) -> Column:
    """False only if the parities of a_ and b_ prove that the lines are not similar; unknown parities prove nothing.

    A bit in which they differ stands for at least one shingle that only one of the lines has.
    """
    apart = reduce(add, (F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY))
    return F.coalesce((1 + threshold) * apart <= (1 - threshold) * (F.col("a_n") + F.col("b_n")) + 1e-6, F.lit(True))


def _across(rows: DataFrame, near: DataFrame, parities: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) under the same key that are in different components so far: all that may be similar, whatever a group's size.

    rows: (key, id, runs, s0, ...); near: (node, component), any other line being one of its own;
    parities: of lines that have candidates. Lines of a group's largest component are held against
    the others alone.
    """
    own = near.groupBy(F.col("node").alias("id")).agg(F.min("component").alias("part"))
    columns = ["key", "id", "runs", *SKETCH]
    # a line's rows and its component meet in a window, which makes no rows of its own
    both = rows.select(*columns, F.lit(None).cast("long").alias("part")).unionByName(own, allowMissingColumns=True)
    rows = both.withColumn("part", F.coalesce(F.max("part").over(Window.partitionBy("id")), "id")).where(F.col("key").isNotNull())
    parted = materialise(rows, "parted")
    parts = parted.groupBy("key", "part").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("key", F.col("most.part").alias("main"), blocks(F.col("size") - F.col("most.n")).alias("few"), blocks(F.col("size")).alias("all"))
    rows = parted.join(_small(materialise(open_, "open")), "key").withColumn("first", F.col("part") == F.col("main"))
    rows = materialise(rows, "opened")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # groups of one block stay as they are; of larger ones each line goes to the blocks that it is held against
    whole, dealt = rows.where(F.col("all") == 1).withColumns({"i": F.lit(0), "j": F.lit(0)}), rows.where(F.col("all") > 1)
    left = whole.unionByName(dealt.withColumn("i", mine("few")).withColumn("j", every("all"))).where(~F.col("first"))
    right = whole.unionByName(dealt.withColumn("j", mine("all")).withColumn("i", every("few")))
    place = ["key", "i", "j"]
    side = lambda df, x: df.select(*(F.col(c).alias(f"{x}_{c}") for c in (*place, "id", "runs", "part", "first", *SKETCH)))
    left, right = side(left, "a"), side(right, "b")
    once = F.col("b_first") | (F.col("a_id") < F.col("b_id"))
    match = (F.col("a_part") != F.col("b_part")) & once & _alike(_agreeing("a_", "b_"), F.least("a_runs", "b_runs"))
    match = reduce(lambda x, y: x & y, (F.col(f"a_{c}") == F.col(f"b_{c}") for c in place)) & match
    # only lines with a companion are paired, and only they get parities
    left = materialise(left.join(right.hint("shuffle_hash"), match, "left_semi"), "met")
    right = materialise(right.join(_small(left).hint("shuffle_hash"), match, "left_semi"), "met")
    def known(df: DataFrame, x: str) -> DataFrame:
        columns = ["n", *PARITY]
        df = df.join(_small(parities, 50_000).select(F.col("id").alias(f"{x}_id"), *(F.col(c).alias(f"{x}_{c}") for c in columns)), f"{x}_id", "left")
        # no parities: so many shingles that nothing is proved
        return df.withColumns({f"{x}_{c}": F.coalesce(f"{x}_{c}", F.lit(1 << 40 if c == "n" else 0).cast("long")) for c in columns})

    discard(parted, rows)
    met = known(left, "a").join(known(right, "b").hint("shuffle_hash"), match & _within(threshold))
    return materialise(met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct(), "across")


def near_lines(lines: DataFrame, *, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """(node, component) of the lines (id, line) that have a near copy. Rows may repeat.

    Texts are not shuffled, but for those of candidates. An empty table gives no rows.
    """
    signed = signatures(lines, width=width)
    keys = signed.select("id", F.explode(F.array(*map(_key, range(0, BINS, ROWS)))).alias("key"))
    shared = keys.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    whole = rows = materialise(shared.join(signed.select("id", F.col("n").alias("runs"), *_sketch()), "id"), "shared")
    discard(signed)
    found = [_several(rows.where(f"size <= {FEW}"))]
    large = rows.where(f"size > {FEW}")
    crowded = not large.isEmpty()
    if crowded:
        # a window: a join would make the rows of all large groups once more
        rows = large.withColumn("pop", F.sum("size").over(Window.partitionBy("id"))).withColumnRenamed("key", "band")
        rows = rows.select(_longer_key(LONGER[0]).alias("key"), "band", "id", "runs", "pop", *SKETCH)
        for longer in (*LONGER[1:], None):
            some, rows = _starred(rows, longer)
            found.append(some)
            if rows.isEmpty():
                break
    pairs = materialise(reduce(DataFrame.union, found).distinct(), "candidates")
    some = _texts(pairs, lines)
    parities = materialise(_parities(some, width), "parities")
    links = _verified(pairs, some, parities, threshold, width)
    discard(some)
    near = components(links)
    if not crowded:
        discard(whole)
        return near
    rest = materialise(_across(large, near, parities, threshold).join(pairs, ["a", "b"], "left_anti"), "candidates")
    discard(whole)
    if rest.isEmpty():
        return near
    # components stand for the links that made them
    more = _verified(rest, _texts(rest, lines), parities, threshold, width)
    return components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line (id, line) that is in a pair (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return materialise(lines.join(_small(materialise(wanted, "candidate-ids")), "id", "left_semi").distinct(), "candidate-lines")


def repeated_lines(docs: DataFrame, *, threshold: float = 0.8, width: int = WIDTH, short: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, drop): positions of lines that go, for each document that has any.

    Equal lines are told by two 64-bit hashes; near copies go by the first of them.
    """
    seen = occurrences(docs, width=width, short=short, id_col=id_col, text_col=text_col)
    near = near_lines(seen.select(F.col("h1").alias("id"), "line"), threshold=threshold, width=width)
    near = _small(materialise(near.distinct(), "near-lines")).withColumnRenamed("node", "h1")
    slim = materialise(seen.drop("line"), "occurrences")
    again = slim.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    again = _small(materialise(again.join(near, "h1", "left_anti"), "repeated"))
    at = ["doc_id", "th", "pos"]
    every = slim.join(near, "h1").select(*at, F.col("component").alias("k1"), F.lit(None).cast("long").alias("k2"))
    every = materialise(every.unionByName(slim.join(again, ["h1", "h2"]).select(*at, F.col("h1").alias("k1"), F.col("h2").alias("k2"))), "copies")
    keep = materialise(every.groupBy("k1", "k2").agg(F.min(F.struct(*at)).alias("keep")), "kept-lines").select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "keep")
    gone = every.join(keep, (F.col("k1") == F.col("j1")) & F.col("k2").eqNullSafe(F.col("j2"))).where(~F.struct(*at).eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, *, threshold: float = 0.8, width: int = WIDTH, short: bool = False, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with one line kept of every class of equal or near-equal lines.

    Lines end at a newline. Empty ones always stay, and so do those of fewer than `width`
    characters unless `short` is set: then each of these is one shingle. Of a class the
    occurrence with the smallest (id, hash of the text, position) stays, so that of equal lines
    in one document the first does; rows with equal id and text count as one. Null texts stay
    null. Other columns are passed on, whatever their names. With `counts`, returns
    (id, text, n_lines, n_removed) instead.
    """
    drop = repeated_lines(docs, threshold=threshold, width=width, short=short, id_col=id_col, text_col=text_col)
    drop = materialise(drop, "dropped")  # a few numbers a document: the small side of the join, which the texts' side isn't sorted for
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # columns of any name
    own = F.col("row")[text_col]
    text = F.coalesce(own, F.lit(""))
    both = rows.join(drop.hint("shuffle_hash"), F.col("row")[id_col].eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("th")), "left")
    # only texts that lose lines are split, once
    both = _held(both, "row", "drop", lines=F.when(F.col("drop").isNotNull(), _lines(own)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    new = F.when(F.col("drop").isNull(), own).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    if counts:
        ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        return both.select(F.col("row")[id_col].alias(id_col), new.alias(text_col), (ends + 1).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))
    return both.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
