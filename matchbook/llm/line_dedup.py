"""Fuzzy line dedup by MinHash, with DataFrame functions alone.

1. Windows of WINDOW bytes behind two bytes of certain kinds are a sample of a line that does not
   depend on where they stand. Of a line with many, the SKETCH least of their hashes are its
   signature; a line with few, or few for its length, becomes its sorted set of hashed character
   shingles, of which the MINIMA least are its signature (a line shorter than a shingle is one
   shingle). Lines in between have both.
2. Hashes that follow each other are a band: two of windows, ROWS of shingles. Those of windows also hold
   a step of the line's extent, so that lines of very different lengths do not meet over a common passage. Two
   signatures of shingles of a similarity of 0.8 have at least ROWS equal ones in a row between two
   unequal ones (short ones are closed to a ring for that), and of their bands about BANDS, chosen
   by their first hash, become keys; of windows the first WINDOW_BANDS do. Equal lines are one class from here on.
3. Classes that share a key with another are the only ones that go on, and pairs of them do only with
   ALIKE windows in common, or two bands of shingles (one if a line has few). In buckets of up to SLOT
   classes all pairs meet. Larger ones are dealt into small slots by the low bits of one hash, each slot
   is paired with its first class. Pairs are confirmed by the exact Jaccard similarity of their shingle
   sets, links are joined to components. At last large buckets that still hold several components are cut
   into blocks, and blocks of the classes apart from the bucket's largest component meet blocks of all:
   first in semi joins that leave the classes with a possible partner, then in a join whose condition is
   the exact similarity, so that only links leave it and no bucket is one task's work.
4. Of each component the first line in the corpus stays.

With a similarity of just 0.8 a few links in a hundred are not found, with 0.9 hardly any;
the tests measure it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import small_side, whole_text
from matchbook.operators.graph import connected_components
from matchbook.session import stage_table

SHINGLE, MINIMA, ROWS, BANDS = 5, 64, 4, 14
#: A line with WINDOWS distinct windows has bands of them; one with fewer than BOTH, or less than one in SPARSE bytes, has bands of shingles.
WINDOW, WINDOWS, BOTH, SPARSE, SKETCH, WINDOW_BANDS, ALIKE = 8, 5, 9, 50, 12, 8, 5
#: A class with fewer bands of shingles is compared for one in common, all others for two.
FEW = 6
SLOT, ROUNDS = 4, 2
#: Classes of a bucket that meet as many others in one task at the end; a bucket of a band of shingles with
#: more than REFINE classes, or of windows with 8 times as many apart from its largest component, is split by what its classes have in common besides.
PAIR_BLOCK, REFINE = 256, 32


def raw_lines(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """doc_id, line_no (from 0), raw."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(whole_text(text), "\n")).alias("line_no", "raw"))


def normal(raw: str = "raw") -> Column:
    """Lower case, runs of blanks as one. Most lines have no such run, which plain scans for bytes tell."""
    runs = reduce(or_, (F.contains(F.col(raw), F.lit(x)) for x in ("  ", *"\t\x0b\f\r")))
    low = F.lower(raw)
    return F.trim(F.when(runs, F.regexp_replace(low, r"\s{2,}|[\t\x0B\f\r]", " ")).otherwise(low))


def _shingles(line: str) -> str:
    """SQL of the hashed shingles. The encoded line is bound by a lambda: as a column it would
    be copied for every shingle."""
    return f"transform(array(encode({line}, 'UTF-32')), u -> transform(sequence(1, greatest(length(u) - {4 * SHINGLE - 1}, 1), 4), i -> xxhash64(substring(u, i, {4 * SHINGLE}))))[0]"


def _bands(d: str, m: str, rows: int, bands: int) -> str:
    """SQL of the keys of about `bands` of the m bands in d, which holds sorted distinct hashes, the
    first rows - 1 of them once more at its end."""
    chosen = f"filter(sequence(1, size({d}) - {rows - 1}), i -> (get({d}, i - 1) & 1023) * {m} < {1024 * bands})"
    return f"transform({chosen}, i -> xxhash64(slice({d}, i, {rows})))"


def _windows(line: str) -> Column:
    """Hashes of the windows. Each UTF-8 byte is taken as a character, so that the kinds of bytes, by
    their remainder by three, are there in every script."""
    kind = lambda k: "[" + "".join(f"\\x{x:02x}" for x in range(k, 256, 3)) + "]"
    found = F.regexp_extract_all(F.decode(F.col(line).cast("binary"), "ISO-8859-1"), F.lit(f"(?s){kind(1)}{kind(2)}(?=({'.' * WINDOW}))"), 1)
    return F.transform(found, lambda w: F.hash(w))


#: SQL of band i of the least windows w; of how many there are; and of all. A band holds two hashes and a step of
#: the line's extent (the log2 of its length, less what repeats in it). Each band has steps of its own, a
#: factor of two wide, so that like lines, whose extents hardly differ, are parted in few of them.
WINDOW_BAND = "xxhash64(get(w, i), get(w, i + 1), cast(floor(extent + (get(w, i + 1) & 1023) / 1024) AS int))"
N_WINDOW_BANDS = f"greatest(least(size(w) - 1, {WINDOW_BANDS}), 0)"
ALL_WINDOW_BANDS = f"CASE WHEN size(w) < 2 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, {N_WINDOW_BANDS} - 1), i -> {WINDOW_BAND}) END"


def _signed(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, s1, s2 (two hashes of the line, its class), n (its windows), extent, w (the least windows, if
    it has many), b (its bands of shingles, if it has few windows), keys (of its bands)."""
    head = 3 * MINIMA // 2  # nearly always holds MINIMA distinct hashes
    none = "cast(array() AS array<bigint>)"
    own = ["doc_id", "line_no", "s1", "s2"]
    rows = lines.select("doc_id", "line_no", F.xxhash64("line").alias("s1"), F.xxhash64(F.lit(1), "line").alias("s2"), "line", _windows("line").alias("w"))
    rows = rows.withColumns({"w": F.sort_array(F.array_distinct("w")), "all": F.size("w")}).withColumn("n", F.size("w"))
    rows = rows.withColumn("extent", F.expr("cast(log2(length(line) * greatest(n, 1) / greatest(all, 1)) AS float)"))
    few = f"n < {BOTH} OR n * {SPARSE} < octet_length(line)"
    rows = rows.withColumn("h", F.expr(f"CASE WHEN {few} THEN sort_array({_shingles('line')}) ELSE {none} END")).drop("line")
    rows = rows.withColumn("d", F.array_distinct(F.slice("h", 1, head)))
    rows = rows.withColumn("d", F.expr(f"CASE WHEN size(d) <= {MINIMA} AND size(h) > {head} THEN array_distinct(h) ELSE d END")).drop("h")
    rows = rows.withColumn("m", F.least(F.size("d"), F.lit(MINIMA)))
    rows = rows.withColumn("d", F.expr(f"CASE WHEN size(d) > {MINIMA} THEN slice(d, 1, {MINIMA}) WHEN m >= {ROWS} THEN concat(d, slice(d, 1, {ROWS - 1})) ELSE d END"))
    bands = f"CASE WHEN m = 0 THEN {none} WHEN m < {ROWS} THEN array(xxhash64(d)) ELSE {_bands('d', 'm', ROWS, BANDS)} END"
    signs = rows.select(*own, "n", "extent", F.expr(f"CASE WHEN n >= {WINDOWS} THEN slice(w, 1, {SKETCH}) ELSE cast(array() AS array<int>) END").alias("w"), F.expr(bands).alias("b"))
    return signs.withColumn("keys", F.expr(f"concat({ALL_WINDOW_BANDS}, b)"))


def _similar(p: str, q: str, percent: int) -> str:
    """SQL: whether two shingle sets have a similarity of percent/100; sizes are looked at first."""
    return f"(100 * least(size({p}), size({q})) >= {percent} * greatest(size({p}), size({q})) AND {100 + percent} * size(array_intersect({p}, {q})) >= {percent} * (size({p}) + size({q})))"


def _bits(x: str) -> str:
    """SQL of a set of up to 256 bits, as four numbers, in which each element of x sets one."""
    return f"transform(sequence(0, 3), k -> aggregate(filter({x}, v -> (shiftright(v, 6) & 3) = k), 0L, (s, v) -> s | shiftleft(1L, cast(v & 63 AS int))))"


def _alike() -> str:
    """SQL: whether the classes p and q have enough windows or bands in common to be compared, and of the
    windows no numbers that differ by far more than a fifth. Bits are looked at first; of ALIKE windows in
    common nearly always ALIKE - 1 have bits of their own. The lambda keeps Spark from writing the whole
    condition into a join's one large method, which the JVM would not compile."""
    needed = f"CASE WHEN least(size(p.b), size(q.b)) < {FEW} THEN 1 ELSE 2 END"
    bits = " + ".join(f"bit_count(get(p.bits, {k}) & get(q.bits, {k}))" for k in range(4))
    least = f"{SKETCH} * size(array_intersect(p.w, q.w)) >= {ALIKE} * least(size(p.w), size(q.w))"
    windows = f"size(p.w) > 0 AND size(q.w) > 0 AND 5 * abs(p.n - q.n) <= greatest(p.n, q.n) + 7 * sqrt(greatest(p.n, q.n)) AND {SKETCH} * ({bits}) >= {ALIKE - 1} * least(size(p.w), size(q.w)) AND {least}"
    return f"({windows} OR size(p.b) > 0 AND size(q.b) > 0 AND exists(array(array_intersect(p.b, q.b)), x -> size(x) >= {needed}))"


def _parted(placed: DataFrame) -> DataFrame:
    """The rows (key, id, component) of buckets that hold several components, with n (classes of the bucket), apart
    (those not of its largest component) and main (whether the row is of that one)."""
    of = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    buckets = of.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    buckets = buckets.select("key", "n", (F.col("n") - F.col("most.m")).alias("apart"), F.col("most.component").alias("largest"))
    return placed.select("key", "id", "component").join(buckets, "key").withColumn("main", F.expr("component = largest")).drop("largest")


def _refined(placed: DataFrame, signs: DataFrame) -> DataFrame:
    """The rows of _parted, with large buckets split. Two classes need more in common than the key of a bucket, so
    each of a large bucket gets a key for every other window or band that it has; a bucket of shingles
    in which a class has few bands stays as it is, and so does one of windows most of which are of one component."""
    of_shingles = F.expr("array_contains(b, key)")
    placed = stage_table(_parted(placed), "line-parted")
    rows = placed.join(signs.select("id", "extent", "w", "b"), "id").withColumn("band", of_shingles)
    fewest = F.min(F.when(F.col("band"), F.size("b")).otherwise(FEW)).alias("fewest")
    large = placed.where(f"n > {REFINE}").select("key", "id", "apart").join(signs.select("id", "b"), "id").withColumn("band", of_shingles).groupBy("key").agg(fewest, F.max("band").alias("band"), F.first("apart").alias("apart")).where(f"fewest >= {FEW} AND (band OR apart > {8 * REFINE})").select("key")
    large = stage_table(large, "line-large")
    side = small_side(large, large.count())
    others = f"CASE WHEN band THEN transform(array_remove(b, key), o -> xxhash64(least(key, o), greatest(key, o))) ELSE transform(array_except(w, slice(w, cast(array_position({ALL_WINDOW_BANDS}, key) AS int), 2)), o -> xxhash64(key, o)) END"
    split = rows.join(side, "key").select("id", "component", F.explode(F.expr(others)).alias("key")).distinct()
    return placed.join(side, "key", "left_anti").unionByName(_parted(split))


def _open(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """classes (id, s1, s2, doc_id, line_no: its first place) that share a key with another class, nodes (id,
    doc_id, line_no, windows and bands), and open rows (key, id, n: classes that have the key)."""
    # outer: the filter on the array that a plain explode brings would compute it several times
    banded = signed.where("size(w) + size(b) > 0").withColumn("i", F.explode_outer(F.expr(f"sequence(0, {N_WINDOW_BANDS} + size(b) - 1)")))
    banded = banded.select("s1", "s2", "doc_id", "line_no", F.expr(f"CASE WHEN i < {N_WINDOW_BANDS} THEN {WINDOW_BAND} ELSE get(b, i - {N_WINDOW_BANDS}) END").alias("key"))
    shared = stage_table(banded.groupBy("key").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("key"), "line-shared")
    found = banded.join(small_side(shared, shared.count()), "key").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.collect_set("key").alias("keys"))
    # the numbers are fixed once the table is written
    classes = stage_table(found.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "at.*", "keys"), "line-classes")
    signs = signed.select("doc_id", "line_no", "n", "extent", "w", "b").join(small_side(classes.select("id", "doc_id", "line_no"), classes.count()), ["doc_id", "line_no"])
    nodes = stage_table(signs.dropDuplicates(["id"]).withColumn("bits", F.expr(_bits("w"))), "line-nodes")
    rows = classes.select("id", F.explode("keys").alias("key"))
    opened = stage_table(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "id", "n"), "line-open")
    return classes.select("id", "s1", "s2", "doc_id", "line_no"), nodes, opened


def _linked(docs: DataFrame, nodes: DataFrame, opened: DataFrame, percent: int, text: str, id_col: str) -> DataFrame | None:
    """(node, component) of the classes with a link."""
    if opened.isEmpty():
        return None
    signs = nodes.select("id", "n", "extent", "w", "b", "bits")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, line) of the classes."""
        needed = stage_table(nodes.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "line_no"), "line-needed")
        n = needed.count()
        whole = docs.select(F.col(id_col).cast("long").alias(id_col), text)
        there = whole.join(small_side(needed.select(F.col("doc_id").alias(id_col)), n), id_col, "left_semi")
        found = raw_lines(there, text, id_col).join(small_side(needed, n), ["doc_id", "line_no"])
        return stage_table(found.select("id", normal().alias("line")).distinct(), "line-texts")

    links, component, tried = None, None, None
    for turn in range(ROUNDS + 1):
        placed = opened.withColumn("component", F.col("id"))
        if turn:  # the classes of small buckets have all met
            opened = opened.where(f"n > {SLOT}")
            placed = opened.join(component.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
            still = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
            placed = stage_table(placed.join(still, "key"), "line-open")
        if placed.isEmpty():
            break
        if turn < ROUNDS:
            dealt = placed.withColumn("slot", F.xxhash64("id", F.lit(turn)).bitwiseAND(F.expr(f"shiftleft(1L, cast(floor(log2(greatest(n / {SLOT}, 1))) AS int)) - 1")))
            large = dealt.where(f"n > {SLOT}")
            head = large.groupBy("key", "slot").agg(F.min(F.struct("id", "component")).alias("c"))
            pairs = large.join(head, ["key", "slot"]).where("component <> c.component").select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b"))
            if not turn:
                small = placed.where(f"n <= {SLOT}").select("key", "id")
                pairs = pairs.union(small.toDF("key", "a").join(small.toDF("key", "b"), "key").where("a < b").select("a", "b"))
            pairs = pairs.distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            both = pairs.toDF("x", "y").join(signs.alias("p"), F.col("x") == F.col("p.id")).join(signs.alias("q"), F.col("y") == F.col("q.id"))
            pairs = stage_table(both.where(F.expr(_alike())).select(F.col("x").alias("a"), F.col("y").alias("b")), "line-pairs")
            tried = pairs if tried is None else tried.union(pairs)
            texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
            both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
            sets = both.select("a", "b", F.array_distinct(F.expr(_shingles("x"))).alias("p"), F.array_distinct(F.expr(_shingles("y"))).alias("q"))
            # a staged filter: pushed below, it would build the sets again for every use
            new = sets.withColumn("like", F.expr(_similar("p", "q", percent))).select("a", "b", F.explode(F.array("like")).alias("like")).where("like").select("a", "b")
        else:
            placed = stage_table(_refined(placed, signs), "line-refined")
            shared = placed.groupBy("id").agg(F.collect_set("key").alias("keys"))
            # two classes of different components are never both of the bucket's largest, so only those
            # apart from it (p) are held against all (q): a group of near copies does not meet itself again
            blocks = placed.withColumns({"over": F.ceil(F.col("apart") / PAIR_BLOCK), "down": F.ceil(F.col("n") / PAIR_BLOCK)})
            met = blocks.drop("n", "apart").join(signs.join(shared, "id"), "id")
            held = ["key", "i", "j", "id", "component", "main", "n", "w", "b", "bits", "keys"]
            one = met.where("NOT main").withColumns({"i": F.expr("pmod(xxhash64(id), over)"), "j": F.explode(F.expr("sequence(0L, down - 1)"))}).select(*held)
            all_ = met.withColumns({"j": F.expr("pmod(xxhash64(id), down)"), "i": F.explode(F.expr("sequence(0L, over - 1)"))}).select(*held)
            one, all_ = stage_table(one, "line-apart"), stage_table(all_, "line-all")
            place = ["key", "i", "j"]
            same = reduce(and_, (F.col(f"p.{c}") == F.col(f"q.{c}") for c in place))
            # a pair counts once in the first bucket that it shares
            meets = f"p.component <> q.component AND (q.main OR p.id < q.id) AND {_alike()} AND array_min(array_intersect(p.keys, q.keys)) = p.key"
            # first which classes have a partner at all (each comes back once a meeting), then with sets
            one = stage_table(one.alias("p").join(all_.alias("q"), same & F.expr(meets), "left_semi"), "line-likely")
            all_ = stage_table(all_.alias("q").join(one.alias("p"), same & F.expr(meets), "left_semi"), "line-likely")
            texts = texts_of(one.select("id").union(all_.select("id")))
            # lines are dealt out and become sets where they meet: sets are eight times as large
            full = lambda side: side.join(texts, "id").repartition(*place).withColumn("h", F.array_distinct(F.expr(_shingles("line")))).drop("line")
            new = full(one).alias("p").join(full(all_).alias("q"), same & F.expr(meets + " AND " + _similar("p.h", "q.h", percent))).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))
        new = stage_table(new, "line-links")
        links = new if links is None else links.union(new)
        component = connected_components(links)
    return component


def _led(docs: DataFrame, percent: int, text: str, id_col: str, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """The signed lines, and (s1, s2, lead: doc_id, line_no) of the classes with several lines or with links."""
    # a filter on the normal line would be a second computation of it
    rows = raw_lines(docs, text, id_col).where(r"doc_id IS NOT NULL AND raw RLIKE '\\S'")
    lines = rows.select("doc_id", "line_no", normal().alias("line"))
    signed = stage_table(_signed(lines.where(F.length("line") >= least_chars) if least_chars > 1 else lines).drop("keys"), "line-signed")
    classes, nodes, opened = _open(signed)
    component = _linked(docs, nodes, opened, percent, text, id_col)
    leads = signed.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "line_no")).alias("lead"), F.count("*").alias("n")).where("n > 1").select("s1", "s2", "lead")
    if component is not None:
        of = classes.join(component.withColumnRenamed("node", "id"), "id").select("s1", "s2", "component", F.struct("doc_id", "line_no").alias("lead"))
        joined = of.join(of.groupBy("component").agg(F.min("lead").alias("first")), "component").select("s1", "s2", F.col("first").alias("lead"))
        leads = leads.union(joined).groupBy("s1", "s2").agg(F.min("lead").alias("lead"))
    leads = stage_table(leads, "line-leads")
    return signed, small_side(leads, leads.count())


def line_components(docs: DataFrame, percent: int = 80, text: str = "text", id_col: str = "doc_id", least_chars: int = 1) -> DataFrame:
    """doc_id, line_no, first_doc, first_line: every line with the place of the first line
    of its component (least document, then line).

    Lines are linked if the Jaccard similarity of their sets of SHINGLE-character shingles
    is percent/100 or more; bands are made for 80 and more. Lines that are empty, or shorter
    than least_chars characters, take no part (0 and 1 are the same). Null and empty texts
    have one empty line. Rows without an id take no part. Repeated ids must have the same
    text (repeated rows count as one). No rows give none.
    """
    signed, leads = _led(docs, percent, text, id_col, least_chars)
    own = F.struct("doc_id", "line_no")
    found = signed.select("doc_id", "line_no", "s1", "s2").join(leads, ["s1", "s2"], "left").select("doc_id", "line_no", F.coalesce("lead", own).alias("lead"))
    return found.select("doc_id", "line_no", F.col("lead.doc_id").alias("first_doc"), F.col("lead.line_no").alias("first_line"))


def dedup_lines(docs: DataFrame, percent: int = 80, text: str = "text", id_col: str = "doc_id", least_chars: int = 1) -> DataFrame:
    """id, text without the lines that repeat a line before them, n_lines, n_dropped.

    Of each component of like lines the first in the corpus stays. Documents with a null
    id or text, and repeated rows, come back as they are but for the same dropped lines.
    Other columns are left out, whatever their names.
    """
    signed, leads = _led(docs, percent, text, id_col, least_chars)
    found = signed.select("doc_id", "line_no", "s1", "s2").join(leads, ["s1", "s2"])
    dropped = stage_table(found.where("NOT (doc_id = lead.doc_id AND line_no = lead.line_no)").select("doc_id", "line_no"), "line-dropped")
    gone = dropped.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.join(small_side(gone, dropped.count()), "doc_id", "left")
    kept = rows.withColumn("lines", F.split("text", "\n")).withColumn("keep", F.expr("CASE WHEN gone IS NULL THEN lines ELSE filter(lines, (x, i) -> NOT array_contains(gone, i)) END"))
    return kept.select(F.col("doc_id").alias(id_col), F.array_join("keep", "\n").alias(text), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("keep")).cast("long").alias("n_dropped"))
