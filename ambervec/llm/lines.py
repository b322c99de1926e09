"""Operator 10: line deduplication by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_staged, staged

THRESHOLD, LEAST_CHARS = 2, 24  # two edits in 24 characters: a share of 1/12
EXACT_CHARS = 4
# members of a key that are met as rows (the rows that a join makes of each line's key are
# at most as many), open ones that are compared in blocks, lines of a block
CROWD, LARGE, BLOCK = 8, 1024, 128
BROADCAST_KEYS = 1 << 20  # 8 MB of keys
_LAST = (1 << 63) - 1


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(1-based start, length) of segment i of a line: even parts, the last ones longer."""
    base, longer = F.floor(length / parts), F.pmod(length, F.lit(parts))
    short = parts - longer  # this many parts have the base length
    start = 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - short)
    return start.cast("int"), (base + F.when(F.lit(i) > short, 1).otherwise(0)).cast("int")


def segment_keys(line: Column, threshold: int) -> list[Column]:
    """Keys under which a line is found: its length, a segment's number and text."""
    n = F.char_length(line)
    out = []
    for i in range(1, threshold + 2):
        start, size = _segment(n, i, threshold + 1)
        out.append(F.xxhash64(F.lit(i), n, F.substring(line, start, size)))
    return out


_I, _D = 1 << 16, 1 << 8


def probe_keys(line: Column, threshold: int) -> Column:
    """Keys under which a line looks for lines of its own or a smaller length within
    ``threshold`` edits, as structs (key, spec): for each lesser length by d and
    segment i, the substrings whose shift sg the edits left (i - 1) and right of the
    segment allow. spec: i, d and sg + threshold in bytes."""
    n, parts = F.char_length(line), threshold + 1
    out = []
    for less in range(threshold + 1):
        for i in range(1, parts + 1):
            start, size = _segment(n - less, i, parts)
            for shift in range(max(-(i - 1), less - (parts - i)), min(i - 1, less + parts - i) + 1):
                key = F.xxhash64(F.lit(i), n - less, F.substring(line, start + shift, size))
                out.append(F.struct(key.alias("key"), F.lit(i * _I + less * _D + shift + threshold).alias("spec")))
    return F.array(*out)


def within(a: str, b: str, threshold: int) -> Column:
    """Whether two lines of almost equal length are within ``threshold`` edits (see `within_sql`)."""
    return F.expr(within_sql(a, b, threshold))


def within_sql(a: str, b: str, threshold: int) -> str:
    """SQL that says whether two lines are within ``threshold`` edits.

    Banded bit-parallel edit distance: the 2t+1 cells of a column around the
    diagonal are bits of one number, moved down a row with every column. The
    distance is followed along the band's lower edge, then along the last row.
    """
    t, width = threshold, 2 * threshold + 1
    mask = (1 << width) - 1
    equal = " | ".join(f"if(get(p, k - {t} + {i}) <=> x, {1 << i}L, 0L)" for i in range(width))
    d0 = f"((((s.x & s.vp) + s.vp) ^ s.vp) | s.x | s.vn) & {mask}L"
    # one step finds D0, the next one moves the band on; k counts columns
    step = f"""named_struct('k', s.k + 1, 'dist', s.dist + if(s.k < m - {t},
        if((s.d0 & {1 << (width - 1)}L) = 0, 1, 0),
        if(((s.vn | (~(s.d0 | s.vp) & {mask}L)) & shiftleft(1L, greatest(0, m - 1 - s.k + {t}))) <> 0, 1, 0) - if((s.vp & s.d0 & shiftleft(1L, greatest(0, m - 1 - s.k + {t}))) <> 0, 1, 0)),
      'vp', ((s.vp & s.d0) | ~(shiftright(s.d0, 1) | s.vn | (~(s.d0 | s.vp) & {mask}L))) & {mask}L,
      'vn', shiftright(s.d0, 1) & (s.vn | (~(s.d0 | s.vp) & {mask}L)))"""
    # lambdas bind the pieces: p pattern characters, m their number
    return f"""
      exists(transform(array(named_struct('p', filter(split({a}, ''), c -> true), 'q', split({b}, ''))), z ->
        if(abs(size(z.p) - size(z.q)) > {t}, {t} + 1,
          aggregate(
            transform(sequence(0, size(z.q) - 1), k -> {equal.replace("get(p,", "get(z.p,").replace("<=> x", "<=> z.q[k]")}),
            named_struct('k', 0, 'dist', {t}, 'vp', {mask & ~((1 << t) - 1)}L, 'vn', 0L),
            (r, x) -> aggregate(array(0), named_struct('k', r.k, 'dist', r.dist, 'vp', r.vp, 'vn', r.vn),
              (u, o) -> {_bound(step, d0, "size(z.p)")}),
            r -> r.dist))), d -> d <= {t})"""


def _bound(step: str, d0: str, m: str) -> str:
    """The step with D0 written out; r and x come from the enclosing lambda."""
    import re

    out = re.sub(r"\bs\.d0\b", f"({d0})", step)
    out = re.sub(r"\bs\.x\b", "x", out)
    out = re.sub(r"\bm\b", m, out)
    return re.sub(r"\bs\.", "u.", out)


LONG = 1000  # characters from which lines lose what they have in common first


def _common(a: str, b: str) -> str:
    """SQL for the length of the common prefix: powers of two from the largest down, each
    taken if that many more characters agree."""
    n, step = f"least(char_length({a}), char_length({b}))", "shiftleft(1, g.k - i)"
    same = f"u + {step} <= g.n AND substring({a}, u + 1, {step}) = substring({b}, u + 1, {step})"
    limits = f"array(named_struct('n', {n}, 'k', int(log2(greatest({n}, 1)))))"
    return f"element_at(transform({limits}, g -> aggregate(sequence(0, g.k), 0, (u, i) -> if({same}, u + {step}, u))), 1)"


def near_sql(a: str, b: str, threshold: int) -> str:
    """SQL that says whether two lines are within ``threshold`` edits.

    The engine's own thresholded distance turns most candidates down cheaply, `within`
    verifies. The former takes time in the square of the length, so long lines lose
    their common ends first, which leaves the distance as it is; what is then still
    long is verified alone.
    """
    short = f"(levenshtein({a}, {b}, {threshold}) >= 0 AND {within_sql(a, b, threshold)})"
    # the band needs lines of more characters than the threshold
    left = f"""CASE WHEN least(char_length(y.a), char_length(y.b)) <= {threshold} THEN levenshtein(y.a, y.b, {threshold}) >= 0
      WHEN char_length(y.a) <= {LONG} THEN levenshtein(y.a, y.b, {threshold}) >= 0 AND {within_sql("y.a", "y.b", threshold)} ELSE {within_sql("y.a", "y.b", threshold)} END"""
    cut = "transform(transform(array(named_struct('a', {0}, 'b', {1})), v -> named_struct('a', v.a, 'b', v.b, 'p', {2})), v -> named_struct('a', reverse(substring(v.a, v.p + 1)), 'b', reverse(substring(v.b, v.p + 1))))"
    front = cut.format(a, b, _common("v.a", "v.b"))
    both = f"flatten(transform({front}, f -> {cut.format('f.a', 'f.b', _common('v.a', 'v.b'))}))"
    return f"if(char_length({a}) <= {LONG}, {short}, abs(char_length({a}) - char_length({b})) <= {threshold} AND exists({both}, y -> {left}))"


# ------------------------------------------------------------- crowded keys
#
# A key says that two lines agree outside one hole that holds all edits, or outside
# two holes that hold at most one each. Holes are places in the line that owns the
# key (own), of length m; s1, e1 and s2, e2 are their limits (s2 = -1: one hole). A
# line that is longer by d reads the text between two holes shifted by sg. A
# segment is such a key with large holes. Smaller holes make finer keys.

HOLES = ("s1", "e1", "s2", "e2")


def _first_holes(entries: DataFrame) -> DataFrame:
    """The holes of segment keys (threshold 2: columns n, i, d)."""
    m = F.col("n") - F.col("d")
    two, three = (_segment(m, i, 3)[0] - 1 for i in (2, 3))
    i = F.col("i")
    return entries.withColumns({
        "s1": F.when(i == 1, two).otherwise(0), "e1": F.when(i == 1, m).when(i == 2, two).otherwise(three),
        "s2": F.when(i == 2, three).otherwise(-1), "e2": F.when(i == 2, m).otherwise(-1), "sg": F.when(i == 2, F.col("sg")),
    })


def _pieces(s: str, e: str) -> str:
    k = f"greatest(least(4, {e} - {s}), 1)"
    return f"transform(sequence(0, {k} - 1), j -> named_struct('s', int({s} + ({e} - {s}) * j div {k}), 'e', int({s} + ({e} - {s}) * (j + 1) div {k})))"


# one hole: all edits in a piece, or one in each of two; two holes: a piece of each
_FINER = f"""if(s2 < 0,
  flatten(transform(array({_pieces("s1", "e1")}), ps -> concat(
    transform(ps, p -> named_struct('s1', p.s, 'e1', p.e, 's2', -1, 'e2', -1)),
    flatten(transform(ps, p -> transform(filter(ps, q -> q.s >= p.e), q -> named_struct('s1', p.s, 'e1', p.e, 's2', q.s, 'e2', q.e))))))),
  flatten(transform({_pieces("s1", "e1")}, p -> transform({_pieces("s2", "e2")}, q -> named_struct('s1', p.s, 'e1', p.e, 's2', q.s, 'e2', q.e)))))"""

# shifts of the text between two holes, once there is one
_SHIFTS = """CASE WHEN s2 < 0 OR e1 = s2 THEN array(named_struct('own', own, 'sg', CAST(null AS int)))
  WHEN sg IS NOT NULL THEN array(named_struct('own', own, 'sg', sg))
  WHEN d = 0 THEN array(named_struct('own', own, 'sg', 0), named_struct('own', false, 'sg', -1), named_struct('own', false, 'sg', 1))
  WHEN d = 1 THEN array(named_struct('own', false, 'sg', 0), named_struct('own', false, 'sg', 1))
  ELSE array(named_struct('own', false, 'sg', 1)) END"""

_HOLE_KEY = """xxhash64(n - d, s1, e1, s2, e2, substring(line, 1, s1), if(s2 < 0, '', substring(line, e1 + coalesce(sg, 0) + 1, s2 - e1)),
  substring(line, n - (n - d - if(s2 < 0, e1, e2)) + 1, n - d - if(s2 < 0, e1, e2)))"""


def _finer(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries (h, own, d, sg and the holes) under the keys of smaller holes."""
    cut = entries.select("h", "own", "d", "sg", F.explode(F.expr(_FINER)).alias("x")).select("h", "own", "d", "sg", "x.*").distinct()
    cut = cut.withColumn("y", F.explode(F.expr(_SHIFTS))).select("h", "d", *HOLES, "y.*")
    return cut.join(lines, "h").select("h", "first", "own", "d", "sg", *HOLES, F.expr(_HOLE_KEY).alias("key"))


def _later(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(h) of the lines of which an earlier partner (a, b in any order) is within the threshold."""
    both = pairs.join(lines.select(F.col("h").alias("a"), F.col("first").alias("fa"), F.col("line").alias("la")), "a")
    both = both.join(lines.select(F.col("h").alias("b"), F.col("first").alias("fb"), F.col("line").alias("lb")), "b")
    near = both.where(F.expr(near_sql("la", "lb", threshold)))
    return near.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("h")).distinct()


def _in_blocks(entries: DataFrame, lines: DataFrame, threshold: int, block: int) -> DataFrame:
    """(h) of open lines near an earlier member of their key (columns members, opens:
    numbers of the key): blocks of open lines meet blocks of all lines as arrays."""
    near = f"x -> exists(ys, w -> w.first < x.first AND (x.own OR w.own) AND {near_sql('x.line', 'w.line', threshold)})"
    rows = entries.join(lines.select("h", "line"), "h")
    dealt = F.xxhash64("h", F.lit("block"))
    line, blocks = F.collect_list(F.struct("first", "h", "own", "line")), F.ceil(F.col("members") / block)
    ys = rows.groupBy("key", F.pmod(dealt, blocks).alias("block")).agg(line.alias("ys"))
    xs = rows.where("open").groupBy("key", F.pmod(dealt, F.ceil(F.col("opens") / block)).alias("b")).agg(F.first(blocks).alias("blocks"), line.alias("xs"))
    xs = xs.select("key", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return xs.join(ys, ["key", "block"]).select(F.explode(F.expr(f"filter(xs, {near})")).alias("x")).select(F.col("x.h").alias("h")).distinct()


def _in_crowds(entries: DataFrame, gone: DataFrame, lines: DataFrame, threshold: int, crowd: int, large: int, block: int) -> DataFrame:
    """``gone`` and the lines near an earlier line with which they share a crowded key.

    In every round the earliest owner of a key meets all its members. Members that are
    gone by now only serve as earlier lines; the others are open. At most ``crowd``
    open ones meet all earlier members as rows, at most ``large`` in blocks, so the
    work grows with the members. Where more are open, all go on to the keys of
    smaller holes, where lines stay together only if they agree in more of their
    text. Holes of one character end this: what is still crowded then differs in
    two places only and meets in blocks.
    """
    while True:
        lead = entries.where("own").groupBy("key").agg(F.min(F.struct("first", "h")).alias("lead"))
        star = entries.join(lead, "key").where(F.col("h") != F.col("lead.h")).select(F.col("h").alias("a"), F.col("lead.h").alias("b")).distinct()
        gone = staged(gone.unionByName(_later(star, lines, threshold)).distinct(), "gone")
        marked = entries.join(gone.withColumn("open", F.lit(False)), "h", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        size = marked.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if("open").alias("opens")).where("opens > 0")
        holes = F.greatest(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")) if threshold == 2 else F.lit(0)
        how = F.when(F.col("opens") <= crowd, "rows").when((F.col("opens") <= large) | (holes <= 1), "blocks").otherwise("finer")
        marked = staged(marked.join(size, "key").withColumn("how", how), "marked")
        drop_staged(entries.sparkSession, entries)
        few = marked.where("how = 'rows'")
        pairs = few.where("open").select("key", F.col("h").alias("a"), F.col("first").alias("fa"), F.col("own").alias("oa"))
        pairs = pairs.join(few.select("key", F.col("h").alias("b"), F.col("first").alias("fb"), F.col("own").alias("ob")), "key")
        pairs = pairs.where((F.col("oa") | F.col("ob")) & (F.col("fb") < F.col("fa"))).select("a", "b").distinct()
        more = _later(pairs, lines, threshold).unionByName(_in_blocks(marked.where("how = 'blocks'"), lines, threshold, block))
        gone = staged(gone.unionByName(more).distinct(), "gone")
        rest = marked.where("how = 'finer'")
        if rest.isEmpty():
            return gone
        finer = staged(_finer(rest, lines), "entries")
        # a key goes on if it has an owner and another member, and one of them is open
        met = finer.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("owned")).where("owned and lo < hi").select("key")
        met = met.join(finer.join(gone, "h", "left_anti").select("key").distinct(), "key", "left_semi")
        entries = staged(finer.join(met, "key", "left_semi"), "entries")
        drop_staged(entries.sparkSession, finer, marked)


def deduplicated_lines(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int | None = None, exact_chars: int | None = None, crowd: int = CROWD, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """Remove lines that equal, or are within ``threshold`` edits of, a line that
    occurs earlier (by doc_id, then line number).

    Exact repeats go from ``exact_chars`` characters on (4, so that braces and the
    like stay; ``least_chars`` where only that is given). Near repeats go from
    ``least_chars`` characters on (24: in shorter lines two edits often make another
    text; at least threshold + 1). Lines are judged on the input, not on what is
    left. Lines are cut into threshold + 1 segments: two lines within the threshold
    share one segment at a nearby place, so substrings of each line probe an index
    of (length, segment number, segment). Candidates are turned down by Spark's
    thresholded edit distance or verified by `within` (see `near_sql`). Equal lines meet once, as
    their first occurrence, so a line of a third of all documents is no hot key.
    A segment of more than ``crowd`` different lines of one length is not expanded
    into its pairs: see `_in_crowds` (there ``large`` and ``block``). Lines count as equal if lengths and 64-bit
    hashes are.

    Adds n_lines, n_removed and kept_text and keeps all other columns as they are
    (those three are replaced). Null and empty texts: one empty line, never removed.
    A null id counts as larger than all others; rows of equal id and text are one
    document, so repeating a row removes nothing. Empty table: no rows.
    """
    if exact_chars is None:
        exact_chars = EXACT_CHARS if least_chars is None else least_chars
    least_chars = max(threshold + 1, LEAST_CHARS if least_chars is None else least_chars)
    base = docs.drop("n_lines", "n_removed", "kept_text")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__did")
    th = F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th")
    rows = base.select("*", did, th)
    text = rows.select("__did", "__th", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    names = [f"k{i}" for i in range(threshold + 1)]

    seen = text.select("__did", "__th", F.posexplode(lines).alias("no", "line")).where(F.char_length("line") >= exact_chars)
    keys = [F.when(F.char_length("line") >= least_chars, k).alias(c) for c, k in zip(names, segment_keys(F.col("line"), threshold))]
    seen = seen.select("__did", "__th", "no", F.xxhash64("line").alias("h"), F.char_length("line").alias("n"), *keys)
    first = staged(seen.groupBy("h", "n").agg(F.min(F.struct("__did", "__th", "no")).alias("first"), *(F.min(c).alias(c) for c in names)), "first")
    long = first.where(F.col("n") >= least_chars)

    def lines_of(some: DataFrame) -> DataFrame:
        """(h, line) for first occurrences: each document gets the list of its own."""
        lists = some.groupBy(F.col("first.__did").alias("__did"), F.col("first.__th").alias("__th")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "h")).alias("own"))
        cut = text.join(lists.hint("shuffle_hash"), ["__did", "__th"]).select("own", lines.alias("lines"))
        return cut.select("lines", F.explode("own").alias("x")).select(F.col("x.h").alias("h"), F.get("lines", F.col("x.no")).alias("line"))

    # a key is found by its few lines, or as one crowd
    index = long.select(F.col("h").alias("b"), F.explode(F.array(*names)).alias("key"))
    crowds = staged(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowds")
    crowded = crowds.count()
    marks = F.broadcast(crowds) if crowded <= BROADCAST_KEYS else crowds
    some = index.join(marks, "key", "left_anti").unionByName(crowds.select(F.lit(None).cast("long").alias("b"), "key")) if crowded else index
    probes = lines_of(long).select(F.col("h").alias("a"), F.explode(probe_keys(F.col("line"), threshold)).alias("x")).select("a", "x.*")
    met = staged(probes.join(some, "key").where("b is null or a <> b").select("a", "b", F.when(F.col("b").isNull(), F.struct("key", "spec")).alias("e")).distinct(), "met")
    pairs = met.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    wanted = first.join(met.select(F.explode(F.array("a", "b")).alias("h")).where("h is not null").distinct(), "h", "left_semi")
    found = staged(wanted.select("h", "n", "first").join(lines_of(wanted), "h"), "lines")
    gone = staged(_later(pairs, found, threshold), "gone")
    if crowded:
        entries = met.where("b is null").select(F.col("a").alias("h"), "e.key", "e.spec")
        # a line owns its own segments
        entries = entries.select("h", "key", F.expr(f"spec div {_I}").cast("int").alias("i"), F.expr(f"spec div {_D} % {_D}").cast("int").alias("d"), (F.col("spec") % _D - threshold).alias("sg"))
        entries = entries.withColumn("own", (F.col("d") == 0) & (F.col("sg") == 0)).join(found.select("h", "n", "first"), "h")
        entries = _first_holes(entries) if threshold == 2 else entries.withColumns({c: F.lit(0) for c in HOLES})
        gone = _in_crowds(staged(entries.select("h", "first", "own", "d", "sg", *HOLES, "key"), "entries"), gone, found, threshold, crowd, large, block)
    drop_staged(docs.sparkSession, met, found)

    kept = first.join(gone, "h", "left_anti").groupBy(F.col("first.__did").alias("__did"), F.col("first.__th").alias("__th")).agg(F.collect_list("first.no").alias("__stay"))
    out = rows.join(kept.hint("shuffle_hash"), ["__did", "__th"], "left")
    all_lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stay = F.filter(all_lines, lambda x, i: (F.char_length(x) < exact_chars) | F.coalesce(F.array_contains("__stay", i), F.lit(False)))
    out = out.select(*base.columns, F.size(all_lines).cast("long").alias("n_lines"), stay.alias("__left"))
    return out.select(*base.columns, "n_lines", (F.col("n_lines") - F.size("__left")).alias("n_removed"), F.array_join("__left", "\n").alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
