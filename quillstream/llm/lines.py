"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines are trimmed and lower-cased. Equal lines are one class, whatever their length. Two classes of LEAST_CHARS
characters or more link when their edit distance is at most EDITS: such a pair shares one of EDITS + 1 segments of the
shorter line at a place that its length allows. Every line writes its own segments, keyed by length, segment number and
content, and probes the substrings at the places that the length-aware windows leave for lines of its own length and of
up to EDITS characters less. Only keys and class numbers are shuffled. Lines that meet are read again; those whose
counts of letters the edits can explain are verified by a banded bit-parallel edit distance over 2 * EDITS + 1 diagonals.

A segment that more than HOT lines own (boilerplate with a number in it) isn't paired as it stands: what its lines hold
beside the segment is parted into segments once more, and so on up to DEPTH times, so a pair is made only where a second
and a third place agree too. A near pair agrees there by the same argument, so none is lost.

Classes joined by links form components; the first line of a component (least doc_id, then line number) stays, the
others are repeats. Equal lines are pre-aggregated before any shuffle, so a line that holds a third of all rows is one
row a task there; in the last join its rows are many, which Spark's skew handling splits.

Defined cases: lines are what line feeds part; blank lines are never repeats; a null text has one blank line; repeated
rows give repeated results; rows that share a doc_id but not the text are read as one document's lines, by line number;
a row without doc_id has no lines here and loses none. Classes are numbered, not hashed; the rows of a class are found by
128 bits of the line's hash. Other columns are ignored, or passed on by :func:`without_repeats`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.components import connected_components
from quillstream.llm.shared import discard, free_name, saved

EDITS = 2
#: Shorter lines have no near repeats, only exact ones.
LEAST_CHARS = 20
#: Lines that may own a segment before it is parted further, and how often that is done.
HOT, DEPTH = 32, 3
#: Letters whose counts are compared before a pair is verified.
LETTERS = "eairtnsoulcdmhgp"
#: Class numbers or keys up to which a broadcast (8 bytes each) picks the rows that hold them; beyond it a shuffled join.
BROADCAST_ROWS = 1_000_000


def normal_lines(text: Column) -> Column:
    """The lines of a text in the form in which they are compared: trimmed, lower case."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    for blank in "\t\r\f\x0b":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))  # trim itself would take the place in the list as a second argument


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """(start from 1, size) of each segment of a line of ``length``: even sizes, the longer ones last."""
    parts, out = EDITS + 1, []
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    for i in range(parts):
        extra = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - longer))
        size = base + F.when(F.lit(i) >= F.lit(parts) - longer, 1).otherwise(0)
        out.append((base * i + extra + 1, size))
    return out


def probe_places() -> list[tuple[int, int, int]]:
    """(length difference, segment, offset from the segment's start) where a segment of a shorter line can stand."""
    out = []
    for less in range(EDITS + 1):
        for i in range(EDITS + 1):
            low, high = max(-i, less - (EDITS - i)), min(i, less + (EDITS - i))
            out += [(less, i, off) for off in range(low, high + 1)]
    return out


def _key(prefix: tuple[Column, ...], wide: Column, length: Column, start: Column, size: Column, segment: int, less: int) -> Column:
    """Name of the substring as segment of a line of ``length - less`` characters; it always lies within the line."""
    return F.xxhash64(*prefix, (length - less).cast("int"), F.lit(segment), F.substring(wide, start * 4 - 3, size * 4))


def _own_places(length: Column) -> list[tuple[Column, Column, int, int]]:
    """(start, size, segment, length difference) of a line's own segments."""
    return [(start, size, i, 0) for i, (start, size) in enumerate(_segments(length))]


def _probed_places(length: Column, which: list[tuple[int, int, int]]) -> list[tuple[Column, Column, int, int]]:
    """(start, size, segment, length difference) of the substrings that can be segments of a line as long or shorter."""
    at = {less: _segments(length - less) for less in {x[0] for x in which}}
    return [(at[less][i][0] + off, at[less][i][1], i, less) for less, i, off in which]


def _keys(wide: Column, length: Column, places: list, prefix: tuple[Column, ...] = ()) -> Column:
    """Names of the substrings; ``wide`` has four bytes a character, so that they need no count of characters."""
    return F.array(*(_key(prefix, wide, length, start, size, i, less) for start, size, i, less in places))


def _without(wide: Column, start: Column, size: Column) -> Column:
    """What a line holds beside a substring."""
    return F.concat(F.substring(wide, F.lit(1), (start - 1) * 4), F.substring(wide, (start + size) * 4 - 3, F.lit(1 << 30)))


def common_start(a: Column, b: Column) -> Column:
    """Number of characters that a and b (not shorter than a) begin with alike, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))
    grow = lambda n, step: F.when((n + step <= F.length(a)) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), grow)


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance where it is at most EDITS, else something larger; a is not longer than b, by at most EDITS.

    What both begin and end with changes no distance and is set aside; the rest goes through the band.
    """
    pad = F.lit("~" * (EDITS + 1))  # the band needs a pattern longer than EDITS; a like start changes no distance
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    cut = lambda x, n: F.substring(x, n + 1, F.length(x) - n)
    ahead = let(F.struct(a.alias("a"), b.alias("b"), common_start(a, b).alias("n")), lambda s: F.struct(F.reverse(cut(s["a"], s["n"])).alias("a"), F.reverse(cut(s["b"], s["n"])).alias("b")))
    both = let(ahead, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), common_start(s["a"], s["b"]).alias("n")))
    rest = let(both, lambda s: F.struct(cut(s["a"], s["n"]).alias("a"), cut(s["b"], s["n"]).alias("b")))
    return let(rest, lambda s: F.when(s["a"] == "", F.length(s["b"])).otherwise(_in_band(F.concat(pad, s["a"]), F.concat(pad, s["b"]))))


def _in_band(a: Column, b: Column) -> Column:
    """Edit distance where it is at most EDITS, else something larger; a is not empty, nor longer than b.

    Bit-parallel in a band of 2 * EDITS + 1 diagonals: bit k of a step stands for the character of ``b`` that lies
    k - EDITS places from the step's place in ``a``.
    """
    width = 2 * EDITS + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    # one step a character of the longer line; the shorter line's characters are the pattern
    chars = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"))

    def step(p: Column, t: Column, rows: Column):
        def run(state: Column, j: Column) -> Column:
            here = F.get(t, j)
            match = F.lit(0)
            for k in range(width):
                match = match.bitwiseOR(F.when(F.get(p, j + (k - EDITS)) == here, F.lit(1 << k)).otherwise(F.lit(0)))
            # the steps beyond the shorter line are counted along its last row
            return _advance(state, match, j >= rows - EDITS, full, top)

        return run

    def whole(c: Column) -> Column:
        p, t = c["p"], c["t"]
        rows, cols = F.size(p), F.size(t)
        start = F.struct(F.lit(full - (1 << EDITS) + 1).alias("vp"), F.lit(0).alias("vn"), F.lit(EDITS).alias("dist"), F.lit(top >> 1).alias("mark"))
        done = F.aggregate(F.sequence(F.lit(0), cols - 1), start, step(p, t, rows))
        return done["dist"]

    return F.element_at(F.transform(F.array(chars), whole), 1)


def _advance(state: Column, match: Column, flat: Column, full: int, top: int) -> Column:
    """One step of the band; ``flat``: the band's last diagonal has left the pattern, so its last row is followed."""

    def d0_of(s: Column) -> Column:
        m, vp, vn = s["m"], s["vp"], s["vn"]
        total = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        return F.struct(total.bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full)).alias("d0"), vp.alias("vp"), vn.alias("vn"), s["dist"].alias("dist"), s["mark"].alias("mark"))

    def hp_of(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))).bitwiseAND(F.lit(full))
        hn = s["d0"].bitwiseAND(s["vp"])
        return F.struct(hp.alias("hp"), hn.alias("hn"), F.shiftright(s["d0"], 1).alias("down"), s["d0"].alias("d0"), s["dist"].alias("dist"), s["mark"].alias("mark"))

    def close(s: Column) -> Column:
        up = F.when(s["hp"].bitwiseAND(s["mark"]) != 0, 1).otherwise(0) - F.when(s["hn"].bitwiseAND(s["mark"]) != 0, 1).otherwise(0)
        slant = F.when(s["d0"].bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)
        return F.struct(
            s["hn"].bitwiseOR(F.bitwise_not(s["down"].bitwiseOR(s["hp"]))).bitwiseAND(F.lit(full)).alias("vp"),
            s["down"].bitwiseAND(s["hp"]).alias("vn"),
            (s["dist"] + F.when(flat, up).otherwise(slant)).alias("dist"),
            F.when(flat, F.shiftright(s["mark"], 1)).otherwise(s["mark"]).alias("mark"),
        )

    first = F.struct(match.alias("m"), state["vp"].alias("vp"), state["vn"].alias("vn"), state["dist"].alias("dist"), state["mark"].alias("mark"))
    # each stage is bound by a transform over one element, so that none is computed twice
    return F.element_at(F.transform(F.transform(F.transform(F.array(first), d0_of), hp_of), close), 1)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, copy (names the text among rows that share the id), line_no, line."""
    rows = docs.where(F.col("doc_id").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.posexplode(normal_lines(F.col("text"))).alias("line_no", "line"))


def letter_counts(line: Column, chars: Column) -> Column:
    """Counts of LETTERS in a line and of all that is left, each modulo 8, three bits a count."""
    of = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    rest = chars - sum(of, F.lit(0))
    return sum((F.shiftleft(n.bitwiseAND(F.lit(7)).cast("long"), 3 * k) for k, n in enumerate([*of, rest])), F.lit(0).cast("long"))


def near_counts(a: Column, b: Column) -> Column:
    """Whether two packed counts allow EDITS edits: one edit moves them by at most two, so no link is lost."""

    def apart(k: int) -> Column:
        d = (F.shiftright(a, 3 * k).bitwiseAND(F.lit(7)) - F.shiftright(b, 3 * k).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(7))
        return F.least(d, F.lit(8) - d)

    return sum((apart(k) for k in range(1, len(LETTERS) + 1)), apart(0)) <= 2 * EDITS


def _picked(df: DataFrame, keys: DataFrame, few: bool, column: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among ``keys``, or is not; ``few``: keys are BROADCAST_ROWS at most."""
    return df.join(F.broadcast(keys) if few else keys, column, how)


def _hot_keys(own: DataFrame) -> tuple[DataFrame, int]:
    """Keys that more than HOT lines own, and their number."""
    hot = saved(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), "hot-segments")
    return hot, hot.count()


def candidate_pairs(lines: DataFrame) -> DataFrame:
    """(a, b): numbers of lines that share a segment where a near pair must; ``lines``: id, line, chars."""
    # explode_outer: arrays of keys are never empty, and Spark then leaves the keys outside the generator's own method, which
    # they would make too long to be compiled (83 microseconds a line instead of 7)
    either = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    wide, length = F.encode("line", "UTF-32"), F.col("chars")
    every = probe_places()
    moved = [x for x in every if x[0] or x[2]]  # at the same place of a line as long, both own the segment
    keyed = lambda places: lines.select("id", _keys(wide, length, places).alias("keys")).select("id", F.explode_outer("keys").alias("key"))
    own, probe = keyed(_own_places(length)), keyed(_probed_places(length, moved)).withColumnRenamed("id", "of")
    hot, n_hot = _hot_keys(own)
    cold = _picked(own, hot, n_hot <= BROADCAST_ROWS, "key", "left_anti") if n_hot else own
    same = cold.join(cold.withColumnRenamed("id", "of"), "key").where(F.col("id") < F.col("of")).select(*either("id", "of"))
    pairs = same.unionByName(cold.join(probe, "key").where(F.col("id") != F.col("of")).select(*either("id", "of")))
    return pairs.unionByName(_refined(lines, hot, n_hot)) if n_hot else pairs


def _refined(lines: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """The pairs under hot keys, by further segments of what stands beside them."""
    length, every = F.col("chars"), probe_places()

    def under(df: DataFrame, places: list, hot: DataFrame, n: int, prefix: tuple[Column, ...] = (), wide: Column = F.col("rest")) -> DataFrame:
        """df's rows with "key" and "at", its place; only those under hot keys if there are any."""
        rows = df.select("*", _keys(wide, F.col("chars"), places, prefix).alias("names")).select(*(c for c in df.columns if c != "key"), F.posexplode_outer("names").alias("at", "key"))
        return _picked(rows, hot, n <= BROADCAST_ROWS, "key") if n else rows

    def beside(df: DataFrame, places: list) -> DataFrame:
        rest, less = (F.element_at(F.array(*x), F.col("at") + 1) for x in ([_without(F.col("rest"), start, size) for start, size, _, _ in places], [F.lit(less) for _, _, _, less in places]))
        out = df.select("key", "id", "letters", rest.alias("rest"), less.alias("less"))
        return out.withColumn("chars", (F.octet_length("rest") / 4).cast("int"))

    own, probe = _own_places(length), _probed_places(length, every)
    # letters and what stands beside the key are made for the rows under hot keys alone
    begun = lambda places: beside(under(lines, places, hot, n_hot, wide=F.encode("line", "UTF-32")).withColumns({"rest": F.encode("line", "UTF-32"), "letters": letter_counts(F.col("line"), length)}), places)
    held, asked = saved(begun(own).drop("less"), "hot-own"), saved(begun(probe), "hot-probes")
    pairs = None
    for level in range(1, DEPTH + 1):
        prefix = (F.col("key"),)
        mine = under(held, own, hot, 0, prefix)
        # a probe looks for lines that are shorter by as much as its whole line was
        by_less = [under(asked.where(F.col("less") == k), _probed_places(length, [x for x in every if x[0] == k]), hot, 0, prefix) for k in range(EDITS + 1)]
        hot, n_hot = _hot_keys(mine) if level < DEPTH else (hot, 0)
        cold = _picked(mine, hot, n_hot <= BROADCAST_ROWS, "key", "left_anti") if n_hot else mine
        theirs = reduce(DataFrame.unionByName, by_less)
        met = cold.select("key", "id", "letters").join(theirs.select("key", F.col("id").alias("of"), F.col("letters").alias("of_letters")), "key")
        met = met.where((F.col("id") != F.col("of")) & near_counts(F.col("letters"), F.col("of_letters"))).select(F.least("id", "of").alias("a"), F.greatest("id", "of").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
        if not n_hot:
            break
        held = saved(beside(_picked(mine, hot, n_hot <= BROADCAST_ROWS, "key"), own).drop("less"), "hot-own")
        parts = [beside(_picked(x, hot, n_hot <= BROADCAST_ROWS, "key"), _probed_places(length, [p for p in every if p[0] == k])) for k, x in enumerate(by_less)]
        asked = saved(reduce(DataFrame.unionByName, parts), "hot-probes")
    return pairs


def line_classes(docs: DataFrame) -> DataFrame:
    """Classes that another line repeats or is near to: h1, h2 (128 bits of the line's hash), n_lines, n_links (other classes
    linked directly), first_doc, first_line (of the component).
    """
    # the place in one number, so that the partial aggregation hashes and doesn't sort
    base = F.lit(1 << 32).cast("decimal(10,0)")
    place = F.col("doc_id").cast("decimal(20,0)") * base + F.col("line_no").cast("decimal(10,0)")
    distinct = _lines(docs).where(F.col("line") != "").groupBy("line").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n_lines"))
    classes = saved(distinct.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("chars"), "at", "n_lines"), "line-classes")
    long_lines = classes.where(F.col("chars") >= LEAST_CHARS).select("id", "line", "chars")
    pairs = saved(candidate_pairs(long_lines).distinct(), "line-pairs")
    met = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "lines-met")
    few = met.count() <= BROADCAST_ROWS
    texts = saved(_picked(long_lines, met, few, "id").withColumn("letters", letter_counts(F.col("line"), F.col("chars"))), "line-texts")
    side = lambda s: texts.select(F.col("id").alias(s), F.col("letters").alias(f"letters_{s}"), F.struct("chars", "line").alias(f"line_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near_counts(F.col("letters_a"), F.col("letters_b")))
    both = both.select("a", "b", F.least("line_a", "line_b")["line"].alias("x"), F.greatest("line_a", "line_b")["line"].alias("y"))
    links = saved(both.where(edit_distance(F.col("x"), F.col("y")) <= EDITS).select("a", "b"), "line-links")
    components = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = components.join(degree, "node").withColumnRenamed("node", "id")
    named = classes.select("id", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "at", "n_lines")
    marked = named.join(F.broadcast(linked) if few else linked, "id", "left").where((F.col("n_lines") > 1) | F.col("n_links").isNotNull())
    marked = saved(marked, "line-marks")
    discard(pairs, met, texts, links, components, classes)
    near = marked.where(F.col("n_links").isNotNull())
    first = near.groupBy("component").agg(F.min("at").alias("first"))
    alone = marked.where(F.col("n_links").isNull()).withColumn("first", F.col("at"))
    out = near.join(first, "component").unionByName(alone)
    row = F.pmod(F.col("first"), base)
    first_doc = ((F.col("first") - row) / base).cast("decimal(20,0)").cast("long")
    return out.select("h1", "h2", "n_lines", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first_doc.alias("first_doc"), row.cast("int").alias("first_line"))


def _judged(docs: DataFrame) -> DataFrame:
    """Every line: doc_id, copy, line_no, n_links, first_doc, first_line, kept."""
    lines = _lines(docs).select("doc_id", "copy", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    out = lines.join(line_classes(docs), ["h1", "h2"], "left")
    first_doc, first_line = F.coalesce("first_doc", "doc_id"), F.coalesce("first_line", "line_no")
    kept = (first_doc == F.col("doc_id")) & (first_line == F.col("line_no"))
    return out.select("doc_id", "copy", F.col("line_no").cast("long").alias("line_no"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), first_doc.alias("first_doc"), first_line.cast("long").alias("first_line"), kept.alias("kept"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Every line: doc_id, line_no (from 0), n_links, first_doc, first_line (of its component), kept."""
    return _judged(docs).drop("copy")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, n_chars following the text. A document of which nothing but blanks is left goes."""
    of_doc, of_copy, gone = (free_name(x, docs.columns) for x in ("of_doc", "of_copy", "gone"))
    dropped = _judged(docs).where(~F.col("kept")).groupBy(F.col("doc_id").alias(of_doc), F.col("copy").alias(of_copy)).agg(F.collect_set("line_no").alias(gone))
    joined = docs.join(dropped, (docs["doc_id"].cast("long") == dropped[of_doc]) & (F.xxhash64(docs["text"]) == dropped[of_copy]), "left")
    changed = F.col(gone).isNotNull()
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains(F.col(gone), k.cast("long"))), "\n")
    out = joined.withColumn("text", F.when(changed, kept).otherwise(F.col("text"))).where(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
