"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern; the pattern's words flow to the
quotas of its sources, the first copy of a word at no cost, each further copy at a higher one (convex repetition costs),
so a word is repeated only where no fresh one fits. The flow of a pattern is then laid over its documents in a seeded
order: a whole copy of all of them, then of the first ones, the last of these in part, so quotas are met to the word.

Only sums by pattern reach the driver (at most MOST_PATTERNS, or ValueError); patterns that share no source, directly or
through others, are separate flows there. The seeded order is found from sums of hash buckets, 4,096 a pattern, then 4,096
more in the bucket that the quota cuts; single documents are ordered only in one of these a pattern.

Defined cases: a null or blank text has no words, and nothing is taken of it; a null source is a source of its own,
ordered last; repeated rows are separate documents, as are rows that share a doc_id; a row without doc_id is a document
like others, ordered by its text. Other columns are passed on by :func:`mixed_documents`, else ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.shared import saved

MOST_PATTERNS = 100_000
#: Hexadecimal digits of a bucket's name: 4,096 buckets, and as many in one of them.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets: ``share`` of all words by weight, none above ``most`` times its source; what is cut goes to the others."""
    caps = [float(most * s) for s in sizes]
    out: list[float] = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        weight = sum(weights[k] for k in free)
        above = [k for k in free if left * weights[k] / weight > caps[k]]
        if not above:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in above:
            out[k] = caps[k]
            free.discard(k)
        left = share * sum(sizes) - sum(caps[k] for k in range(len(sizes)) if k not in free)
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


def _flow(capacity: list[int], members: list[list[int]], quota: list[int], copies: int) -> list[dict[int, int]]:
    """The flow of patterns that hang together, by shortest augmenting paths with Bellman-Ford."""
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    graph: list[list[_Arc]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Arc(b, room, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    for p in range(n):
        for c in range(copies):
            arc(start, p, capacity[p], c)
        for s in members[p]:
            arc(p, n + s, capacity[p] * copies, 0)
    for s in range(m):
        arc(n + s, end, quota[s], 0)
    while True:
        dist, via = {start: 0}, {}
        queue = [start]
        while queue:
            nxt = []
            for a in queue:
                for k, e in enumerate(graph[a]):
                    if e.room > 0 and dist[a] + e.cost < dist.get(e.to, math.inf):
                        dist[e.to], via[e.to] = dist[a] + e.cost, (a, k)
                        nxt.append(e.to)
            queue = list(dict.fromkeys(nxt))
        if end not in dist:
            break
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = via[node][0]
        flow = min(graph[a][k].room for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e.room -= flow
            graph[e.to][e.back].room += flow
    return [{e.to - n: graph[e.to][e.back].room for e in graph[p] if n <= e.to < n + m and graph[e.to][e.back].room > 0} for p in range(n)]


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], copies: int) -> list[dict[int, int]]:
    """Words that each pattern gives each source: as many as fit, at the least repetition cost.

    capacity: words of a pattern; members: its sources; quota: words that a source takes; copies: times a word may be
    taken. The n-th copy of a word costs n - 1. Patterns are solved by the groups that shared sources make of them.
    """
    head = list(range(len(quota)))

    def find(s: int) -> int:
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for own in members:
        for s in own[1:]:
            head[find(s)] = find(own[0])
    groups: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        if own:
            groups.setdefault(find(own[0]), []).append(p)
    out: list[dict[int, int]] = [{} for _ in capacity]
    for patterns in groups.values():
        sources = sorted({s for p in patterns for s in members[p]})
        place = {s: k for k, s in enumerate(sources)}
        found = _flow([capacity[p] for p in patterns], [[place[s] for s in members[p]] for p in patterns], [quota[s] for s in sources], copies)
        for p, given in zip(patterns, found, strict=True):
            out[p] = {sources[s]: n for s, n in given.items()}
    return out


def words_in(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, sources: Column, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: str = "mix", with_row: bool = False) -> DataFrame:
    """(doc_id, pattern, size, pattern_words, taken, targets, source_words) of every row, with ``with_row`` its row too.

    ``sources``: the row's sources, an array of strings (nulls allowed). Sources take ``weights`` in turn, by code point,
    null last. ``taken``: words that the mix takes, repeats counted. ``targets`` and ``source_words`` are aligned with
    ``pattern``.
    """
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []
    sized = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("pattern"), words_in(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), name)).alias("rank"), F.xxhash64("text").alias("tie"), *row,
        ), "sizes",
    )
    buckets = saved(sized.groupBy("pattern", F.substring("rank", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    sums = buckets.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    names = sorted({s for r in sums for s in r.pattern}, key=lambda s: (s is None, s or ""))
    place = {s: k for k, s in enumerate(names)}
    sums.sort(key=lambda r: [place[s] for s in r.pattern])
    of_source = [0] * len(names)
    for r in sums:
        for s in r.pattern:
            of_source[place[s]] += r.words
    targets = water_fill(of_source, [weights[k % len(weights)] for k in range(len(names))], share, most)
    flow = min_cost_flow([r.words for r in sums], [[place[s] for s in r.pattern] for r in sums], [math.floor(t) for t in targets], most)
    rows = []
    for r, given in zip(sums, flow, strict=True):
        total = sum(given.values())
        full, part = divmod(total, r.words) if r.words else (0, 0)
        rows.append((r.pattern, r.words, full, part, [targets[place[s]] for s in r.pattern], [of_source[place[s]] for s in r.pattern]))
    plan = docs.sparkSession.createDataFrame(rows, "key array<string>, pattern_words long, full long, part long, targets array<double>, source_words array<long>")
    same = lambda df: df.join(F.broadcast(plan), df["pattern"] == plan["key"]).drop("key")  # noqa: E731  at most MOST_PATTERNS rows

    def cut(sums: DataFrame) -> DataFrame:
        """The bucket of each pattern that its part ends in, and the words of the buckets before; a row a pattern at most."""
        ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = same(sums).withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        found = found.where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("words")))
        return found.select(F.col("pattern").alias("cut_pattern"), F.col("bucket").alias("cut_bucket"), "before")

    narrow = sized.drop("row")
    first = cut(buckets.withColumn("start", F.lit(0).cast("long")))
    finer = narrow.join(F.broadcast(first), (F.col("pattern") == F.col("cut_pattern")) & (F.substring("rank", 1, DIGITS) == F.col("cut_bucket")))
    finer = finer.groupBy("pattern", F.substring("rank", 1, 2 * DIGITS).alias("bucket")).agg(F.sum("size").alias("words"), F.max("before").alias("start"))
    ends = saved(cut(finer), "cuts")
    placed = same(sized.withColumn("bucket", F.substring("rank", 1, 2 * DIGITS))).join(F.broadcast(ends), F.col("pattern") == F.col("cut_pattern"), "left")
    in_order = Window.partitionBy("pattern").orderBy("rank", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where(F.col("bucket") == F.col("cut_bucket")).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    inside = inside.withColumn("extra", F.least(F.col("size"), F.greatest(F.col("part") - F.col("ahead"), F.lit(0)))).drop("ahead")
    outside = placed.where(F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket")))
    outside = outside.withColumn("extra", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("size")).otherwise(F.lit(0)))
    out = inside.unionByName(outside)
    return out.select("doc_id", "pattern", "size", "pattern_words", (F.col("full") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "targets", "source_words", *(["row"] if with_row else []))


def digest_columns(mixed: DataFrame) -> DataFrame:
    """The columns of the query, for documents of one source each."""
    return mixed.select("doc_id", "size", F.col("source_words")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def take_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n at least 1)."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(words, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, sources: Column, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a last copy taken in part is cut after its last word taken.

    n_chars follows the text. Documents of which nothing is taken go; rows without a doc_id are taken like others.
    """
    taken = mix(docs, sources, with_row=True, **how).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = taken.select("row", "size", F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.col("taken") - k * F.col("size"))).alias("left"))
    part = F.col("left") < F.col("size")
    text = F.when(part, take_words(F.col("row")["text"], F.col("left"))).otherwise(F.col("row")["text"])
    each = each.select("row", part.alias("part"), text.alias("text"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("part"), F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return each.select(*((made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS rank,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(words) OVER () AS total FROM s),
o AS (SELECT *, 2.0::DOUBLE * words AS cap, 2.0::DOUBLE * words / weight AS ratio FROM w),
p AS (SELECT *, 1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
             sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             row_number() OVER (ORDER BY ratio, k) AS place FROM o),
f AS (SELECT place, remaining, open_weight FROM p WHERE remaining * weight / open_weight <= cap ORDER BY place LIMIT 1),
t AS (SELECT p.source, p.words, CASE WHEN p.place < f.place THEN p.cap ELSE f.remaining * p.weight / f.open_weight END AS target FROM p, f),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM t),
x AS (SELECT d.doc_id, d.size, q.words, q.target, q.quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, words AS source_size, target,
       CAST(CASE WHEN words = 0 THEN 0 ELSE (quota // words) * size + least(size, greatest(quota % words - ahead, 0)) END AS BIGINT) AS taken
FROM x
"""
