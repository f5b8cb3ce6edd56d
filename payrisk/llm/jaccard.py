"""Exact join of documents by the Jaccard similarity of their word shingles, in the metric space of its distance.

One minus the Jaccard similarity is a metric: if x and y are within the radius r of each other, then for
any pivot p the distances d(x, p) and d(y, p) differ by r at most. The join uses this throughout:

1. Documents of equal sets are one class, under a digest of the set.
2. Each shingle is counted over all documents. A set of which too many shingles occur nowhere else has no
   neighbour. Of the others, neighbours share one of the rarest shingles of each, as many as a partner may
   lack and one more; these connect the classes into groups that are joined apart from each other.
3. A group that is too large for a task gets pivots. Members within the radius are linked to
   them; the others fall into Voronoi regions of the nearest pivot, and triangle windows copy a member to each
   region that may hold a neighbour of it: to p if d(y, p) <= min(ball + r, d(y, home) + 2 r). Members beyond
   all balls are a region of their own. Regions are joined in the same way. Members whose
   neighbours are all known to be connected to them drop out, and so do the pivots.
4. A small group, and one of bounded size that regions would copy more than cut, is joined in one task by the same rules, with the
   documents as pivots in turn.

All similarities are exact. Links are reported as far as they connect different classes that nothing
connects yet, so copies and dense groups are not expanded into pairs, and components are whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrisk.llm import cells
from payrisk.llm.common import Batches, as_bytes, over_batches, ready, store
from payrisk.llm.components import components
from payrisk.operators.skew import broadcast_if_small

SHINGLE, PERCENT = 5, 80
# A group of more shingles than GROUP_CELLS gets pivots. Where these do not cut it into regions, one task joins up to TASK_CELLS.
GROUP_CELLS, TASK_CELLS = 100_000, 4_000_000
# Pivots of a group, more by the root of its size; members beside which a task compares them, at least.
PIVOTS, MEMBERS = 16, 64
# Members this near to their home pivot belong to its region.
BALL = 0.5
CLOSE = 1e-9
# Entries of the table of a group, and members that are counted in it at once.
TABLE, AHEAD = 1 << 24, 64
# Bytes of texts whose words are hashed at once, about.
TOGETHER = 1 << 19

SET_SCHEMA = "doc_id bigint, n_shingles bigint, digest binary, prefix array<bigint>, common double"
SET_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))]
    + [("common", pa.float64())]
)
MEMBER_SCHEMA = "group binary, digest binary, n bigint, shingles binary, common double"
LINK_SCHEMA = "a binary, b binary"
LINK_TYPES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, in order. By sorting: numpy's own ``unique`` goes through a hash table, which is many times slower here."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def shingles_of(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of all words, if they are fewer than one shingle has."""
    return shingles_of_each([text], size)[0]


def shingles_of_each(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The same for many texts: words and windows of some of them are hashed together, and windows across two texts are left out."""
    sets: list[np.ndarray] = []
    begin, n_bytes = 0, 0
    for end, text in enumerate(texts, 1):
        n_bytes += len(text or b"")
        if n_bytes < TOGETHER and end < len(texts):
            continue
        ids, counts = cells.word_ids_of_texts([t.lower() if t else b"" for t in texts[begin:end]])
        windows, at = cells.window_hashes(ids, size), 0
        for text, n in zip(texts[begin:end], counts):
            if n >= size:
                sets.append(distinct(windows[at : at + n - size + 1]))
            else:
                few = [xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), seed=n)] if n else []
                sets.append(np.array(few, np.uint64))
            at += n
        begin, n_bytes = end, 0
    return sets


def levels(totals: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in their order: exact up to 127, then in steps of a tenth, and equal beyond 2 * 10^7."""
    beyond = np.log(np.maximum(totals, 127) / 127) / np.log(1.1)
    return np.minimum(np.where(totals < 128, totals, 128 + beyond), 255).astype(np.uint8)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with a neighbour."""
    return -(-n * percent // 100)


def linked(inter: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + sizes - inter)


def shingle_sets(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, least: int = cells.LEAST, most: int = cells.MOST
) -> DataFrame:
    """Size and digest of each row's set, and for rows that may have neighbours the shingles by which to find them."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = cells.layout_of(texts, least, most)

    def sets_of(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        sets = shingles_of_each(as_bytes(rows.column("text").combine_chunks()), size)
        return sets, np.concatenate(sets)

    def to_cells(rows: pa.Table) -> pa.Table:
        hashes, counts = np.unique(sets_of(rows)[1], return_counts=True)
        return cells.cells_of(rows.column("seg")[0].as_py(), hashes, counts.astype(np.uint32), layout)

    def to_answers(table: pa.Table) -> pa.Table:
        segments, sizes, hashes, counts, _ = cells.bucket_of(table, np.uint32)
        _, place = np.unique(hashes, return_inverse=True)
        totals = np.bincount(place, counts)[place]
        # The order of shingles needs no more than a byte each.
        return cells.answers_of(table, segments, sizes, levels(totals), lambda v: v.tobytes())

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SET_TYPES.empty_table()
        sets, joined = sets_of(rows)
        hashes, place = np.unique(joined, return_inverse=True)
        times = cells.read_answers(answers, layout.cuts(hashes), lambda raw, n: np.frombuffer(raw, np.uint8), np.uint8)
        times, at = times[place], 0
        prefixes, means = [], []
        for own in sets:
            n = len(own)
            spare = n - least_shared(n, percent)  # what a neighbour may lack
            common = times[at : at + n]
            at += n
            rare = int((common == 1).sum())
            if not n or rare > spare:
                prefixes.append(None)
                means.append(None)
                continue
            order = np.lexsort((own, common))[rare : spare + 1]
            prefixes.append(own[order].view(np.int64).tolist())
            means.append(float(common.mean()))
        columns = [
            rows.column("doc_id").to_pylist(), [len(s) for s in sets], [digest_of(s) for s in sets], prefixes, means
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SET_TYPES)], schema=SET_TYPES)

    return cells.counted_by_segment(texts, layout, to_cells, to_answers, finish, SET_SCHEMA)


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links from every class to the least class that shares one of its rarest shingles."""
    postings = store(classes.select("digest", F.explode("prefix").alias("shingle")), "postings")
    heads = postings.groupBy("shingle").agg(F.min("digest").alias("head"), F.max("digest").alias("tail"))
    heads = heads.where("head < tail").select("shingle", "head")
    return postings.join(heads, "shingle").where("digest != head").select("digest", "head").distinct()


class Group:
    """Sets of a group, with a table of the shingles that many members have and an index from the others to their members."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.times = np.bincount(place, minlength=len(every))
        common = np.flatnonzero(self.times >= max(MEMBERS, len(sets) // 8))
        common = common[np.argsort(-self.times[common], kind="stable")][: TABLE // len(sets)]
        column = np.full(len(every), -1)
        column[common] = np.arange(len(common))
        in_table = column[place] >= 0
        # Counts up to 2^24 are exact in this type.
        self.table = np.zeros((len(sets), len(common)), np.float32)
        self.table[owner[in_table], column[place[in_table]]] = 1
        self.own = np.split(place, np.cumsum(self.sizes)[:-1])
        self.rest = [own[column[own] < 0] for own in self.own]
        self.members = owner[np.argsort(place, kind="stable")]
        self.begins = np.concatenate([[0], np.cumsum(self.times)])

    def central(self) -> list[int]:
        """All members, those first whose shingles are in most others on average."""
        return np.argsort([-self.times[own].mean() for own in self.own], kind="stable").tolist()

    def in_table_with(self, some: list[int]) -> dict[int, np.ndarray]:
        """For each of these, how many shingles of the table each member shares with it."""
        return dict(zip(some, self.table[some] @ self.table.T))

    def near(self, x: int, in_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members that share a shingle with ``x``: which, their distance, whether they are linked."""
        inter = in_table.astype(np.int64)
        if len(self.rest[x]):
            found = np.concatenate([self.members[self.begins[s] : self.begins[s + 1]] for s in self.rest[x]])
            inter += np.bincount(found, minlength=len(self.sizes))
        which = np.flatnonzero(inter)
        which = which[which != x]
        inter = inter[which]
        union = self.sizes[x] + self.sizes[which] - inter
        return which, 1 - inter / union, linked(inter, self.sizes[x], self.sizes[which], self.percent)


def connect(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is connected, without a link inside of what earlier ones connect.

    Documents are pivots in turn, those whose shingles most others have first: the middle of a cloud of near copies takes all of it
    that is within the radius. Members of no ball are next, each against all that share a shingle with it. Only then
    come those in the balls: one at the distance d of its pivot p needs no look at the others if no member outside the ball
    within d and the radius of p is both without a look of its own and not connected to p.
    """
    group, radius = Group(sets, percent), 1 - percent / 100
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ball: dict[int, tuple[int, float]] = {}
    # Per pivot: how many are in its ball; members around it by their distance; how many of the first of these are of no concern any more.
    held: dict[int, int] = {}
    shell: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    passed: dict[int, int] = {}
    looked = np.zeros(len(sets), bool)
    found = []

    def leave(y: int) -> None:
        if y in ball:
            p, _ = ball.pop(y)
            held[p] -= 1
            if not held[p]:
                del held[p], shell[p], passed[p]

    def look(x: int, in_table: np.ndarray) -> None:
        looked[x] = True
        leave(x)
        which, distance, close = group.near(x, in_table)
        farthest = -1.0
        for y, d in zip(which[close].tolist(), distance[close].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((x, y))
            if not looked[y] and (y not in ball or d < ball[y][1]):
                leave(y)
                ball[y], farthest = (x, d), max(farthest, d)
                held[x] = held.get(x, 0) + 1
        if x in held:
            around = np.flatnonzero(~close & (distance <= farthest + radius + CLOSE) & ~looked[which])
            around = around[np.argsort(distance[around], kind="stable")]
            shell[x], passed[x] = (which[around].astype(np.int32), distance[around]), 0

    def settled(x: int) -> bool:
        p, d = ball[x]
        (which, distance), at, own = shell[p], passed[p], root(x)
        # What is looked at or connected stays so.
        while at < len(which) and (looked[which[at]] or root(int(which[at])) == own):
            at += 1
        passed[p] = at
        return at == len(which) or distance[at] > d + radius + CLOSE

    order = group.central()
    for open_now in (lambda x: x not in ball and not looked[x], lambda x: not looked[x] and not settled(x)):
        ahead: dict[int, np.ndarray] = {}
        for k, x in enumerate(order):
            if open_now(x):
                if x not in ahead:
                    ahead = group.in_table_with([x, *filter(open_now, order[k + 1 : k + AHEAD])])
                look(x, ahead.pop(x))
    return found


def join_groups(members: DataFrame, percent: int) -> DataFrame:
    """Links inside groups that fit a task."""

    def join(rows: pa.Table) -> pa.Table:
        digests = rows.column("digest").to_pylist()
        order = sorted(set(digests))
        at = {d: k for k, d in enumerate(digests)}
        raw = rows.column("shingles")
        sets = [np.frombuffer(raw[at[d]].as_py(), np.uint64) for d in order]
        links = [{"a": order[x], "b": order[y]} for x, y in connect(sets, percent)]
        return pa.Table.from_pylist(links, schema=LINK_TYPES)

    return members.groupBy("group").applyInArrow(join, LINK_SCHEMA)


NEAR_SCHEMA = (
    "group binary, digest binary, n bigint, shingles binary, common double, "
    "near array<struct<pivot: binary, distance: double, linked: boolean>>, is_pivot boolean"
)
NEAR_TYPES = pa.schema(
    [("group", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary()), ("common", pa.float64())]
    + [("near", pa.list_(pa.struct([("pivot", pa.binary()), ("distance", pa.float64()), ("linked", pa.bool_())])))]
    + [("is_pivot", pa.bool_())]
)


def distances(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Members with the pivots of their group that share a shingle with them. Large groups are salted over tasks."""

    def measure(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return NEAR_TYPES.empty_table()
        names = chosen.column("digest").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in chosen.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        # The pivots' shingles in order, each as often as it occurs, with the pivots that have it.
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        near = []
        for digest, raw in zip(rows.column("digest").to_pylist(), rows.column("shingles").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            begin, end = np.searchsorted(every, own), np.searchsorted(every, own, "right")
            times = end - begin
            held = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
            inter = np.bincount(owner[held], minlength=len(sets))
            which = [k for k in np.flatnonzero(inter).tolist() if names[k] != digest]
            inter = inter[which]
            apart, close = 1 - inter / (len(own) + sizes[which] - inter), linked(inter, len(own), sizes[which], percent)
            near.append([
                {"pivot": names[k], "distance": d, "linked": c} for k, d, c in zip(which, apart.tolist(), close.tolist())
            ])
        own_names = set(names)
        is_pivot = [d in own_names for d in rows.column("digest").to_pylist()]
        columns = [*(rows.column(c).combine_chunks() for c in ("group", "digest", "n", "shingles", "common"))]
        columns += [pa.array(near, NEAR_TYPES.field("near").type), pa.array(is_pivot)]
        return pa.Table.from_arrays(columns, schema=NEAR_TYPES)

    keyed = members.withColumn("salt", F.pmod(F.xxhash64("digest", F.lit("salt")), "salts").cast("int"))
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    keys = ["group", "salt"]
    return keyed.groupBy(*keys).cogroup(spread.select(*keys, "digest", "shingles").groupBy(*keys)).applyInArrow(
        measure, NEAR_SCHEMA
    )


def split_groups(large: DataFrame, level: int, percent: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One level for groups that do not fit: (links to the pivots, members of the regions)."""
    radius = 1 - percent / 100
    by_hash = F.xxhash64("digest", F.lit(level))
    some = F.pmod(by_hash, F.greatest(F.col("free_members"), F.lit(1))) < F.ceil(pivots * F.sqrt("parts"))
    chosen = store(large.where((some & F.col("free")) | (F.col("digest") == F.col("middle"))), "pivots")
    near = store(distances(large, chosen, percent), "pivot-distances")
    links = near.select("digest", "group", F.explode("near").alias("p")).where("p.linked")
    links = links.select("group", F.col("digest").alias("a"), F.col("p.pivot").alias("b"), F.col("p.distance").alias("d"))

    # Pivots of one component, as far as this level's links tell; a member has that of its pivots.
    anchor = F.get(F.filter("near", lambda p: p["linked"]), F.lit(0))["pivot"]
    anchored = near.withColumn("anchor", F.coalesce(anchor, F.when(F.col("is_pivot"), F.col("digest"))))
    told = F.filter("near", lambda p: p["linked"])
    meets = anchored.select("anchor", F.explode(told).alias("p")).select("anchor", F.col("p.pivot").alias("pivot"))
    meets = meets.distinct().where("anchor != pivot")
    same = components(meets, "anchor", "pivot")
    n_same = same.count()

    def component(of: str, name: str, rows: DataFrame) -> DataFrame:
        names = same.select(F.col("node").alias("_node"), F.col("component").alias(name))
        joined = rows.join(broadcast_if_small(names, n_same), F.col(of) == F.col("_node"), "left")
        return joined.withColumn(name, F.coalesce(name, of)).drop("_node")

    members = component("anchor", "own", anchored)
    each = component("pivot", "its", members.select("group", "own", F.explode("near").alias("p")).select(
        "group", "own", F.col("p.pivot").alias("pivot"), F.col("p.distance").alias("distance"), F.col("p.linked").alias("is_linked")
    ))
    # The nearest member that the pivot's component does not have yet.
    stranger = each.where(~F.col("own").eqNullSafe(F.col("its"))).groupBy("group", "pivot").agg(F.min("distance").alias("gap"))
    left = members.where(~F.col("is_pivot")).withColumn("ball", F.filter("near", lambda p: p["linked"]))
    nearest = F.array_min(F.transform("ball", lambda p: F.struct(p["distance"], p["pivot"])))
    left = left.withColumn("_pivot", nearest["pivot"]).withColumn("_distance", nearest["distance"])
    gaps = stranger.select(F.col("group").alias("_group"), F.col("pivot").alias("_of"), "gap")
    left = left.join(gaps, (F.col("group") == F.col("_group")) & (F.col("_pivot") == F.col("_of")), "left")
    # A distance of 1, where no shingle is shared, is no gap within reach.
    done = F.col("_pivot").isNotNull() & (F.coalesce("gap", F.lit(1.0)) > F.col("_distance") + radius + CLOSE)
    left = left.where(~done)

    free = F.size("ball") == 0
    home = F.array_min(F.transform("near", lambda p: F.struct(p["distance"], p["pivot"])))
    left = left.withColumn("free", free).withColumn("home", home)
    settled = F.coalesce(F.col("home.distance") <= BALL, F.lit(False))
    reach = F.when(settled, F.least(F.lit(BALL + radius), F.col("home.distance") + 2 * radius)).otherwise(F.lit(BALL + radius))
    regions = F.transform(F.filter("near", lambda p: p["distance"] <= reach + CLOSE), lambda p: p["pivot"])
    rest = F.when(settled, F.array().cast("array<binary>")).otherwise(F.array(F.lit(b"")))
    placed = store(left.select("group", "digest", "n", "shingles", "common", "free", F.concat(regions, rest).alias("regions")), "regions")
    # Where regions would hold far more than the group, it stays one, less its pivots and the members that are done.
    sizes = placed.groupBy("group").agg(
        (F.sum(F.col("n") * F.size("regions")) > F.lit(2) * F.sum("n")).alias("whole")
    )
    kept = placed.join(sizes, "group")
    kept = kept.withColumn("region", F.explode(F.when(F.col("whole"), F.array(F.lit(b"-"))).otherwise(F.col("regions"))))
    name = F.unhex(F.md5(F.concat("group", "region")))
    return links.select("a", "b"), kept.select(name.alias("group"), "digest", "n", "shingles", "common", "free", F.col("whole").alias("stuck"))


def link_members(
    members: DataFrame,
    percent: int = PERCENT,
    group_cells: int = GROUP_CELLS,
    pivots: int = PIVOTS,
    task_cells: int = TASK_CELLS,
) -> list[DataFrame]:
    """Links of all groups: small ones at once, the others level by level."""
    left, level, found = members.withColumns({"free": F.lit(True), "stuck": F.lit(False)}), 0, []
    while True:
        left = store(left.dropDuplicates(["group", "digest"]), "members")
        sizes = left.groupBy("group").agg(
            F.sum("n").alias("volume"),
            F.count(F.when(F.col("free"), 1)).alias("free_members"),
            # A pivot in any case: the free member, or else the member, with the most common shingles.
            F.max(F.struct("free", "common", "digest"))["digest"].alias("middle"),
            F.count(F.lit(1)).alias("n_members"),
            F.max("stuck").alias("stuck"),
        )
        limit = F.when(F.col("stuck"), F.lit(max(task_cells, group_cells))).otherwise(F.lit(group_cells))
        large = store(sizes.where(F.col("volume") > limit).drop("stuck"), "large-groups")
        n_large = large.count()
        names = broadcast_if_small(large.select("group"), n_large)
        found.append(store(join_groups(left.join(names, "group", "left_anti"), percent), "class-links"))
        if not n_large:
            return found
        parts = F.ceil(F.col("volume") / group_cells)
        salts = F.least(parts, F.ceil(F.col("n_members") / MEMBERS))
        big = left.join(broadcast_if_small(large.withColumns({"parts": parts, "salts": salts}), n_large), "group")
        links, left = split_groups(big, level, percent, pivots)
        found.append(store(links, "class-links"))
        level += 1


def join_documents(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    group_cells: int = GROUP_CELLS,
    pivots: int = PIVOTS,
    task_cells: int = TASK_CELLS,
    least: int = cells.LEAST,
    most: int = cells.MOST,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are left out): n_shingles, class (digest of its set) and component_id, the
    least doc_id that links reach from it.

    Words are runs of other characters than ASCII white space, lower-cased in A-Z. Texts without words, null ones among them,
    have an empty set and are linked with nothing. Equal rows are linked like any equal sets. A row without doc_id
    counts for links, but names a component only if that has no other, which is null then.
    """
    spark = docs.sparkSession
    ready(spark)
    sets = store(shingle_sets(docs, size, percent, least, most), "shingle-sets")
    several = sets.where("prefix is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.max("n_shingles").alias("n"), F.max("common").alias("common")
    )
    classes = store(several, "classes")
    groups = store(components(candidate_links(classes), "digest", "head"), "groups")
    # The text of one document of each class that has candidates.
    wanted = classes.join(groups, classes["digest"] == groups["node"]).select(
        F.col("doc_id").alias("_id"), "digest", "common", F.col("component").alias("group")
    )
    wanted = store(wanted, "class-texts")
    wanted = broadcast_if_small(wanted, wanted.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("group", "digest", "text", "common")

    def read(batches: Batches) -> Batches:
        for batch in batches:
            own = shingles_of_each(as_bytes(batch.column(2)), size)
            # Another row may have the same doc_id.
            keep = [k for k, (s, d) in enumerate(zip(own, batch.column(1).to_pylist())) if digest_of(s) == d]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), batch.column(1).take(at), pa.array([len(own[k]) for k in keep], pa.int64()),
                    pa.array([own[k].tobytes() for k in keep], pa.binary()), batch.column(3).take(at),
                ],
                names=["group", "digest", "n", "shingles", "common"],
            )

    members = over_batches(texts, read, MEMBER_SCHEMA)
    links = None
    for part in link_members(members, percent, group_cells, pivots, task_cells):
        links = part if links is None else links.unionByName(part)
    joined = store(components(links, "a", "b"), "class-components")
    # Every class that is linked, under the least document of its component.
    named = classes.select("digest", "doc_id").join(joined, F.col("digest") == F.col("node"))
    least_doc = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least_doc, "component").select(F.col("digest").alias("_class"), "component_id")
    own = classes.select(F.col("digest").alias("_own"), F.col("doc_id").alias("_least"))
    found = sets.join(own, F.col("digest") == F.col("_own"), "left").join(named, F.col("digest") == F.col("_class"), "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("_least"))
    return found.select(
        "doc_id",
        "n_shingles",
        F.col("digest").alias("class"),
        F.coalesce("component_id", alone, F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that have the least doc_id of their component, unchanged: one document of each group.

    Of rows that repeat a doc_id and its text one stays; different texts under one doc_id all stay if it is the least. Rows
    without doc_id stay, one of each text, if any of them is linked with no row that has one.
    """
    found = join_documents(docs, **options).select("doc_id", "component_id")
    # A row that has no words is linked with nothing, so it is always its own component.
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = least.groupBy(F.col("doc_id").alias("_stay_id")).agg(F.count(F.lit(1)).alias("_stay_rows"))
    stay = store(stay, "least-documents")
    # The ids grow with the documents, so they are joined in the same way at every size.
    kept = docs.join(stay.hint("merge"), docs["doc_id"].cast("bigint").eqNullSafe(F.col("_stay_id")))
    names = [docs[c] for c in docs.columns]
    if stay.where("_stay_rows > 1").isEmpty():
        return kept.select(*names)
    once = kept.where("_stay_rows = 1").select(*names)
    return once.union(kept.where("_stay_rows > 1").dropDuplicates(["_stay_id", "text"]).select(*names))
