"""N-gram Jaccard join with a token-group matrix.

1. One pass over the texts makes each set, its digest and its signatures;
   texts with equal sets form one class, and one row stands for each.
2. Each set is cut into parts by ranges of the shingles' hashes, more parts
   than two linked sets can differ in, so linked sets agree in several whole
   parts.  A set that shares fewer parts than its links need with all others
   together has none and drops out.  What still shares parts is one family; families hold all links.
3. Within a family, sets are blocked; each block lists groups of similar sets
   with the union of their tokens.  A query set's overlap with a group's union bounds its overlap
   with every member, and only groups that pass are opened.
4. Blocks are joined within themselves first, then by one set of each crowd in
   them.  Only sets outside of a family's main component still meet all of the family.
5. Links found leave each block as a forest; components end the work.

No pair is emitted per group: shared parts give one row to their family's leader, blocks give
one row per set.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, lru_cache, reduce
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.components import Forest, components, groups
from lexquarry.llm.prefilter import split_by_ids
from lexquarry.llm.shingles import mixed, shingle_sets
from lexquarry.llm.wordbpe import ranges, slices, small_batches, tidy
from lexquarry.plans.storage import drop_written, written, written_bytes

#: Sets and tokens that one side of a block holds at most, on average.
BLOCK_SETS, BLOCK_TOKENS = 4096, 2_000_000
#: Sets that are linked in one block and send one of them to meet the other blocks' crowds.
CROWD = 16
GROUP = 16
SEEDS = 4
#: Bytes of text that a task makes sets of at a time.
PART = 1_000_000
#: Signatures are shuffled in rounds, one for so many bytes of them, in as many as this at most: a round is a part of all, whatever the input.
ROUND_BYTES, ROUNDS = 32 << 20, 4
#: Bytes of a signature that are kept; those that agree by chance only make a family larger.
KEPT = 6


@dataclass(frozen=True)
class Likeness:
    """Sets link when the size of their intersection is at least ``share`` of that of their union."""

    share: Fraction

    def need(self, a, b):
        """The least intersection with which sets of sizes a and b link."""
        p, q = self.share.numerator, self.share.denominator
        return -(-p * (a + b) // (p + q))

    def apart(self, a: int) -> int:
        """The most that a set of size a and a linked one no smaller can differ in; a tight bound for large sets."""
        p, q = self.share.numerator, self.share.denominator
        top = floor(a / self.share)
        if a > 64:
            return (a + top) * (q - p) // (q + p)
        return max(a + b - 2 * self.need(a, b) for b in range(a, top + 1))

    @cached_property
    def small(self) -> int:
        """Pairs whose lesser set has at most so many tokens differ in two or fewer."""
        a = 1
        while self.apart(a + 1) <= 2:
            a += 1
        return a

    def bottom(self, level: int) -> int:
        """The least size of a level; linked sets are on the same or neighbouring levels."""
        return ceil((self.small + 1) / self.share**level)

    def level(self, sizes: np.ndarray) -> np.ndarray:
        bottoms = [self.bottom(0)]
        while bottoms[-1] <= sizes.max(initial=0):
            bottoms.append(self.bottom(len(bottoms)))
        return np.searchsorted(bottoms, sizes, side="right") - 1

    @lru_cache
    def parts(self, level: int) -> tuple[int, int]:
        """(parts of the sets matched on a level, how many of them agree at least)."""
        low, high = self.bottom(level), self.bottom(level + 1)
        most = max(self.apart(a) for a in range(max(low, high - 8), high))
        spare = 2 + most // 16
        return most + spare, spare


def small_signatures(tokens: np.ndarray, like: Likeness) -> list[int]:
    """The set, and the set without any one or two tokens, as far as a link can need them."""
    n, total = len(tokens), int(tokens.sum(dtype=np.uint64))
    sums = [(total, n)]
    for out in (1, 2):
        if out < n and (like.need(n, n - out) <= n - out or (out == 1 and like.need(n, n) <= n - 1)):
            sums += [(total - sum(map(int, c)), n - out) for c in combinations(tokens, out)]
    return [s * 31 + 7 * size & 0xFFFFFFFFFFFFFFFF for s, size in sums]


def signatures(tokens: np.ndarray, bounds: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, tag, set number) rows of a batch of sets.

    Rows of a tag's upper bits belong together: linked sets share at least as
    many signatures of one such kind as the lower eight bits of either's tag say.
    """
    sizes = np.diff(bounds)
    made, tags, owners = [], [], []

    def add(signature: np.ndarray, tag: np.ndarray, owner: np.ndarray) -> None:
        made.append(signature)
        tags.append(tag)
        owners.append(owner)

    for i in np.flatnonzero((sizes > 0) & (sizes <= floor(like.small / like.share))):
        own = small_signatures(mixed(tokens[bounds[i] : bounds[i + 1]]), like)
        add(np.array(own, np.uint64) ^ np.uint64(0x5555), np.ones(len(own), np.int64), np.full(len(own), i))
    levels = like.level(sizes)
    work = [(own, levels[own] - down) for down in (0, 1) for own in [np.flatnonzero(levels - down >= 0)]]
    for owner, level in work:
        for seed in range(SEEDS):
            if not len(owner):
                break
            size = sizes[owner]
            parts_of = [like.parts(v) for v in range(int(level.max()) + 1)]
            parts = np.array([p for p, _ in parts_of])[level]
            spare = np.array([s for _, s in parts_of])[level]
            ends = np.cumsum(size)
            row = np.repeat(np.arange(len(owner)), size)
            at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(bounds[owner], size)
            token = tokens[at]
            if seed:  # another way to cut, for the few sets with many empty parts
                token = mixed(token + np.uint64(seed))
                order = np.lexsort((token, row))
                token = token[order]
            part = ((token >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            cut = np.ones(len(part), bool)
            cut[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
            cut = np.flatnonzero(cut)
            sums = np.add.reduceat(mixed(token ^ np.uint64(0xABCDEF)), cut)
            place = (level[row[cut]].astype(np.uint64) << np.uint64(40)) + (part[cut].astype(np.uint64) << np.uint64(4)) + np.uint64(seed)
            empty = parts - np.bincount(row[cut], minlength=len(owner))
            need = np.clip(spare - empty, 1, 255)  # parts that are empty in both sets agree without a signature
            kind = 1 + level * (SEEDS + 1) + seed
            add(mixed(sums ^ mixed(place)), (kind << 8 | need)[row[cut]], owner[row[cut]])
            again = empty >= spare  # two such sets might agree in empty parts alone
            owner, level = owner[again], level[again]
        if len(owner):
            add(mixed(level.astype(np.uint64) + np.uint64(0xE0E0E0)), (1 + level * (SEEDS + 1) + SEEDS) << 8 | 1, owner)
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(made), np.concatenate(tags), np.concatenate(owners)


def link_block(left: list[np.ndarray], right: list[np.ndarray] | None, like: Likeness, forest: Forest) -> tuple[int, int]:
    """Join positions of linked sets in ``forest``: left among itself, or left with right; (groups opened, groups skipped).

    Sets are taken in groups that share their rarest token, of similar size.  For each query set
    the overlap with the token union of every group comes first; a group is opened when the
    bound reaches what its members need, and closed to a query that its members are joined with already.
    """
    sets = left + (right or [])
    shift = len(left) if right is not None else 0
    members = np.arange(shift, len(sets))
    flat = np.concatenate(sets)
    value, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shared = seen[code] > 1  # a token of one set alone is in no intersection
    rank = np.cumsum(seen > 1) - 1
    columns = [rank[code[starts[i] : starts[i + 1]][shared[starts[i] : starts[i + 1]]]] for i in range(len(sets))]
    rarest = np.full(len(sets), -1)  # the token that the fewest sets have, so that what it stands for is in one group
    often = seen[seen > 1]
    for m in members:
        if len(columns[m]):
            rarest[m] = columns[m][np.argmin(often[columns[m]])]
    order = members[np.lexsort((members, sizes[members], rarest[members]))]
    width = int((seen > 1).sum())
    wide = min(GROUP, max(1, len(order) // 4))
    group_of = np.arange(len(order)) // wide
    n_groups = int(group_of[-1]) + 1
    step = 1024
    n_left = len(left)
    bound = np.zeros((n_left, n_groups), np.float32)
    cells = [(np.repeat(np.arange(len(ids)), [len(columns[i]) for i in ids]), np.concatenate([columns[i] for i in ids]) if len(ids) else np.zeros(0, np.int64)) for ids in (list(range(n_left)), order.tolist())]
    for at in range(0, width, step):
        part = min(step, width - at)
        query = np.zeros((n_left, part), np.float32)
        union = np.zeros((n_groups, part), np.float32)
        for target, (row, col), fold in ((query, cells[0], None), (union, cells[1], group_of)):
            inside = (col >= at) & (col < at + part)
            target[row[inside] if fold is None else fold[row[inside]], col[inside] - at] = 1
        bound += query @ union.T
    least = np.array([sizes[order[g * wide : (g + 1) * wide]].min() for g in range(n_groups)])
    mark, opened = np.zeros(width, bool), 0
    for x in range(n_left):
        open_groups = np.flatnonzero(bound[x] >= np.maximum(like.need(sizes[x], least), float(like.share) * sizes[x]) - 1e-3)
        opened += len(open_groups)
        if not len(open_groups):
            continue
        mark[columns[x]] = True
        root = forest.root(x)
        for g in open_groups:
            for y in order[g * wide : (g + 1) * wide].tolist():
                if y == x or (right is None and y < x) or forest.root(y) == root:
                    continue
                need = like.need(int(sizes[x]), int(sizes[y]))
                if min(len(columns[y]), len(columns[x])) >= need and np.count_nonzero(mark[columns[y]]) >= need:
                    forest.join(x, y)
                    root = forest.root(x)
        mark[columns[x]] = False
    return opened, n_left * n_groups - opened


def jaccard_components(docs: DataFrame, size: int = 4, share: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A null, empty or blank text has no shingles and links with nothing.
    Repeated rows are linked through their equal sets; a null id gets its own
    result but can't name a component.  An empty table gives an empty result;
    other columns are ignored.
    """
    like = Likeness(Fraction(share))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)

    @tidy
    def measure(batches):
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, most=PART)):
            tokens, bounds = shingle_sets(batch.column(1), size)
            filled = np.flatnonzero(np.diff(bounds) > 0)
            digest = []
            for salt in (1, 2):
                sums = np.zeros(batch.num_rows, np.uint64)
                if len(filled):
                    sums[filled] = np.add.reduceat(mixed(tokens * np.uint64(2 * salt + 1) + np.uint64(salt)), bounds[:-1][filled])
                digest.append(sums.view(np.int64))
            fresh = np.zeros(batch.num_rows, bool)  # a set that a task meets again is signed once, by a row that has an id
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for n in filled[named[filled]].tolist():
                fresh[n] = digest[0][n] not in seen
                seen.add(int(digest[0][n]))
            some = np.flatnonzero(fresh)
            held = np.diff(bounds)[some]
            signature, tag, owner = signatures(tokens[ranges(bounds[:-1][some], held)], np.concatenate([[0], np.cumsum(held)]), like)
            order = np.lexsort((tag, owner))
            signature, tag, owner = signature[order], tag[order], owner[order]
            cut = np.ones(len(tag), bool)
            cut[1:] = (tag[1:] != tag[:-1]) | (owner[1:] != owner[:-1])
            cut = np.flatnonzero(cut)
            ends = np.append(cut[1:], len(tag))
            short = signature.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]
            kinds: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n, t, a, e in zip(some[owner[cut]].tolist(), tag[cut].tolist(), cut.tolist(), ends.tolist(), strict=True):
                kinds[n].append({"tag": t, "sigs": short[a:e].tobytes()})
            signed = pa.array(kinds, pa.list_(pa.struct([("tag", pa.int32()), ("sigs", pa.binary())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), *map(pa.array, digest), signed], names=["doc_id", "n_shingles", "h1", "h2", "signed"])

    schema = "doc_id long, n_shingles long, h1 long, h2 long, signed array<struct<tag:int,sigs:binary>>"
    made = written(rows.mapInArrow(measure, schema), "sets")
    key = ["n_shingles", "h1", "h2"]
    sets = written(made.drop("signed"), "shapes")
    classes = written(sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    rounds = min(ROUNDS, -(-written_bytes(made) // ROUND_BYTES))
    family = families(made.filter("doc_id is not null and size(signed) > 0").select("h1", "signed"), max(1, rounds))
    drop_written(made)  # by far the largest table of the join
    placed = written(family.withColumnRenamed("node", "h1").join(classes, "h1").select(F.col("rep").alias("doc_id"), "n_shingles", F.col("component").alias("family")), "families")
    near = components(block_links(rows, placed, size, like))
    named = classes.join(near.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    # A hot class is one key of the narrow side, which is written so that AQE can split the other one.
    return sets.join(written(named, "named"), key, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def families(signed: DataFrame, rounds: int = 1) -> DataFrame:
    """(node, component) of the digests ``h1`` whose sets may be linked with another one.

    Most signatures are of one set alone; each round shuffles a share of all and keeps those that two sets have.
    """

    def spelled(round_: int):
        @tidy
        def run(batches):
            for rows in spell(batches):
                if rounds > 1:
                    rows = rows.filter(pa.array(rows.column(0).to_numpy().view(np.uint64) % np.uint64(rounds) == round_))
                yield rows

        return run

    def spell(batches):
        for batch in batches:
            node, kinds = batch.column(0).to_numpy(), batch.column(1)
            flat = kinds.flatten()
            count = pc.list_value_length(kinds).to_numpy(zero_copy_only=False)
            tag, sigs = flat.field(0).to_numpy(), flat.field(1)
            size = pc.binary_length(sigs).to_numpy() // KEPT
            short = np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, KEPT)
            every = np.zeros((len(short), 8), np.uint8)
            every[:, :KEPT] = short
            every = every.view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(np.repeat(node, count), size)), pa.array(np.repeat(tag, size))], names=["sig", "node", "tag"])

    @tidy
    def shared(batches):
        """The rows, sorted by signature and node, of signatures that two nodes have; one row is held back."""
        held, follows = None, False
        for batch in batches:
            sig, node, tag = (batch.column(k).to_numpy() for k in range(3))
            if held is not None:
                sig, node, tag = (np.concatenate([[h], x]) for h, x in zip(held, (sig, node, tag), strict=True))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, tag = sig[new], node[new], tag[new]
            same = np.zeros(len(sig) + 1, bool)
            same[0], same[1:-1] = follows, sig[1:] == sig[:-1]
            live = np.flatnonzero((same[:-1] | same[1:])[:-1])
            held, follows = (sig[-1], node[-1], tag[-1]), bool(same[-2])
            yield pa.RecordBatch.from_arrays([pa.array(x[live]) for x in (sig, node, tag)], names=["sig", "node", "tag"])
        if held is not None and follows:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["sig", "node", "tag"])

    rows = "sig long, node long, tag int"
    parts = []
    for n in range(rounds):
        live = signed.mapInArrow(spelled(n), rows).repartition("sig").sortWithinPartitions("sig", "node")
        parts.append(written(live.mapInArrow(shared, rows), "shared"))
    live = reduce(DataFrame.unionByName, parts)
    # Narrow sides are written, so that AQE can split hot signatures.
    enough = written(live.groupBy("node", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.col("tag").bitwiseAND(255)).drop("n"), "enough")
    kept = written(live.join(enough, ["node", "tag"], "left_semi").select("sig", "node"), "kept")
    drop_written(*parts, enough)
    lead = written(kept.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").drop("last"), "leads")
    live = kept.join(lead, "sig")
    return components(live.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())


def block_links(rows: DataFrame, family: DataFrame, size: int, like: Likeness) -> DataFrame:
    """Links (a, b) between standing rows (doc_id, n_shingles, family) that span every component of similar sets."""

    def counted(sets: DataFrame, *by: str) -> DataFrame:
        """How many blocks the sets of each family need; written, so that AQE can split a hot family's rows."""
        need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_TOKENS))
        return written(sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), need.cast("int").alias("blocks")), "blocks")

    block = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), "blocks").cast("int")
    placed = written(family.join(counted(family, "family").filter("n > 1").drop("n"), "family").withColumn("block", block(0)), "placed")

    @tidy
    def tokens_of(batches):
        for batch in (part for whole in batches for part in slices(whole, most=PART)):
            tokens, bounds = shingle_sets(batch.column(1), size)
            packed = pa.array([tokens[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "tokens"])

    # Only sets that may be in a family are made again and shuffled; the texts themselves are not.
    may, _ = split_by_ids(rows, placed)
    chosen = may.mapInArrow(tokens_of, "doc_id long, tokens binary").join(placed.hint("shuffle_hash"), "doc_id")
    chosen = written(chosen.dropDuplicates(["doc_id"]), "tokens")  # repeated rows of an id hold one set

    @tidy
    def link(batches):
        """Links of each cell: its left sets with the right ones, or with one another where there is no right side; sets joined already (by ``known``) are left alone."""
        for table in groups(batches, ["family", "i", "j"]):
            if table.num_rows < 2:
                continue
            docs, known, right = (table.column(c).to_numpy() for c in ("doc_id", "known", "right"))
            order = np.lexsort((docs, right))
            docs, known, split = docs[order], known[order], int((right == 0).sum())
            column = table.column("tokens")
            sets = [np.frombuffer(column[int(k)].as_buffer(), np.uint64) for k in order]
            forest = Forest(len(sets))
            first = {}
            for n, c in enumerate(known.tolist()):
                forest.join(first.setdefault(c, n), n)
            if split == len(sets):
                link_block(sets, None, like, forest)
            elif split:
                link_block(sets[:split], sets[split:], like, forest)
            root = forest.roots()
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[moved]), pa.array(docs[root[moved]])], names=["a", "b"])

    cell = ["family", "i", "j"]

    def linked(held: DataFrame) -> DataFrame:
        """Links of cells (family, i, j, right, doc_id, known, tokens)."""
        return held.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(link, "a long, b long")

    zero = F.lit(0)
    own = chosen.select("family", F.col("block").alias("i"), zero.alias("j"), zero.alias("right"), "doc_id", F.col("doc_id").alias("known"), "tokens")
    links = written(linked(own), "links-own")
    several, crowded = placed.filter("blocks > 1"), chosen.filter("blocks > 1").select("doc_id", "tokens")
    if several.isEmpty():
        return links

    def within(sets: DataFrame, found: DataFrame) -> DataFrame:
        """``sets`` with the component that each has by now."""
        return sets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("known", F.coalesce("component", "doc_id")).drop("component")

    crowds = within(several, components(links)).groupBy("family", "block", "known").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "n_shingles")).alias("of"))
    crowds = crowds.filter(F.col("n") >= CROWD).select("family", "of.doc_id", "of.n_shingles")
    meet = crowds.join(counted(crowds, "family").drop("n"), "family").select("family", block(1).alias("i"), zero.alias("j"), zero.alias("right"), "doc_id", F.col("doc_id").alias("known"))
    links = written(links.unionByName(linked(crowded.join(meet, "doc_id"))), "links-met")
    state = written(within(several, components(links)), "state")
    most = state.groupBy("family", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("known", F.struct("n", -F.col("known"))).alias("main"))
    outer = state.join(written(most, "most"), "family").filter("known <> main").drop("main")
    outer = written(outer.drop("blocks").join(counted(outer, "family").drop("n"), "family").withColumn("at", block(2)), "outer")
    ways = written(outer.select("family", F.col("blocks").alias("outer_blocks")).distinct(), "ways")
    every = F.explode(F.sequence(zero, F.col("outer_blocks") - 1)).alias("i")
    right = state.join(ways, "family").select("family", every, F.col("block").alias("j"), F.lit(1).alias("right"), "doc_id", "known")
    sides = written(state.select("family", F.col("blocks").alias("state_blocks")).distinct(), "sides")
    left = outer.join(sides, "family").select("family", F.col("at").alias("i"), F.explode(F.sequence(zero, F.col("state_blocks") - 1)).alias("j"), zero.alias("right"), "doc_id", "known")
    return links.unionByName(linked(crowded.join(left.unionByName(right), "doc_id")))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table: four-word shingles, 0.85 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
