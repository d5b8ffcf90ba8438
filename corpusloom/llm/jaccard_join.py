"""N-gram Jaccard self-join by partitioning the universe of shingles.

A set of shingles is hashed into segments. Two sets of sizes a and b with a similarity of num/den or more
differ in at most H elements, a bound that follows from the sizes, so by the pigeonhole principle some
segments are equal or differ by one element. Sizes are cut into bands; a band's scheme serves the pairs
whose larger set lies in it, so a set is indexed under its own band and, where it is large enough to meet
the next band, under that one too.

Per band the cheaper of two layouts is taken: H + 1 + spare segments whose subsets are indexed as they are,
or half as many, longer segments whose subsets are indexed with all their one-deletion neighbours. Per set,
segments with too few elements to tell sets apart are skipped as long as the spare segments pay for them;
a set with more of them pays with one-deletion neighbours of its other segments instead.

Segments are allocated by what they cost, counted: a set can do without as many of its keys as it has segments
above the pigeonhole bound of its own size, its budget. Linked sets share more keys than either's budget.
* Keys of at most ``hottest`` sets are compared pair by pair; pairs that share too few are no candidates.
* A set whose keys of more sets (of common passages, of large groups of copies) lie within its budget does
  without them all. Any other set leaves out its most frequent ones up to its budget and joins the others
  in a star. All sets rank keys by the same counts, so the rarest key that two linked sets share is in both.
* A key of many sets in one task's texts is given to a local leader before the shuffle.

Candidates form families (connected components). Every link is verified exactly on whole sets: members are visited
from pivot to pivot and only compared to members that no link has reached yet. A family over a memory bound
is compared, in parallel, with a block of pivots at a time, until what is left lies in one component: a
group of near copies takes as many passes as it has strays, each linear in its size. Equal sets are one member.

Defined results: null and empty texts have no shingles, belong to themselves and link with nothing; rows without
an id keep their number of shingles, link with nothing and have no component (null); repeated
rows and ties meet in one component; an empty table gives an empty result; only the id and text columns are
read, so other columns cannot clash; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_batches, slices
from corpusloom.llm.common import cut, small_side
from corpusloom.llm.graph import components
from corpusloom.llm.shingles import U, mix, shingle_set, word_hashes

#: A band's largest size over its smallest.
BAND = 1.25
#: Weight of keys of short segments, which many sets share by chance, against the number of keys.
CHANCE = 50
#: Rows of a key beyond which its pairs are not looked at.
HOT = 16
#: Spare segments for frequent keys, as a share of the segments.
SPARE = 0.08
#: What a hot key of one task's texts, a local leader's key, and keys by the power of two of their rows are ranked.
PROXY, LOCAL, COUNTED, POWERS = 1, 2, 3, 9
#: Hot keys that a task remembers.
REMEMBERED_KEYS = 100_000
#: Elements of a family that one task holds at once (8 bytes each).
BLOCK_ELEMENTS = 500_000


@dataclass(frozen=True)
class Scheme:
    """How sets are indexed for the pairs whose larger set is in one band of sizes."""

    band: int
    most: int  # elements in which two linked sets can differ
    segments: int
    spare: int
    least: int  # elements of a segment that tells sets apart
    deletions: bool


class Schemes:
    """All bands for the threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    @lru_cache(maxsize=None)
    def bound(self, band: int) -> int:
        """Least size of a band; bands cover all sizes from 1 on."""
        if band == 0:
            return 1
        low = self.bound(band - 1)
        return max(low + 1, math.ceil(low * BAND), -(-low * self.den // self.num))

    @lru_cache(maxsize=None)
    def scheme(self, band: int) -> Scheme:
        low, high = self.bound(band), self.bound(band + 1) - 1
        # |r ^ s| = a + b - 2 i with i * (num + den) >= num * (a + b)
        most = 2 * high * (self.den - self.num) // (self.den + self.num)
        best, least_cost = None, math.inf
        for needed, deletions in ((most + 1, False), (-(-(most + 1) // 2), True)):
            spare = 1
            for _ in range(8):  # enough spare segments for the short ones of nearly all sets of the band
                mean = low / (needed + spare)
                least = (1 if mean < 5 else 2 if mean < 8 else 3) + deletions
                short = (needed + spare) * sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
                spare = max(1, math.ceil(short + 2 * short**0.5 + SPARE * needed))
                if spare > needed:
                    break
            segments = needed + spare
            mean = high / BAND**0.5 / segments
            # Keys written, and how likely segments are too short to tell sets apart.
            cost = (high if deletions else 0) + segments + CHANCE * segments * math.exp(-mean)
            if cost < least_cost:
                best, least_cost = Scheme(band, most, segments, spare, least, deletions), cost
        return best

    @lru_cache(maxsize=4096)
    def apart(self, band: int, size: int) -> int:
        """Elements in which a set of this size and a set that it links to in this band can differ."""
        return (size + min(self.bound(band + 1) - 1, size * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=4096)
    def of(self, size: int) -> tuple[Scheme, ...]:
        band = 0
        while self.bound(band + 1) <= size:
            band += 1
        found = [self.scheme(band)]
        if size * self.den >= self.bound(band + 1) * self.num:
            found.append(self.scheme(band + 1))
        return tuple(s for s in found if s.most > 0)  # else only equal sets link


def budget_of(shingles: np.ndarray, schemes: Schemes) -> int:
    """How many keys the set can do without in each of its bands; -1: it needs them all."""
    found = []
    for s in schemes.of(len(shingles)):
        sizes = np.bincount((shingles >> U(11)) % U(s.segments), minlength=s.segments)
        spare = int((sizes >= s.least).sum()) - schemes.apart(s.band, len(shingles)) - 1
        found.append(-1 if s.deletions else max(spare, -1))
    return min(found, default=0)


def indexed(shingles: np.ndarray, schemes: Schemes) -> list[tuple[int, int, np.ndarray]]:
    """(band, budget, keys) of a set (sorted, distinct, uint64). Of its keys in a band a set can do without
    ``budget`` ones and still shares one of the others with every set it links to; -1: it needs them all."""
    out = []
    element = mix(shingles ^ U(0x5851F42D4C957F2D))
    for s in schemes.of(len(shingles)):
        segment = (shingles >> U(11)) % U(s.segments)
        order = np.argsort(segment, kind="stable")
        by = segment[order]
        starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        elements = element[order]
        sums = np.add.reduceat(elements, starts)
        sizes = np.diff(np.append(starts, len(by)))
        salt = mix((by[starts] << U(20)) + U(s.band * 2 + 2))
        rich = sizes >= s.least
        n_rich = int(rich.sum())
        apart = schemes.apart(s.band, len(shingles))
        budget = n_rich - apart - 1
        if not s.deletions and budget >= 0:
            out.append((s.band, budget, mix(sums[rich] + salt[rich])))
            continue
        wide = sizes >= s.least - 1
        shift = np.repeat(salt, sizes)
        minus = np.repeat(sums, sizes) - elements + shift
        keys = [mix(sums[wide] + salt[wide]), mix(minus[np.repeat(rich, sizes)])]
        if 2 * n_rich < apart + 1:
            # Too few segments of enough elements: all the others as well, among sets in the same position.
            flag = U(0xA24BAED4963EE407)
            keys += [mix(sums[~wide] + salt[~wide] + flag), mix(minus[~np.repeat(rich, sizes)] + flag)]
            empty = np.setdiff1d(np.arange(s.segments, dtype=U), by[starts], assume_unique=True)
            keys.append(mix(mix((empty << U(20)) + U(s.band * 2 + 2)) + flag))
        out.append((s.band, -1, np.unique(np.concatenate(keys))))
    return out


def keys_of(shingles: np.ndarray, schemes: Schemes) -> np.ndarray:
    """All keys under which a set is indexed."""
    found = [k for _, _, k in indexed(shingles, schemes)]
    return np.unique(np.concatenate(found)) if found else shingles[:0]


def _sets_of(batch: pa.RecordBatch, shingle_words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch whose last column is the text (bytes), with the sets of their texts."""
    words = word_hashes()
    for part in slices(batch):
        yield part, [shingle_set(words.words(t or b""), shingle_words) for t in part.column(part.num_columns - 1).to_pylist()]


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _describe(shingle_words: int, schemes: Schemes):
    """(id, text) to (id, n, hi, lo, budget): the size and the 128-bit digest of the set, and how many of its keys
    it can do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch, shingle_words):
                digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                two = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                n = pa.array([len(s) for s in sets], pa.int64())
                budget = pa.array([budget_of(s, schemes) if len(s) else 0 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), n, pa.array(two[:, 0]), pa.array(two[:, 1]), budget], names=["id", "n", "hi", "lo", "budget"]
                )

    return run


class _LocalLeaders:
    """Keys of more than ``hottest`` sets of a task, and for each the set that stands for those after the first ones."""

    def __init__(self, hottest: int):
        self.hottest = hottest
        self.keys, self.leaders = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def split(self, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, id, to, led): rows of keys, ``led`` where they are of the set that leads (``to`` is its id), and rows that
        tell another set's leader ``to`` under a key of the set's own."""
        out = []
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            out.append((ids[known], self.leaders[at[known]]))
            key, ids = key[~known], ids[~known]
        order = np.argsort(key, kind="stable")
        key, ids = key[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        hot = sizes > self.hottest
        place = np.arange(len(key)) - np.repeat(starts, sizes)
        leader = ids[np.repeat(starts, sizes)] if len(key) else ids
        told = np.repeat(hot, sizes) & (place > self.hottest)
        out.append((ids[told], leader[told]))
        leads = np.repeat(hot, sizes) & (place == 0)
        if hot.any() and len(self.keys) < REMEMBERED_KEYS:
            keys, leaders = np.append(self.keys, key[starts[hot]]), np.append(self.leaders, ids[starts[hot]])
            by = np.argsort(keys)
            self.keys, self.leaders = keys[by], leaders[by]
        tell_ids, tell_to = (np.concatenate(c) for c in zip(*out, strict=True))
        own = mix(tell_ids.astype(U) + U(0x9E3779B97F4A7C15)).view(np.int64)
        return (
            np.concatenate([key[~told], own]),
            np.concatenate([ids[~told], tell_ids]),
            np.concatenate([ids[~told], tell_to]),
            np.concatenate([leads[~told], np.ones(len(tell_ids), dtype=bool)]),
        )


def _keys(shingle_words: int, schemes: Schemes, hottest: int):
    """(id, text) to (key, id, to): the keys of sets (``to`` is null, or the id where the set leads others of its task)
    and sets' leaders ``to``, under keys of the sets' own. Of equal sets in a slice the least id is indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _LocalLeaders(hottest)
        for batch in batches:
            for part, sets in _sets_of(batch, shingle_words):
                least: dict[bytes, tuple[int, np.ndarray]] = {}
                for i, s in zip(part.column(0).to_pylist(), sets, strict=True):
                    if len(s):
                        mark = xxhash.xxh3_128_digest(s.tobytes())
                        if mark not in least or i < least[mark][0]:
                            least[mark] = i, s
                keys, ids = [], []
                for i, s in least.values():
                    for _, _, k in indexed(s, schemes):
                        keys.append(k)
                        ids.append(np.full(len(k), i, dtype=np.int64))
                if keys:
                    key, i, to, led = leaders.split(np.concatenate(keys).view(np.int64), np.concatenate(ids))
                    columns = [pa.array(key), pa.array(i), pa.array(to, mask=~led)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "to"])

    return run


def _runs(hottest: int):
    """Rows (key, id, to) sorted by key and id to (a, b, n, rank). Rank 0: a pair shares n keys of at most ``hottest``
    rows, b before a. Else a set a has n keys that b leads: of its task (LOCAL), as the leader of its task
    (PROXY), or of more than ``hottest`` rows, the more the higher the rank."""
    most = hottest << (POWERS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros(0, dtype=np.int64)] * 3
        going_key, going_leader = None, 0
        for batch in _then_none(batches):
            out = []
            now = waiting
            if batch is not None:
                key, ids = (c.to_numpy() for c in batch.columns[:2])
                led = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                to = batch.column(2).fill_null(0).to_numpy()
                told = led & (to != ids)
                out.append(np.stack([ids[told], to[told], np.full(int(told.sum()), LOCAL)], axis=1))
                now = [np.concatenate([w, c[~told]]) for w, c in zip(waiting, (key, ids, led.astype(np.int64)), strict=True)]
            key, ids, led = now
            if len(key):
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sizes = np.diff(np.append(starts, len(key)))
                leader = ids[starts]
                rank = COUNTED + np.minimum(np.ceil(np.log2(sizes / hottest)).astype(np.int64), POWERS)
                hot = sizes > hottest
                if going_key is not None and key[0] == going_key:
                    leader[0], rank[0], hot[0] = going_leader, COUNTED + POWERS, True
                done = np.ones(len(sizes), dtype=bool)
                going = batch is not None and rank[-1] == COUNTED + POWERS and hot[-1]
                if batch is not None and not going:
                    done[-1] = False  # may go on in the next batch
                going_key, going_leader = (key[-1], leader[-1]) if going else (None, 0)
                row_hot, row_done = np.repeat(hot, sizes), np.repeat(done, sizes)
                waiting = [c[~row_done] for c in now]
                cold, met = row_done & ~row_hot, row_done & row_hot
                for d in range(1, hottest):
                    at = np.flatnonzero((key[d:] == key[:-d]) & cold[d:] & (ids[d:] != ids[:-d]))
                    out.append(np.stack([ids[d:][at], ids[:-d][at], np.zeros(len(at), dtype=np.int64)], axis=1))
                ranks = np.where(led[met] == 1, PROXY, np.repeat(rank, sizes)[met])
                out.append(np.stack([ids[met], np.repeat(leader, sizes)[met], ranks], axis=1))
            if sum(map(len, out)):
                found, n = np.unique(np.concatenate(out), axis=0, return_counts=True)
                yield _longs(["a", "b", "n", "rank"], found[:, 0], found[:, 1], n, found[:, 2])

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def linked_groups(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(id, least id of its component) of all members but those least ones, by exact comparison of sets.

    Linked sets share one of their rarest n - ceil(n num / den) + 1 elements, in the order of how many members
    have an element; only members that do are compared, whole sets with whole sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    universe, element = np.unique(np.concatenate(sets), return_inverse=True)
    spans = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = np.bincount(element, minlength=len(universe))
    rank = np.empty(len(universe), dtype=np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(universe))
    order = np.lexsort((rank[element], owner))
    rare = np.arange(len(order)) - spans[owner] < (sizes - -(-sizes * num // den) + 1)[owner]
    rare &= held[element[order]] > 1
    rare_element, rare_owner = element[order][rare], owner[rare]
    del order, rare, rank, owner
    mine = np.concatenate([[0], np.cumsum(np.bincount(rare_owner, minlength=len(sets)))])
    by = np.argsort(rare_element, kind="stable")
    holders = rare_owner[by]
    at = np.searchsorted(rare_element[by], np.arange(len(universe) + 1))

    waiting = np.ones(len(sets), dtype=bool)
    flag = np.zeros(len(universe), dtype=bool)
    out: list[tuple[int, int]] = []
    for start in range(len(sets)):
        if not waiting[start]:
            continue
        waiting[start] = False
        stack, members = [start], [start]
        while stack:
            p = stack.pop()
            met = [holders[at[e] : at[e + 1]] for e in rare_element[mine[p] : mine[p + 1]].tolist()]
            if not met:
                continue
            met = np.concatenate(met)
            met = np.unique(met[waiting[met]])
            near = (den * np.minimum(sizes[met], sizes[p]) >= num * np.maximum(sizes[met], sizes[p])) if len(met) else met
            own = element[spans[p] : spans[p + 1]]
            flag[own] = True
            for q in met[near].tolist() if len(met) else ():
                common = np.count_nonzero(flag[element[spans[q] : spans[q + 1]]])
                if common * (num + den) >= num * (sizes[p] + sizes[q]):
                    waiting[q] = False
                    stack.append(q)
                    members.append(q)
            flag[own] = False
        if len(members) > 1:
            root = int(ids[members].min())
            out += [(int(i), root) for i in ids[members] if i != root]
    return out


class _Roots(dict):
    """A union-find forest whose roots are least members."""

    def __missing__(self, x: int) -> int:
        self[x] = x
        return x

    def find(self, x: int) -> int:
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.find(x), self.find(y)))
        self[y] = x
        return x != y


def _sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch, shingle_words):
                raw = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], raw], names=["id", "family", "elements"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], start: Callable[[], Callable]) -> Iterator[pa.RecordBatch]:
    """Rows (group, *rest), the groups one after another: ``start()`` makes a group's function of a row, which gives links
    (a, b), and of nothing at the group's end."""
    now, take = None, None
    for batch in _then_none(batches):
        links: list[tuple[int, int]] = []
        for part in slices(batch) if batch is not None else ():
            for group, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if take is None or group != now:
                    links += take() if take else []
                    now, take = group, start()
                links += take(*row)
        if batch is None and take:
            links += take()
        if links:
            a, b = zip(*links, strict=True)
            yield _longs(["a", "b"], a, b)


def _verify(num: int, den: int):
    """Rows (family, id, elements), the families one after another, to links."""

    def start() -> Callable:
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def take(i: int | None = None, raw: bytes | None = None) -> list[tuple[int, int]]:
            if raw is not None:
                ids.append(i)
                sets.append(np.frombuffer(raw, dtype=U))
                return []
            return linked_groups(np.array(ids, dtype=np.int64), sets, num, den) if len(ids) > 1 else []

        return take

    return lambda batches: _grouped(batches, start)


def _against(num: int, den: int):
    """Rows (group, member, id, elements), the groups one after another and in each the pivots (member is false) first,
    to links that join what links between its members and its pivots join."""

    def start() -> Callable:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        roots = _Roots()
        index: list = []

        def first() -> list[tuple[int, int]]:
            universe, element = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            by = np.argsort(element, kind="stable")
            index.extend((universe, owner[by], np.searchsorted(element[by], np.arange(len(universe) + 1)), np.array([len(s) for s in sets])))
            return [x for x in linked_groups(np.array(ids, dtype=np.int64), sets, num, den) if roots.join(*x)]

        def take(member: bool | None = None, i: int | None = None, raw: bytes | None = None) -> list[tuple[int, int]]:
            if member is None:
                return first() if sets and not index else []
            if not member:
                ids.append(i)
                sets.append(np.frombuffer(raw, dtype=U))
                return []
            links = [] if index else first()
            universe, holders, at, sizes = index
            own = np.frombuffer(raw, dtype=U)
            k = np.minimum(np.searchsorted(universe, own), len(universe) - 1)
            k = k[universe[k] == own]
            if len(k):
                met = np.concatenate([holders[at[e] : at[e + 1]] for e in k.tolist()])
                common = np.bincount(met, minlength=len(sizes))
                for q in np.flatnonzero(common * (num + den) >= num * (sizes + len(own))).tolist():
                    if roots.join(i, ids[q]):
                        links.append((i, ids[q]))
            return links

        return take

    return lambda batches: _grouped(batches, start)


def _link_large(sets: DataFrame, num: int, den: int, block_elements: int) -> DataFrame:
    """(a, b) that join what the links inside large families join. ``sets`` is a cut table (id, family, elements).

    Each pass compares all members of a family with a block of pivots, drawn by hash from the members that are
    not yet in the family's largest component; a link has an end among them, or joins nothing new."""
    size = F.length("elements") / 8
    whole = cut(sets.groupBy("family").agg(F.sum(size).alias("weight")))
    waiting, links = cut(sets.groupBy("id", "family").agg(F.max(size).alias("n"))), None
    turn = 0
    while not waiting.isEmpty():
        turn += 1
        draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 1)
        left = waiting.groupBy("family").agg(F.sum("n").alias("left"), F.min(draw).alias("least"))
        share = F.lit(block_elements * float(2**63)) / F.col("left")
        pivots = cut(waiting.join(small_side(cut(left)), "family").where((draw <= share) | (draw == F.col("least"))).select("id", "family"))
        salts = F.greatest(F.lit(1), F.ceil(F.col("weight") / block_elements)).cast("int")
        groups = whole.join(small_side(cut(left.select("family"))), "family").select("family", salts.alias("salts"))
        groups = cut(groups)
        rows = sets.join(small_side(groups), "family")
        named = F.concat_ws("/", "family", "salt").alias("group")
        ahead = (
            rows.join(small_side(pivots), ["id", "family"])
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            .select(named, F.lit(False).alias("member"), "id", "elements")
        )
        after = (
            rows.join(small_side(pivots), ["id", "family"], "left_anti")
            .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
            .select(named, F.lit(True).alias("member"), "id", "elements")
        )
        both = ahead.union(after).repartition("group").sortWithinPartitions("group", "member", "id")
        found = map_batches(both, _against(num, den), "a long, b long")
        links = cut(found if links is None else links.union(found))
        waiting = waiting.join(small_side(pivots), ["id", "family"], "left_anti")
        of = cut(components(links))
        placed = cut(sets.select("id", "family", size.alias("n")).join(small_side(of), F.col("id") == F.col("node")).groupBy("family", "root").agg(F.sum("n").alias("n")))
        settled = placed.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
        inside = of.join(small_side(cut(settled)), "root").select(F.col("node").alias("id"), "family")
        waiting = cut(waiting.join(small_side(cut(inside)), ["id", "family"], "left_anti"))
    return links


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    num: int = 9,
    den: int = 10,
    block_elements: int = BLOCK_ELEMENTS,
    hottest: int = HOT,
) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the least id that links of similarity num/den or more reach."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schemes = Schemes(num, den)
    about = cut(map_batches(docs, _describe(shingle_words, schemes), "id long, n long, hi long, lo long, budget long"))
    unnamed = about.where("id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    docs, about = docs.where("id IS NOT NULL"), about.where("id IS NOT NULL")
    # Rows of equal sets, of which the least id stands for all; only sets that occur again are joined.
    full = about.where("n > 0")
    copied = cut(full.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    placed = full.join(small_side(copied), ["hi", "lo"], "left").select("id", "n", "budget", F.coalesce("rep", "id").alias("rep"))
    distinct = docs.join(small_side(cut(placed.where("id <> rep").select("id").distinct())), "id", "left_anti")

    level = cut(
        map_batches(distinct, _keys(shingle_words, schemes, hottest), "key long, id long, to long")
        .repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(_runs(hottest), "a long, b long, n long, rank long")
    )
    budgets = placed.where("id = rep").groupBy("id").agg(F.min("budget").alias("budget"), F.max("n").alias("n"))
    by_rank = [F.sum(F.when(F.col("rank") == r, F.col("n")).otherwise(0)) for r in range(1, COUNTED + POWERS + 1)]
    hot = cut(
        level.where("rank > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("hot"), F.array(*by_rank).alias("ranked"))
        .join(budgets, "id").select("id", "hot", "budget", "ranked")
    )
    # Linked sets share more keys than either's budget, and at most the lesser number of hot keys are hot.
    pairs = level.where("rank = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    side = lambda x: budgets.join(small_side(hot.select("id", "hot")), "id", "left").select(
        F.col("id").alias(x), F.col("budget").alias(f"budget_{x}"), F.coalesce("hot", F.lit(0)).alias(f"hot_{x}")
    )
    total = F.greatest("budget_a", "budget_b") + 1
    cold = total - F.least("hot_a", "hot_b")
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("shared") >= F.when(cold >= 1, cold).otherwise(total)).select("a", "b")
    # A set that cannot do without hot keys leaves out the ranks from the highest on that its budget pays for.
    kept = F.expr(f"size(filter(sequence(1, {COUNTED + POWERS}), r -> aggregate(slice(ranked, r, {COUNTED + POWERS}), 0L, (x, y) -> x + y) > budget))")
    bound = cut(hot.where("hot > budget").select(F.col("id").alias("a"), F.greatest(kept, F.lit(LOCAL)).alias("most")))
    stars = level.where("rank > 0 AND a <> b")
    led = stars.where(f"rank > {PROXY}").join(small_side(bound), "a").where("rank <= most").select("a", "b")
    families = cut(components(close.union(led).union(stars.where(f"rank = {PROXY}").select("a", "b"))))
    members = cut(families.join(budgets, families["node"] == budgets["id"]).select("id", F.col("root").alias("family"), "n"))
    weight = members.groupBy("family").agg(F.sum("n").alias("weight"))
    large = cut(weight.where(F.col("weight") > block_elements).select("family"))
    texts = lambda of: docs.join(small_side(cut(of.select("id", "family"))), "id").select("id", "family", "text")
    shaped = "id long, family long, elements binary"
    small = map_batches(texts(members.join(small_side(large), "family", "left_anti")), _sets(shingle_words), shaped).select("family", "id", "elements")
    roots = map_batches(small.repartition("family").sortWithinPartitions("family", "id"), _verify(num, den), "a long, b long")
    roots = cut(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")))
    if not large.isEmpty():
        sets = cut(map_batches(texts(members.join(small_side(large), "family")), _sets(shingle_words), shaped))
        roots = cut(roots.union(components(_link_large(sets, num, den, block_elements)).select(F.col("node").alias("rep"), "root")))
    named = placed.join(small_side(roots), "rep", "left").select("id", "n", F.coalesce("root", "rep").alias("component_id"))
    bare = about.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.union(bare).union(unnamed).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, whose id is the least of their component; null ids go."""
    df = df.where(F.col(id_col).isNotNull())
    found = near_duplicates(df, id_col=id_col, **options)
    gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return df.join(small_side(gone), id_col, "left_anti").select(*df.columns)
