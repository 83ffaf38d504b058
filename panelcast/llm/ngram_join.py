"""Documents joined by the Jaccard similarity of their word n-grams, exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass, bloom, materialise, spare, texts, utf8
from panelcast.llm.components import components

STRIP_BYTES = 1 << 18
SEEN_SETS = 1 << 20  # digests of sets that a task remembers, so that copies are sent once
# An n-gram found in COMMON_IN different sets of a task's window is a candidate for the
# list of common ones, which holds the COMMON_GRAMS most frequent and is broadcast (4 MB).
# The list only orders n-grams, rare ones first. Any list gives the same links.
COMMON_WINDOW = 2 << 20
COMMON_IN = 3
COMMON_GRAMS = 1 << 18
TILE = 4096  # sets of one tile of a large group
BAND_BLOCKS = 1 << 32  # more than a band ever has blocks
SMALL_TILE = 64  # tiles of up to so many rows are compared many at a time
MAX_BITS = 8192

_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-grams link when den * intersection >= num * union (above a half)."""

    words: int
    num: int
    den: int

    def __post_init__(self):
        if not (self.words > 0 and self.den // 2 < self.num <= self.den):
            raise ValueError("similarity above a half is needed")

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def possible(self, n_a, pos_a, n_b, pos_b):
        """Whether sizes (a the smaller) and the places of a common gram allow a link: if it
        is the first common one, the sets share no more than what follows it in either."""
        reach = np.minimum(n_a - pos_a, n_b - pos_b)
        return (self.den * n_a >= self.num * n_b) & (reach >= self.overlap(n_a, n_b))

    def prefix(self, n):
        """Linked sets share an n-gram among this many first ones, in any common order."""
        return n - -(-self.num * n // self.den) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _POWER)
_WHITE = np.zeros(256, np.bool_)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        table = np.full(max(n, STRIP_BYTES * 2), base, np.uint64)
        table[0] = 1
        have = _powers[name] = np.multiply.accumulate(table)
    return have


def _strips(values):
    group, size = [], 0
    for i, raw in enumerate(values):
        group.append((i, (raw or b"").lower()))
        size += len(group[-1][1]) + 1
        if size >= STRIP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def gram_sets(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit gram), distinct, sorted by both; ``raws`` are lower-cased.

    Words are hashed from running sums over the strip, grams from their words' hashes.
    A text of fewer words is one gram of all of them, a text without words has none.
    """
    codes = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    white = _WHITE[codes]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * _power_table("up", _POWER, len(codes))[: len(codes)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * _power_table("down", _INVERSE, len(codes))[starts])
    text_starts = np.cumsum([1] + [len(r) + 1 for r in raws])[:-1]
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    count = np.bincount(owner, minlength=len(raws)) if len(owner) else np.zeros(len(raws), np.int64)

    grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        grams += word[j : j + len(grams)] * (_POWER + np.uint64(2 * j))
    whole = owner[: len(grams)] == owner[words - 1 :] if len(grams) else np.zeros(0, np.bool_)
    who, gram = owner[: len(grams)][whole], _mix(grams[whole])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.cumsum(count) - count
        extra = []
        for i in short:
            own = word[first[i] : first[i] + count[i]]
            factors = _POWER + np.uint64(2) * np.arange(len(own), dtype=np.uint64)
            extra.append(np.add.reduce(own * factors) ^ _mix(np.full(1, len(own), np.uint64))[0])
        who = np.concatenate([who, short])
        gram = np.concatenate([gram, _mix(np.array(extra, np.uint64))])
    order = np.lexsort((gram, who))
    who, gram = who[order], gram[order]
    new = np.r_[True, (who[1:] != who[:-1]) | (gram[1:] != gram[:-1])] if len(who) else np.zeros(0, bool)
    return who[new], gram[new]


def _sets(column: pa.Array, words: int):
    """For each strip: positions, set sizes, set digests, owners and grams.

    Equal digests (of sizes and two 64-bit sums, mixed) stand for equal sets.
    """
    for group in _strips(utf8(column)):
        owner, gram = gram_sets([raw for _, raw in group], words)
        size = np.bincount(owner, minlength=len(group))
        ends = np.cumsum(size)
        total = np.r_[np.uint64(0), np.cumsum(_mix(gram ^ _M[0]))]
        other = np.r_[np.uint64(0), np.cumsum(_mix(gram ^ _M[1]))]
        one, two = total[ends] - total[ends - size], other[ends] - other[ends - size]
        digest = _mix(one ^ _mix(two + size.astype(np.uint64))).view(np.int64)
        yield np.array([i for i, _ in group]), size, digest, owner, gram


class _Seen:
    """Digests met before, forgetting all when there are too many."""

    def __init__(self):
        self.digests: set[int] = set()

    def new(self, digests) -> list[bool]:
        if len(self.digests) > SEEN_SETS:
            self.digests.clear()
        out = []
        for d in digests.tolist():
            out.append(d not in self.digests)
            self.digests.add(d)
        return out


def _bits(n) -> np.ndarray:
    """Width of a set's signature: a power of two of at least four times its size, within
    bounds. So wide, it is wrong by a few grams only where it matters, near the limit."""
    return np.clip(2 ** np.ceil(np.log2(4.0 * np.maximum(n, 1))), 64, MAX_BITS).astype(np.int64)


def _signature(gram: np.ndarray, bits: int) -> np.ndarray:
    """Bit j is the parity of the grams that hash to j, so widths halve by folding."""
    odd = np.bincount((gram & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass: (doc_id, n, fp) of every row, and (gram, df) of a task's frequent grams.

    A set's signature is on the first of its rows in a task.
    """

    names = ["doc_id", "n", "fp", "signature", "gram", "df"]

    def work(batches):
        seen, held, room = _Seen(), [], COMMON_WINDOW

        def common():
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            gram, n = gram[n >= COMMON_IN], n[n >= COMMON_IN]
            nothing, unsigned = pa.nulls(len(gram), pa.int64()), pa.nulls(len(gram), pa.binary())
            arrays = [nothing, nothing, nothing, unsigned, pa.array(gram.view(np.int64)), pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            n, fp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            signatures: list[bytes | None] = [None] * batch.num_rows
            for at, size, digest, owner, gram in _sets(batch.column("text"), rule.words):
                n[at], fp[at] = size, digest
                fresh = np.array(seen.new(digest))
                bits, ends = _bits(size), np.cumsum(size)
                for i in np.flatnonzero(fresh & (size > 0)):
                    own = gram[ends[i] - size[i] : ends[i]]
                    signatures[at[i]] = _signature(own, int(bits[i])).tobytes()
                held.append(gram[fresh[owner]] if len(owner) else gram)
                room -= len(held[-1])
                if room < 0:
                    yield common()
                    held, room = [], COMMON_WINDOW
            nothing = pa.nulls(batch.num_rows, pa.int64())
            arrays = [
                batch.column("doc_id"),
                pa.array(n),
                pa.array(fp, mask=n == 0),
                pa.array(signatures, pa.binary()),
                nothing,
                nothing,
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if held:
            yield common()

    schema = "doc_id long, n long, fp long, signature binary, gram long, df long"
    return materialise(arrow_pass(docs, work, schema))


def _classes(summaries: DataFrame) -> DataFrame:
    """(fp, n, doc_id, signature): one row of each set, with its smallest doc_id; written."""
    return materialise(
        summaries.where("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"))
    )


def _common_grams(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, sorted, with how often each was counted."""
    top = (
        summaries.where("gram IS NOT NULL")
        .groupBy("gram")
        .agg(F.sum("df").alias("df"))
        .orderBy(F.desc("df"), "gram")
        .limit(COMMON_GRAMS)
        .toArrow()
    )
    gram, df = top.column("gram").to_numpy(), top.column("df").to_numpy()
    order = np.argsort(gram)
    return gram[order], df[order]


def _positions(owner: np.ndarray, gram: np.ndarray, size: np.ndarray, common) -> np.ndarray:
    """Place of each gram in its set, rare grams first, then by how common, then by value."""
    grams, dfs = common
    df = np.zeros(len(gram), np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        df = np.where(grams[at] == gram, dfs[at], 0)
    first = np.cumsum(size) - size
    place = np.empty(len(gram), np.int64)
    rare = df == 0
    upto = np.r_[0, np.cumsum(rare)]
    place[rare] = (upto[:-1] - upto[first][owner])[rare]
    rares = upto[first + size] - upto[first]
    at = np.flatnonzero(~rare)
    at = at[np.lexsort((gram[at], df[at], owner[at]))]
    if len(at):
        starts = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]])
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        place[at] = rares[owner[at]] + nth
    return place


def _prefixes(docs: DataFrame, rule: Rule, common) -> DataFrame:
    """(gram, n, fp, pos) of the prefix of every set; a task sends a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches):
        seen, listed = _Seen(), shared.value
        for batch in batches:
            for _, size, digest, owner, gram in _sets(batch.column("text"), rule.words):
                gram = gram.view(np.int64)
                place = _positions(owner, gram, size, listed)
                fresh = np.array(seen.new(digest))
                use = (place < rule.prefix(size)[owner]) & fresh[owner] if len(owner) else []
                own = owner[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[use]), pa.array(size[own]), pa.array(digest[own]), pa.array(place[use])],
                    ["gram", "n", "fp", "pos"],
                )

    return arrow_pass(docs, work, "gram long, n long, fp long, pos long")


def _open_ended(rows: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which rows of sorted (gram, n, fp, pos) can be linked to another row of their group.

    Groups of up to ``SMALL_TILE`` rows are decided pair by pair; of larger ones, and of the
    first and the last, which may go on in other batches, every row counts.
    """
    gram, n, _, pos = rows
    last = np.searchsorted(gram, gram, side="right")
    first = np.searchsorted(gram, gram)
    keep = (last - first > SMALL_TILE) | (first == 0) | (last == len(gram))
    small = np.flatnonzero(~keep)
    for step in range(1, SMALL_TILE):
        i = small[small + step < last[small]]
        if not len(i):
            break
        i = i[rule.possible(n[i], pos[i], n[i + step], pos[i + step])]
        keep[i] = keep[i + step] = True
    return keep


def _groups(prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Rows whose gram is in another set's prefix too, with candidates for a link.

    Rows are dealt and sorted by gram and size; two rows are held at a time, whatever a
    group's size. ``prev`` is the next smaller set of the group and ``head`` its smallest,
    where sizes and places leave a link possible.
    """

    def work(batches):
        names = ["gram", "n", "fp", "pos"]
        last = None  # the row held back: its values, and what was found for it
        first = None  # the first row of its group: fp, n, pos

        def out(rows, found, use):
            use = use & _open_ended(rows, rule)
            columns = [pa.array(x[use]) for x in rows]
            for value, linked in found:
                columns.append(pa.array(value[use], mask=~linked[use]))
            return pa.RecordBatch.from_arrays(columns, [*names, "prev", "head"])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if last is not None:
                rows = [np.r_[h, x] for h, x in zip(last[0], rows, strict=True)]
            gram, n, fp, pos = rows
            if not len(gram):
                continue
            new = np.r_[True, (gram[1:] != gram[:-1]) | (fp[1:] != fp[:-1])]
            gram, n, fp, pos = rows = [x[new] for x in rows]
            same = np.r_[False, gram[1:] == gram[:-1]]
            before = np.maximum(np.arange(len(gram)) - 1, 0)
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram))))
            head, head_n, head_pos = fp[start], n[start], pos[start]
            if last is not None:
                same[0] = last[1]
                goes_on = start == 0  # the group began in an earlier batch
                head, head_n, head_pos = (
                    np.where(goes_on, kept, x) for kept, x in zip(first, (head, head_n, head_pos), strict=True)
                )
            prev_ok = same & rule.possible(n[before], pos[before], n, pos)
            head_ok = same & (head != fp[before]) & rule.possible(head_n, head_pos, n, pos)
            found = [(fp[before], prev_ok), (head, head_ok)]
            if last is not None:
                for (value, linked), (old, old_linked) in zip(found, last[2], strict=True):
                    value[0], linked[0] = old, old_linked
            use = same | np.r_[same[1:], False]
            use[-1] = False
            yield out(rows, found, use)
            last = [x[-1:] for x in rows], same[-1], [(v[-1], ok[-1]) for v, ok in found]
            first = head[-1], head_n[-1], head_pos[-1]
        if last is not None and last[1]:
            found = [(np.array([v]), np.array([ok])) for v, ok in last[2]]
            yield out(last[0], found, np.array([True]))

    dealt = prefixes.repartition("gram").sortWithinPartitions("gram", "n", "fp")
    schema = "gram long, n long, fp long, pos long, prev long, head long"
    return materialise(arrow_pass(dealt, work, schema))


def _contents(docs: DataFrame, rule: Rule, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, n, grams) of the wanted sets, written once.

    A filter over one row of each wanted set says in the scan which texts to turn into
    sets again; texts themselves are never shuffled.
    """
    chosen = classes.join(wanted, "fp").select(
        F.coalesce("doc_id", F.lit(-1)).bitwiseXOR(F.col("fp")).alias("key")
    )
    shared = docs.sparkSession.sparkContext.broadcast(bloom(chosen, "key"))

    def work(batches):
        marked, sent = shared.value, _Seen()
        for batch in batches:
            # a set's smallest doc_id is null only if all its rows lack one
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            for at, size, digest, owner, gram in _sets(batch.column("text"), rule.words):
                use = (size > 0) & marked.may_hold(ids[at] ^ digest)
                ends, rows = np.cumsum(size), [[], [], []]
                for i in np.flatnonzero(use):
                    if sent.new(digest[i : i + 1])[0]:
                        own = gram[ends[i] - size[i] : ends[i]].tobytes()
                        for column, value in zip(rows, (digest[i], size[i], own), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["fp", "n", "grams"]
                )

    return materialise(arrow_pass(docs, work, "fp long, n long, grams binary"))


def _folded(signature: np.ndarray) -> np.ndarray:
    """Half as wide, for uint64 words of equal parts."""
    half = signature.shape[-1] // 2
    return signature[..., :half] ^ signature[..., half:]


def _both_sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the columns of both sets."""
    for side in "ba":
        named = sets.select(*[F.col(c).alias(side if c == "fp" else f"{side}_{c}") for c in sets.columns])
        pairs = pairs.join(named, side)
    return pairs


def _signed(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose signatures leave room for a link: the intersection is at most half of
    what remains of both sizes after the bits that differ."""

    def work(batches):
        for batch in batches:
            n_a, n_b = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            need, use = rule.overlap(n_a, n_b), np.zeros(batch.num_rows, np.bool_)
            for i in range(batch.num_rows):
                one, two = (
                    np.frombuffer(batch.column(f"{s}_signature")[i].as_py(), np.uint64) for s in "ab"
                )
                while len(one) > len(two):
                    one = _folded(one)
                while len(two) > len(one):
                    two = _folded(two)
                use[i] = n_a[i] + n_b[i] - int(np.bitwise_count(one ^ two).sum()) >= 2 * need[i]
            yield batch.select(["a", "b"]).filter(pa.array(use))

    sides = _both_sides(pairs, classes.select("fp", "n", "signature"))
    return materialise(arrow_pass(sides, work, "a long, b long"))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by exact intersection; written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sides = _both_sides(pairs, _contents(docs, rule, classes, wanted))

    def work(batches):
        for batch in batches:
            n_a, n_b = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            need, use = rule.overlap(n_a, n_b), np.zeros(batch.num_rows, np.bool_)
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(f"{s}_grams")[i].as_py(), np.uint64) for s in "ab")
                at = np.minimum(np.searchsorted(one, two), len(one) - 1)
                use[i] = np.count_nonzero(one[at] == two) >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(use))

    return materialise(arrow_pass(sides, work, "a long, b long").distinct())


class _Rows:
    """Rows of whole tiles, sorted by tile and size."""

    def __init__(self, table: pa.Table, rule: Rule):
        table = table.combine_chunks()
        column = {c: table.column(c).to_numpy() for c in table.column_names if c != "signature"}
        self.rule, self.fp, self.n, self.pos = rule, column["fp"], column["n"], column["pos"]
        self.root, self.block = column["root"].copy(), column["block"]
        keys = np.stack([column[c] for c in ("gram", "x", "y")])
        self.tile = np.cumsum(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) - 1
        self.signs, self.place = {}, np.zeros(len(self.n), np.int64)
        bits, words = _bits(self.n), table.column("signature")
        self.bits = bits
        for width in np.unique(bits).tolist():
            at = np.flatnonzero(bits == width)
            data = b"".join(words.take(pa.array(at)).to_pylist())
            self.signs[width] = np.frombuffer(data, np.uint64).reshape(len(at), -1)
            self.place[at] = np.arange(len(at))

    def candidates(self):
        """Index pairs of a tile that sizes, places and components leave open."""
        last = np.searchsorted(self.tile, self.tile, side="right")
        small = np.flatnonzero(last - np.searchsorted(self.tile, self.tile) <= SMALL_TILE)
        for step in range(1, SMALL_TILE):
            i = small[small + step < last[small]]
            if not len(i):
                break
            yield self.open(i, i + step)
        large = np.flatnonzero(last - np.searchsorted(self.tile, self.tile) > SMALL_TILE)
        for i in large.tolist():
            # sizes ascend: no row beyond the largest size that i can link to
            most = self.n[i] * self.rule.den // self.rule.num
            end = i + 1 + np.searchsorted(self.n[i + 1 : last[i]], most, side="right")
            j = np.arange(i + 1, end)
            yield self.open(np.full(len(j), i), j)

    def open(self, i, j):
        n_i, n_j, rule = self.n[i], self.n[j], self.rule
        may = (self.root[i] != self.root[j]) & rule.possible(n_i, self.pos[i], n_j, self.pos[j])
        may &= (self.block[i] != self.block[j]) | (self.block[i] < 0)
        return i[may], j[may]

    def signed(self, i, j):
        """Of these pairs, those whose signatures leave enough room for the intersection."""
        good = np.zeros(len(i), np.bool_)
        for width in np.unique(self.bits[i]).tolist():
            for wide in (width, 2 * width):
                at = np.flatnonzero((self.bits[i] == width) & (self.bits[j] == wide))
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    x, y = i[part], j[part]
                    other = self.signs[wide][self.place[y]]
                    other = other if wide == width else _folded(other)
                    differ = np.bitwise_count(self.signs[width][self.place[x]] ^ other).sum(axis=1)
                    left = self.n[x] + self.n[y] - differ.astype(np.int64)
                    good[part] = left >= 2 * self.rule.overlap(self.n[x], self.n[y])
        return i[good], j[good]

    def forest(self, i, j):
        """Of these pairs, those that would connect what earlier ones leave apart."""
        use = []
        for place, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if self.root[x] != self.root[y]:
                self.root[self.root == self.root[y]] = self.root[x]
                use.append(place)
        return i[use], j[use]


def _open_pairs(
    groups: DataFrame, roots: DataFrame, classes: DataFrame, rule: Rule, forest: bool
) -> DataFrame:
    """Pairs of one group, not connected so far, that pass every bound.

    With ``forest`` a task leaves out pairs that would be connected if those it has sent
    prove to be links: no more pairs than sets.

    Groups inside one component are done. Others are compared in tiles. A group of up to
    ``TILE`` sets is one tile; a larger one is cut into bands of set size so that a set can
    only link within its band and to the next ones, a band of more than ``TILE`` sets is
    dealt into blocks, and each pair of blocks of such bands is a tile of its own.
    """
    known = groups.select("gram", "n", "fp", "pos").join(
        roots.select(F.col("node").alias("fp"), "root"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    open_groups = materialise(
        known.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi")
        .select("gram", "m")
    )
    small = known.join(open_groups.where(F.col("m") <= TILE).select("gram"), "gram")
    whole = {"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "block": F.lit(-1).cast("long")}
    dealt_rows = small.withColumns(whole)
    large = open_groups.where(F.col("m") > TILE).select("gram")
    if not large.isEmpty():
        dealt_rows = dealt_rows.unionByName(_banded(known.join(large, "gram"), rule))
    tiles = dealt_rows.join(classes.select("fp", "signature"), "fp")

    def work(batches):
        rest = None

        def compare(table):
            rows = _Rows(table, rule)
            for i, j in rows.candidates():
                i, j = rows.signed(i, j)
                if forest:
                    i, j = rows.forest(i, j)
                if len(i):
                    one, two = rows.fp[i], rows.fp[j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"]
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([table.column(c).to_numpy() for c in ("gram", "x", "y")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            whole = int(cuts[-1]) if len(cuts) else 0  # the last tile may go on in the next batch
            if whole:
                yield from compare(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None:
            yield from compare(rest)

    dealt = tiles.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y", "n", "fp")
    return materialise(arrow_pass(dealt, work, "a long, b long").distinct())


def _banded(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows of large groups, once for each tile (x, y) they take part in, with their ``block``.

    A band's upper end is a little more than the largest size its lower end can link to, so
    two sets that link are in one band or in neighbouring ones. ``block`` is -1 in a tile
    of one block; in a tile of two, only sets of different blocks are compared.
    """
    # rounding must not put a link two bands apart
    band = F.floor(F.ln("n") / F.lit(math.log(rule.den / rule.num) + 1e-6))
    sized = materialise(rows.withColumn("band", band))
    blocks = F.ceil(F.count(F.lit(1)) / TILE)
    bands = materialise(sized.groupBy("gram", "band").agg(blocks.alias("blocks")))
    own = F.col("band") * BAND_BLOCKS + F.pmod(F.xxhash64("fp"), F.col("blocks"))
    beside = bands.select("gram", F.col("band").alias("_band"), F.col("blocks").alias("_blocks"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("_band")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = (
        sized.join(bands, ["gram", "band"])
        .select(*rows.columns, own.alias("_own"), near)
        .join(beside, ["gram", "_band"])
        .withColumn("_other", every)
        .withColumn("_other", F.col("_band") * BAND_BLOCKS + F.col("_other"))
    )
    return dealt.select(
        *rows.columns,
        F.least("_own", "_other").alias("x"),
        F.greatest("_own", "_other").alias("y"),
        F.when(F.col("_own") == F.col("_other"), F.lit(-1).cast("long")).otherwise(F.col("_own")).alias("block"),
    )


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Components after more links: only the components they connect are looked at."""
    if more.isEmpty():
        return roots
    of = roots.select(F.col("node").alias("x"), "root")
    ends = more
    for side in "ab":
        found = ends.join(of, F.col(side) == F.col("x"), "left")
        ends = found.withColumn(side, F.coalesce("root", side)).select("a", "b")
    united = components(ends, "a", "b").select(F.col("node").alias("x"), F.col("root").alias("to"))
    old = roots.join(united, F.col("root") == F.col("x"), "left")
    old = old.select("node", F.coalesce("to", "root").alias("root"))
    # ends without a component before, and those that were roots themselves
    new = united.join(old, F.col("x") == F.col("node"), "left_anti")
    return materialise(old.unionByName(new.select(F.col("x").alias("node"), F.col("to").alias("root"))))


def similar_documents(
    docs: DataFrame, rule: Rule = Rule(5, 80, 100), *, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Texts are lower-cased (A-Z), split at ASCII white space, and reduced to their sets of
    word n-grams. Equal sets form one class, named by a 64-bit digest; links are sought
    between classes. Every linked pair shares a gram of both prefixes. First, neighbours
    in such groups, ordered by size, and each group's smallest set are verified and
    connected. Then pairs of a group that are still in different components are bounded by
    sizes, places and signatures, in tiles: first a forest of them is verified by exact
    intersection, then all that are open still. So a pair is skipped only if it cannot be
    linked or its documents are connected already; no group is expanded into all its pairs.

    ``component_id`` is the smallest doc_id reachable by links. Null, empty and wordless
    texts have 0 n-grams, are linked with nothing, and keep their own id (null for a null
    id). Repeated rows are rows of one class. Other columns are ignored.
    """
    docs = texts(docs, id_col, text_col)
    summaries = _summaries(docs, rule)
    rows, classes = summaries.where("n IS NOT NULL").select("doc_id", "n", "fp"), _classes(summaries)
    groups = _groups(_prefixes(docs, rule, _common_grams(summaries)), rule)
    near = groups.select(F.col("fp").alias("b"), F.explode(F.array("prev", "head")).alias("a"))
    near = near.where("a IS NOT NULL").select("a", "b").distinct()
    edges = _linked(_signed(near, classes, rule), docs, classes, rule)
    roots = materialise(components(edges, "a", "b"))
    # first as few pairs as could connect what is open, then all that are open still
    for forest in (True, False):
        pairs = _open_pairs(groups, roots, classes, rule, forest)
        if not pairs.isEmpty():
            roots = _joined(roots, _linked(pairs, docs, classes, rule))

    least = classes.select("fp", F.col("doc_id").alias("least"))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_class, "fp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _all_links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, fp) of all rows with a set, the classes, and every link (a, b) between classes."""
    summaries = _summaries(docs, rule)
    rows, classes = summaries.where("n IS NOT NULL").select("doc_id", "n", "fp"), _classes(summaries)
    groups = _groups(_prefixes(docs, rule, _common_grams(summaries)), rule)
    unconnected = classes.select(F.col("fp").alias("node"), F.col("fp").alias("root")).where("false")
    pairs = _open_pairs(groups, unconnected, classes, rule, forest=False)
    return rows, classes, _linked(pairs, docs, classes, rule)


def linked_classes(
    docs: DataFrame, rule: Rule = Rule(5, 80, 100), *, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(a, b) with a < b: every link between two different sets, as the smallest doc_id of each.

    With ``class_id`` of ``document_links`` these are all links of all rows: rows of one
    class are linked with each other and with all rows of a linked class. Sets whose rows
    all lack an id are left out. No link is left out for being implied by others, so a
    family of many different near copies has as many rows as it has links.
    """
    _, classes, links = _all_links(texts(docs, id_col, text_col), rule)
    of = classes.where("doc_id IS NOT NULL").select("fp", "doc_id")
    one = of.select(F.col("fp").alias("a"), F.col("doc_id").alias("x"))
    two = of.select(F.col("fp").alias("b"), F.col("doc_id").alias("y"))
    both = links.join(one, "a").join(two, "b")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def document_links(
    docs: DataFrame, rule: Rule = Rule(5, 80, 100), *, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) of every row.

    ``class_id`` is the smallest doc_id with an equal set, ``n_links`` the number of other
    rows that the row is linked with, its copies included. Every link between different
    sets is verified; copies are counted, not expanded. Null, empty and wordless texts have
    their own id and no links.
    """
    rows, classes, links = _all_links(texts(docs, id_col, text_col), rule)
    rows = materialise(rows)
    copies = materialise(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("copies")))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = links.select(ends.alias("end")).select("end.a", "end.b")
    others = both.join(copies.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp"))
    linked = others.agg(F.sum("copies").alias("others"))
    of_class = (
        classes.select("fp", F.col("doc_id").alias("class_id"))
        .join(copies, "fp")
        .join(linked, "fp", "left")
        .select("fp", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    return rows.join(of_class, "fp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80, 100), *, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with all its columns; of each component the smallest doc_id stays.

    Rows without an id stay; rows that repeat a kept id stay with it.
    """
    found = similar_documents(docs, rule, id_col=id_col, text_col=text_col)
    (gone,) = spare(docs, "_dropped")
    dropped = materialise(
        found.groupBy("doc_id")
        .agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
        .where("NOT kept")
        .select(F.col("doc_id").alias(gone))
    )
    return docs.join(dropped, F.col(id_col) == F.col(gone), "left_anti")
