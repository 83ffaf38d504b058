"""Token ids as binary shards with a minimal perfect hash index over the document keys."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.functions.lineage import shared_folder
from panelcast.functions.ordering import running
from panelcast.llm.bpe import little_endian
from panelcast.llm.common import arrow_pass, materialise, task_number, texts

# A shard is closed once it has so many ids (4 bytes each) or documents. A document is never
# cut, so a longer one makes a shard of its own length.
SHARD_TOKENS = 1 << 20
SHARD_DOCS = 1 << 16
# Words that a worker remembers, and their longest; words of a text that are looked up at a time.
CACHED_WORDS = 1 << 19
CACHED_LENGTH = 64
STRIP_WORDS = 1 << 14
TAIL = ".,;:!?"
ASKED = 1 << 16  # keys that a shard is asked for at a time

# A shard file, little-endian: this header, then
#   levels   level x uint32     words of each level of the hash
#   bits     words x uint64     its bits, level after level
#   ranks    words x uint32     bits set in the words before
#   prints   keys x uint32      fingerprint of the key of each slot
#   firsts   keys x uint32      number of the key's first document in the shard
#   keys     docs x int64       key of each document, ascending; the first ``unkeyed`` have none
#   offsets  (docs + 1) x uint64  first id of each document, and the end
#   ids      ids x uint32
MAGIC = b"TOKENS01"
HEADER = struct.Struct("<8sIIIIIQ")  # magic, docs, unkeyed, keys, levels, words, ids

SHARDS = (
    "part int, nth int, first_key long, last_key long, unkeyed int, docs int, "
    "before long, tokens long, content binary"
)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of int64 keys; different keys have different hashes at each seed."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


FINGERPRINT = 1 << 20  # seed beyond all levels


class PerfectHash:
    """Different keys to the numbers below their count, from a few bits a key.

    A level has twice as many bits as keys are left. A key alone on its bit sets it and is
    done; the others go on to the next level. A key's number is the rank of its bit. A key
    that is not in the set gets none or any number; its fingerprint tells.
    """

    def __init__(self, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels, bits = [], []
        while len(keys):
            words = -(-2 * len(keys) // 64)
            at = (_mixed(keys, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(words)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        flat = np.concatenate([np.zeros(0, np.uint64), *bits])
        counts = np.bitwise_count(flat).astype(np.uint32)
        ranks = np.cumsum(counts, dtype=np.uint32) - counts
        return PerfectHash(np.array(levels, np.uint32), flat, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, words in enumerate(self.levels.tolist()):
            at = (_mixed(keys[left], level) % np.uint64(64 * words)).astype(np.int64)
            word, bit = self.bits[start + (at >> 6)], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[start + (at[hit] >> 6)] + np.bitwise_count(below)
            left, start = left[~hit], start + words
        return out


class Shard:
    """A shard file's content, read by key."""

    def __init__(self, content: bytes):
        magic, docs, unkeyed, keys, levels, words, ids = HEADER.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def section(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, n, at)
            at += found.nbytes
            return found

        self.unkeyed = unkeyed
        levels = section("<u4", levels)
        self.hash = PerfectHash(levels, section("<u8", words), section("<u4", words))
        self.prints, self.firsts = section("<u4", keys), section("<u4", keys)
        self.keys, self.offsets = section("<i8", docs), section("<u8", docs + 1).astype(np.int64)
        self.ids = section("<u4", ids)
        if at != len(content) or self.offsets[-1] != ids:
            raise ValueError("a token shard is damaged")

    def first(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document, -1 where its fingerprint is not there."""
        slots = self.hash.slots(keys)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == (_mixed(keys[found], FINGERPRINT) >> np.uint64(32))
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.firsts[slots[found]]
        return out

    def documents(self, key: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start within the shard, ids) of each document with the key."""
        at = int(self.first(np.array([key], np.int64))[0])
        while 0 <= at < len(self.keys) and self.keys[at] == key:
            yield int(self.offsets[at]), self.ids[self.offsets[at] : self.offsets[at + 1]]
            at += 1


def shard_content(keys: list[int | None], lengths: list[int], ids: bytes) -> bytes:
    """The file of documents in ascending key order, those without key first."""
    unkeyed = sum(k is None for k in keys)
    known = np.array(keys[unkeyed:], np.int64)
    different, first = np.unique(known, return_index=True)
    perfect = PerfectHash.build(different)
    slots = perfect.slots(different)
    prints, firsts = np.zeros(len(different), "<u4"), np.zeros(len(different), "<u4")
    prints[slots] = _mixed(different, FINGERPRINT) >> np.uint64(32)
    firsts[slots] = first + unkeyed
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<u8")
    words = len(perfect.bits)
    sections = [
        HEADER.pack(MAGIC, len(keys), unkeyed, len(different), len(perfect.levels), words, len(ids) // 4),
        *(a.astype(k).tobytes() for a, k in ((perfect.levels, "<u4"), (perfect.bits, "<u8"), (perfect.ranks, "<u4"))),
        prints.tobytes(),
        firsts.tobytes(),
        np.concatenate([np.zeros(unkeyed, np.int64), known]).astype("<i8").tobytes(),
        offsets.tobytes(),
        ids,
    ]
    return b"".join(sections)


@lru_cache(maxsize=4)
def _coder(path: str) -> Callable[[str], bytes]:
    """The ids of a text by the tokenizers library, as little-endian bytes.

    Where the file's pre-tokenizer drops white space and its normalizer works within a word,
    the words between spaces and line ends encode one by one and short ones are remembered,
    over all tasks of a worker. A word of Latin letters, perhaps with stops after it, is
    surely one piece and the stops another, so the library's model takes it directly.
    """
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as handle:
        spec = json.load(handle)

    def whole(text: str) -> bytes:
        return little_endian(array("I", tokenizer.encode(text, add_special_tokens=False).ids))

    if not _by_word(spec):
        return whole
    tokenize, letter = tokenizer.model.tokenize, _byte_letters()
    packed = [i.to_bytes(4, "little") for i in range(max(spec["model"]["vocab"].values()) + 1)]
    known: dict[str, bytes] = {}

    def learn(words: list[str]) -> None:
        """Ids of words, into ``known``."""
        if len(known) >= CACHED_WORDS:
            for word in list(islice(known, CACHED_WORDS // 2, None)):
                del known[word]  # frequent words came first
        for word in words:
            base = word.rstrip(TAIL)
            plain = base.isascii()
            if not base.isalpha() or not plain and (max(base) > "\u017f" or "\u0130" in base):
                known[word] = whole(word)
                continue
            low = base.lower()
            ids = known.get(low)
            if ids is None:
                spelt = low if plain else "".join([letter[b] for b in low.encode()])
                ids = known[low] = b"".join([packed[token.id] for token in tokenize(spelt)])
            if len(base) < len(word):
                tail = word[len(base) :]
                if tail not in known:
                    known[tail] = whole(tail)
                ids += known[tail]
            known[word] = ids

    def by_word(text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        out = []
        for lo in range(0, len(words), STRIP_WORDS):
            strip = words[lo : lo + STRIP_WORDS]
            found = list(map(known.get, strip))
            missing = [i for i, ids in enumerate(found) if ids is None]
            if missing:
                learn([word for word in {strip[i] for i in missing} if len(word) <= CACHED_LENGTH])
                for i in missing:
                    ids = known.get(strip[i])
                    found[i] = whole(strip[i]) if ids is None else ids
            out += found
        return b"".join(out)

    return by_word


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _by_word(spec: dict) -> bool:
    """Whether a text's ids are those of its pieces between white space, one after another."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and spec["model"].get("end_of_word_suffix")
        and first["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and spec["pre_tokenizer"]["pretokenizers"][1].get("add_prefix_space") is False
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        and spec.get("post_processor") is None
    )


def write_store(
    docs: DataFrame,
    path: str,
    end_id: int,
    *,
    id_col="doc_id",
    text_col="text",
    shard_tokens: int = SHARD_TOKENS,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The shards of all documents in ascending order of their ids, written once.

    A row of the result is a shard: its file (``content``), its number within its part
    (a range of ids) and the ids before it there. Shards follow each other by (part, nth).
    Null and empty texts are the end id alone. Documents of one id follow each other in the
    order of the input, those without id come first. The one shuffle carries each text
    once; a range is cut by the input's order within an id, so a repeated id is split too.
    """
    rows = texts(docs, id_col, text_col).withColumn("_nth", F.monotonically_increasing_id())
    order = ["doc_id", "_nth"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def work(batches):
        encode, part = _coder(path), task_number()
        end = little_endian(array("I", [end_id]))
        keys, lengths, ids, size = [], [], [], 0
        nth = before = 0

        def shard():
            known = [k for k in keys if k is not None] or [None]
            row = [part, nth, known[0], known[-1], sum(k is None for k in keys), len(keys), before, size,
                   shard_content(keys, lengths, b"".join(ids))]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names
            )

        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = encode(text.as_py() or "") + end
                keys.append(key.as_py())
                lengths.append(len(data) // 4)
                ids.append(data)
                size += lengths[-1]
                if size >= shard_tokens or len(keys) >= shard_docs:
                    yield shard()
                    nth, before = nth + 1, before + size
                    keys, lengths, ids, size = [], [], [], 0
        if keys:
            yield shard()

    names = [column.split()[0] for column in SHARDS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    shards = arrow_pass(ranged.select("doc_id", "text"), work, SHARDS)
    shards.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(SHARDS).parquet(folder)


def part_starts(store: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before; a row for each part, not for each shard."""
    totals = store.groupBy("part").agg(F.sum("tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_start"))


PLACES = "doc_id long, part int, _start long, n_tokens long, ids_crc32 long"


def read_store(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards.

    Each task opens its shards and asks each one's index for its keys, so payloads are read
    once and do not cross the network. ``start`` counts the ids of all documents before.
    """

    def work(batches):
        for batch in batches:
            for part, before, content in zip(*batch.columns, strict=True):
                shard = Shard(content.as_py())
                at = np.arange(len(shard.keys))
                keyed = shard.keys[shard.unkeyed :]
                # a key's first document is where the index says, its others follow
                first = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]]) if len(keyed) else at[:0]
                found = shard.first(keyed[first])
                if (found < 0).any():
                    raise ValueError("a key is not in its shard's index")
                at[shard.unkeyed :] = np.repeat(found - first, np.diff(np.r_[first, len(keyed)])) + np.arange(len(keyed))
                lo, hi = shard.offsets[at], shard.offsets[at + 1]
                raw = memoryview(shard.ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                missing = np.arange(len(at)) < shard.unkeyed
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.keys.astype(np.int64), mask=missing),
                        pa.array(np.full(len(at), part.as_py(), np.int32)),
                        pa.array(before.as_py() + lo),
                        pa.array(hi - lo),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "part", "_start", "n_tokens", "ids_crc32"],
                )

    placed = arrow_pass(store.select("part", "before", "content"), work, PLACES)
    start = (F.col("part_start") + F.col("_start")).alias("start")
    return placed.join(materialise(part_starts(store)), "part").select("doc_id", start, "n_tokens", "ids_crc32")


def lookup(store: DataFrame, keys: DataFrame, *, id_col="doc_id") -> DataFrame:
    """(doc_id, start, ids) of the documents with the asked keys; absent keys have no row.

    Shards follow the order of their keys, so a key goes to the shards whose range has it:
    asked keys and shards' first keys are sorted together, and the last shard that starts
    at or before a key is a running maximum. In the shard its place is a few hashes and a
    fingerprint away, whatever the shard's size. Only shards that are asked for are opened,
    each for lists of ``ASKED`` keys or so. Null keys ask for nothing, a repeated key once.
    """
    order = ["part", "nth"]
    shards = store.where("first_key IS NOT NULL")
    numbers = materialise(running(shards.select(*order, "first_key"), [F.col(c) for c in order]))
    starts = numbers.select(F.col("first_key").alias("key"), F.col("position").alias("shard"))
    asked = keys.select(F.col(id_col).cast("long").alias("key"), F.lit(None).cast("long").alias("shard"))
    both = starts.unionByName(asked.na.drop(subset=["key"]).distinct())
    ranged = materialise(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("_part").agg(F.max("shard").alias("_m")).select("_part", F.max("_m").over(before).alias("_m"))
    inside = Window.partitionBy("_part").orderBy("key")
    # a repeated key may begin at the end of the last shard that starts below it
    last = F.max("shard").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    below = F.max("shard").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    runs = ranged.withColumns({"_last": last, "_below": below}).where("shard IS NULL").join(carried, "_part")
    to = F.coalesce("_last", "_m")
    routed = materialise(
        runs.where(to.isNotNull()).select(
            "key", F.explode(F.sequence(F.coalesce("_below", "_m", to), to)).alias("position")
        )
    )
    lists = routed.groupBy("position").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("_lists"))
    part = F.pmod(F.xxhash64("key"), F.col("_lists")).alias("_list")
    requests = (
        routed.join(lists, "position")
        .select("key", "position", part)
        .groupBy("position", "_list")
        .agg(F.collect_list("key").alias("asked"))
        .join(numbers.select(*order, "position"), "position")
        .select(*order, "asked")
    )

    def work(batches):
        for batch in batches:
            for asked, start, before, content in zip(*batch.columns, strict=True):
                shard, first = Shard(content.as_py()), start.as_py() + before.as_py()
                found = [(k, first + at, ids) for k in asked.as_py() for at, ids in shard.documents(k)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in found], pa.int64()),
                        pa.array([at for _, at, _ in found], pa.int64()),
                        pa.array([ids.astype(np.int64) for _, _, ids in found], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "start", "ids"],
                )

    opened = materialise(requests).join(store.select(*order, "before", "content"), order)
    opened = opened.join(materialise(part_starts(store)), "part")
    return arrow_pass(
        opened.select("asked", "part_start", "before", "content"), work, "doc_id long, start long, ids array<long>"
    )
