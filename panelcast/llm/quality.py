"""Quality classifier: interpolated modified Kneser-Ney model of bytes, perplexity thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass, materialise, spare, utf8

ORDER = 5
PAD = b"\0" * (ORDER - 1)
STRIP_BYTES = 1 << 19
# A task holds this many distinct n-grams before it sends their counts.
HELD_GRAMS = 1 << 20
# Entries of the model that are broadcast at a time, some 12 bytes each.
SHARD_ENTRIES = 4 << 20
# Limits come from trusted texts scored by a model of the other folds. A text's hash gives
# its fold, so that copies stay together.
FOLDS = 3
ALL = -1  # instead of a fold: the model of all trusted texts
# So many different trusted texts of a language weigh as much as what is known without them.
PRIOR_TEXTS = 100
QUANTILE = 0.99
SLACK = 0.1
# A short text's perplexity is a rough estimate: it is taken this many nats lower over the
# square root of its bytes before it is compared, in thresholds and decisions alike.
MARGIN = 4.0
BINS = 1000  # per nat of log perplexity, in the quantiles' histogram
ANY = "any"


def _strips(values):
    """(position, four bytes before, bytes) of texts in groups of about a strip.

    A longer text is cut into strips, each with the bytes before it as its context; a
    group never has two parts of one text.
    """
    group, size = [], 0
    for i, raw in enumerate(values):
        for lo in range(0, len(raw or b""), STRIP_BYTES):
            before = (PAD + raw[max(0, lo - len(PAD)) : lo])[-len(PAD) :]
            group.append((i, before, raw[lo : lo + STRIP_BYTES]))
            size += len(group[-1][2]) + len(PAD)
            if size >= STRIP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _grams(group) -> tuple[np.ndarray, np.ndarray]:
    """(text's number in the strip, n-gram that ends at each byte), earliest byte highest.

    A text begins with zero bytes, so its first bytes have contexts of their own.
    """
    codes = np.frombuffer(b"".join(before + raw for _, before, raw in group), np.uint8).astype(np.int64)
    keys = np.zeros(len(codes) - len(PAD), np.int64)
    for j in range(ORDER):
        keys = (keys << 8) | codes[j : j + len(keys)]
    sizes = np.array([len(raw) for _, _, raw in group])
    owner = np.repeat(np.arange(len(group)), sizes)
    starts = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    first = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return owner, keys[np.arange(len(owner)) + first]


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col("text")), F.lit(FOLDS)).cast("int")


def gram_counts(trusted: DataFrame, folds: int = 0) -> DataFrame:
    """(fold, key, n): how often each n-gram of the highest order occurs in trusted texts.

    Fold ``ALL`` counts all of them. With ``folds``, trusted has a column ``fold``, and fold
    f counts the texts of all folds but f.
    """

    def merge(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    def work(batches):
        parts, size = [], 0
        for batch in batches:
            fold = batch.column("fold").to_numpy().astype(np.int64)
            for group in _strips(utf8(batch.column("text"))):
                owner, keys = _grams(group)
                keys |= (fold[[i for i, _, _ in group]] << 8 * ORDER)[owner]
                parts.append(np.unique(keys, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD_GRAMS:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size > HELD_GRAMS // 2:
                        yield batch_of(*parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(*merge(parts))

    texts = trusted.select("text", "fold" if folds else F.lit(0).alias("fold"))
    sent = arrow_pass(texts, work, "key long, n long")
    fold = F.shiftright("key", 8 * ORDER)
    key = F.col("key").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("key")
    own = [F.coalesce(F.sum(F.when(fold == f, F.col("n"))), F.lit(0)) for f in range(folds)]
    counts = [(ALL, F.sum("n")), *((f, F.sum("n") - n) for f, n in enumerate(own))]
    rows = F.array(*(F.struct(F.lit(f).alias("fold"), n.alias("n")) for f, n in counts))
    out = sent.groupBy(key).agg(rows.alias("rows")).select("key", F.explode("rows").alias("row"))
    return out.select("row.fold", "key", "row.n").where("n > 0")


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Each fold's modified Kneser-Ney discounts for counts of 1, 2 and more."""
    counted = counts.groupBy("fold").agg(
        *[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]
    )
    return {r[0]: _discounts_of(*r[1:]) for r in counted.collect()}


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The discounts from counts of counts."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]  # too few n-grams to estimate them
    y = n1 / (n1 + 2.0 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def train(trusted: DataFrame, folds: int = 0) -> DataFrame:
    """The model of all trusted texts (column ``text``) as a written table.

    With ``folds``, and trusted texts' ``fold``, the table also has for each fold a model of
    all other folds' texts. Rows (fold, kind, size, key, value): kind 0 holds log probabilities of seen n-grams, kind 1
    the log weights that a seen context gives to the next shorter one. Lower orders count
    how many bytes an n-gram follows. Counts, context sums and lower-order probabilities
    are aggregates and joins dealt by n-gram, so no task or driver sees the whole model.
    """
    level = materialise(gram_counts(trusted, folds))
    tables = {ORDER: level}
    for size in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * size) - 1
        level = materialise(
            level.groupBy("fold", F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(
                F.count(F.lit(1)).alias("n")
            )
        )
        tables[size] = level
    model, lower = None, None
    for size in range(1, ORDER + 1):
        counts = tables[size].withColumn("context", F.shiftright("key", 8))
        discount = F.lit(None).cast("double")
        for fold, (d1, d2, d3) in _discounts(tables[size]).items():
            own = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            discount = F.when(F.col("fold") == fold, own).otherwise(discount)
        contexts = counts.groupBy("fold", "context").agg(
            F.sum("n").alias("total"), F.sum(discount).alias("held")
        )
        joined = counts.join(contexts, ["fold", "context"])
        if lower is None:
            below = F.lit(1.0 / 256)
        else:
            suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))
            joined = joined.withColumn("suffix", suffix).join(lower, ["fold", "suffix"])
            below = F.col("p_lower")
        p = (F.col("n") - discount + F.col("held") * below) / F.col("total")
        probabilities = materialise(joined.select("fold", "key", p.alias("p")))
        lower = probabilities.select("fold", F.col("key").alias("suffix"), F.col("p").alias("p_lower"))

        def rows(kind: int, size: int, key: str, value: Column, of: DataFrame) -> DataFrame:
            return of.select(
                "fold", F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.col(key).alias("key"),
                value.cast("float").alias("value"),
            )

        part = rows(0, size, "key", F.log("p"), probabilities).unionByName(
            rows(1, size, "context", F.log(F.col("held") / F.col("total")), contexts)
        )
        model = part if model is None else model.unionByName(part)
    return materialise(model)


def of_fold(model: DataFrame, fold: int) -> DataFrame:
    """The rows of one model of a table with several."""
    return model.where(F.col("fold") == fold).drop("fold")


@dataclass(frozen=True)
class Shard:
    """What is needed to score the bytes that follow certain bytes."""

    before: np.ndarray  # 256 flags
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # (kind, size) -> keys, values

    def find(self, kind: int, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, values = self.tables[kind, size]
        if not len(have):
            return np.zeros(len(keys), np.bool_), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        found = have[at] == keys
        return found, np.where(found, values[at], 0.0)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Interpolated log probability of the last byte of each n-gram given the others."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for size in range(ORDER, 0, -1):
            mask = (1 << 8 * size) - 1
            found, value = self.find(0, size, keys[left] & mask)
            out[left[found]] += value[found]
            left = left[~found]
            if not len(left):
                return out
            out[left] += self.find(1, size, (keys[left] & mask) >> 8)[1]
        out[left] += math.log(1.0 / 256)
        return out


def shards(model: DataFrame, entries: int = SHARD_ENTRIES) -> list[list[int]]:
    """Byte values dealt into groups whose entries are at most ``entries`` where possible.

    An n-gram goes by its last byte but one, a context by its last byte: all that scores
    one byte lies in one shard. Single bytes are in every shard. At most 256 shards.
    """
    by = _before(F.col("kind"), F.col("key"))
    sizes = {
        r["before"]: r["count"]
        for r in model.where("size > 1").groupBy(by.alias("before")).count().collect()
    }
    groups, room = [[]], entries
    for value in sorted(range(256), key=lambda v: -sizes.get(v, 0)):
        n = sizes.get(value, 0)
        if n > room and groups[-1]:
            groups.append([])
            room = entries
        groups[-1].append(value)
        room -= n
    return groups


def _before(kind: Column, key: Column) -> Column:
    return F.when(kind == 0, F.shiftright(key, 8)).otherwise(key).bitwiseAND(F.lit(255))


def _load(model: DataFrame, values: list[int]) -> Shard:
    by = _before(F.col("kind"), F.col("key"))
    part = model.where((F.col("size") == 1) | by.isin(values)).toArrow()
    kind, size = part.column("kind").to_numpy(), part.column("size").to_numpy()
    key, value = part.column("key").to_numpy(), part.column("value").to_numpy()
    tables = {}
    for k in (0, 1):
        for s in range(1, ORDER + 1):
            at = np.flatnonzero((kind == k) & (size == s))
            at = at[np.argsort(key[at])]
            tables[k, s] = key[at], value[at]
    before = np.zeros(256, np.bool_)
    before[values] = True
    return Shard(before, tables)


def _log_sums(column: pa.Array, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text's bytes that the shard scores, and every text's bytes."""
    sums, sizes = np.zeros(len(column)), np.zeros(len(column), np.int64)
    whole = shard.before.all()
    for group in _strips(utf8(column)):
        owner, keys = _grams(group)
        at = np.array([i for i, _, _ in group])
        sizes[at] += [len(raw) for _, _, raw in group]
        if not whole:
            use = shard.before[(keys >> 8) & 255]
            owner, keys = owner[use], keys[use]
        # one lookup for each distinct n-gram of the strip
        packed = np.sort((keys << 22) | owner)
        keys, owner = packed >> 22, packed & ((1 << 22) - 1)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)
        log_p = np.repeat(shard.log_p(keys[starts]), np.diff(np.r_[starts, len(keys)]))
        sums[at] += np.bincount(owner, weights=log_p, minlength=len(group))
    return sums, sizes


def log_perplexity(
    df: DataFrame, model: DataFrame, entries: int = SHARD_ENTRIES, *, text_col="text"
) -> DataFrame:
    """``df``, ``log_ppl`` and ``log_ppl_low``; null for a null or empty text.

    ``log_ppl`` is in nats a byte, ``log_ppl_low`` the lower estimate that is compared;
    columns of these names in ``df`` are replaced.
    """
    total, size = spare(df, "_sum", "_bytes")
    log_ppl, low = _log_ppl(total, size)
    scored = _summed(df, model, entries, text_col, total, size)
    return scored.withColumns({"log_ppl": log_ppl, "log_ppl_low": low}).drop(total, size)


def _log_ppl(total: str, size: str) -> tuple[Column, Column]:
    log_ppl = F.when(F.col(size) > 0, -F.col(total) / F.col(size))
    return log_ppl, log_ppl - MARGIN / F.sqrt(size)


def _summed(
    df: DataFrame, model: DataFrame, entries: int, text_col: str, total: str, size: str
) -> DataFrame:
    """``df`` with the log probability of each text's bytes and their number.

    Every shard of the counts is joined on the map side, one narrow pass each; a shard is
    broadcast, its size is bounded, and a text's sums over shards are added in its row.
    The number of passes follows the number of distinct n-grams, not the number of texts.
    """
    context = df.sparkSession.sparkContext
    out = df.withColumns({total: F.lit(0.0), size: F.lit(0).cast("long")})
    for values in shards(model, entries):
        shared = context.broadcast(_load(model, values))

        def work(batches, shared=shared):
            for batch in batches:
                sums, sizes = _log_sums(batch.column(text_col), shared.value)
                sums = sums + batch.column(total).to_numpy()
                rest = [c for c in batch.schema.names if c not in (total, size)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in rest), pa.array(sums), pa.array(sizes)],
                    [*rest, total, size],
                )

        out = arrow_pass(out, work, out.schema)
    return out


def thresholds(trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> dict[str, float]:
    """Largest lower estimate that passes, by language and for ``any`` other.

    The quantile over all trusted rows (log_ppl_low, lang, text_key) of a language, taken
    exactly from a histogram with bins of a thousandth, plus ``slack``. ``log_ppl_low`` must
    come from a model that has not seen the text.

    m different texts say that clean text of a language goes so far, not that it goes no
    further. So the limit lies between the language's own quantile, with weight m / (m +
    ``PRIOR_TEXTS``), and a wide one: the largest of the common limit, its largest text,
    and its median text plus the widest distance from median to quantile, of all texts or
    of a language, the latter with the same weight.
    """
    bins = (
        trusted.where("log_ppl_low IS NOT NULL")
        .groupBy("lang", "text_key", F.ceil(F.col("log_ppl_low") * BINS).alias("bin"))
        .count()
        .groupBy("lang", "bin")
        .agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("texts"))
        .collect()
    )

    def cut(rows, part: float, weight: str = "count") -> float:
        own = sorted((b["bin"], b[weight]) for b in rows)
        reach = np.cumsum([n for _, n in own])
        at = int(np.searchsorted(reach, part * reach[-1]))
        return own[min(at, len(own) - 1)][0] / BINS

    if not bins:
        return {}
    by_lang = {}
    for b in bins:
        if b["lang"] is not None:
            by_lang.setdefault(b["lang"], []).append(b)
    weight = {}
    for lang, rows in by_lang.items():
        m = sum(b["texts"] for b in rows)
        weight[lang] = m / (m + PRIOR_TEXTS)
    spreads = [weight[k] * (cut(rows, quantile) - cut(rows, 0.5)) for k, rows in by_lang.items()]
    spread = max([cut(bins, quantile) - cut(bins, 0.5), *spreads])
    out = {ANY: cut(bins, quantile)}
    for lang, rows in by_lang.items():
        own = cut(rows, quantile)
        wide = max(out[ANY], cut(rows, 1.0), cut(rows, 0.5, "texts") + spread)
        out[lang] = own + (1 - weight[lang]) * (wide - own)
    return {lang: limit + slack for lang, limit in out.items()}


def judged(
    docs: DataFrame, model: DataFrame, limits: dict[str, float], *, text_col="text", lang_col="lang"
) -> DataFrame:
    """``docs`` with ``log_ppl``, ``log_ppl_low``, ``log_ppl_limit`` and ``keep``.

    Columns of these names in ``docs`` are replaced; ``keep_good`` keeps them. A language without trusted text, or null, has the limit of all languages together. Null
    and empty texts are not kept. Without any trusted text there is no limit: all other
    texts are kept.
    """
    scored = log_perplexity(docs, model, text_col=text_col)
    limit = _limit(limits, lang_col)
    keep = _passes(F.col("log_ppl"), F.col("log_ppl_low"), limit)
    return scored.withColumns({"log_ppl_limit": limit, "keep": keep})


def _limit(limits: dict[str, float], lang_col: str) -> Column:
    limit = F.lit(limits.get(ANY)).cast("double")
    for lang in sorted(set(limits) - {ANY}):
        limit = F.when(F.col(lang_col) == lang, limits[lang]).otherwise(limit)
    return limit


def _passes(log_ppl: Column, low: Column, limit: Column) -> Column:
    return log_ppl.isNotNull() & F.coalesce(low <= limit, F.lit(True))


def keep_good(
    docs: DataFrame, model: DataFrame, limits: dict[str, float], *, text_col="text", lang_col="lang"
) -> DataFrame:
    """``docs`` with all its columns, whatever their names, without the rows that ``judged`` rejects."""
    total, size = spare(docs, "_sum", "_bytes")
    passes = _passes(*_log_ppl(total, size), _limit(limits, lang_col))
    return _summed(docs, model, SHARD_ENTRIES, text_col, total, size).where(passes).drop(total, size)


def fit(trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK):
    """Model and limits of trusted rows (text, lang).

    The model is of all of them. The limits are of perplexities that each text has in a
    model of the folds it is not in; a fold's scores are written before the next is loaded.
    The rows are written first, so that what finds them runs once and every pass over them
    has one Python worker a task.
    """
    trusted = materialise(trusted.select("text", "lang", _fold().alias("fold")))
    models = train(trusted, FOLDS)
    scored = None
    for fold in range(FOLDS):
        part = log_perplexity(trusted.where(F.col("fold") == fold), of_fold(models, fold)).select(
            "lang", F.xxhash64("text").alias("text_key"), "log_ppl_low"
        )
        part = materialise(part)
        scored = part if scored is None else scored.unionByName(part)
    return of_fold(models, ALL), thresholds(scored, quantile, slack)


def quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col="doc_id",
    text_col="text",
    lang_col="lang",
    quantile: float = QUANTILE,
    slack: float = SLACK,
) -> DataFrame:
    """(doc_id, lang, log_ppl, perplexity, log_ppl_low, log_ppl_limit, keep) of every row.

    ``trusted`` has text and lang. Repeated rows, in either, count each; ties with the limit
    are kept; very long texts are scored whole, in strips.
    """
    model, limits = fit(trusted, quantile, slack)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    return judged(slim, model, limits).select(
        "doc_id", "lang", "log_ppl", F.exp("log_ppl").alias("perplexity"), "log_ppl_low", "log_ppl_limit", "keep"
    )
