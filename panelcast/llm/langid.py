"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass, hash_share, texts

# Bounds of what is learnt: a dictionary holds excerpts of at most so many texts of its
# language, and all dictionaries together at most DICTIONARIES_BYTES.
SAMPLE_TEXTS = 512
EXCERPT_CHARS = 512
DICTIONARIES_BYTES = 16 << 20
BLOCK_BYTES = 4096
LEVEL = 6
MIN_MARGIN = 0.02

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """Raw dictionary content of each language, by name."""

    content: dict[str, bytes]


def learn(
    df: DataFrame,
    *,
    text_col="text",
    lang_col="lang",
    sample_texts: int = SAMPLE_TEXTS,
    excerpt_chars: int = EXCERPT_CHARS,
) -> Languages:
    """Dictionaries from a bounded sample of labelled rows.

    Rows are drawn by a hash of their text, at a rate that follows each language's number of
    different texts, so no language is gathered whole and each fills its sample if it can;
    equal texts count once. Null texts or languages and
    texts without a letter are left out. Excerpts start at a place the hash picks.
    """
    rows = df.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    distinct = rows.select("lang", F.xxhash64("text").alias("key")).distinct()
    counts = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().collect()}
    if not counts:
        return Languages({})
    share: Column = F.lit(1.0)
    for lang, n in counts.items():
        most = 8 * sample_texts + 100
        if n > most:
            share = F.when(F.col("lang") == lang, most / n).otherwise(share)
    key = F.xxhash64("text")
    room = F.greatest(F.lit(1), F.char_length("text") - excerpt_chars + 1)
    picked = (
        rows.where(hash_share("text", share))
        .withColumns({"key": key, "at": (F.pmod(key, room) + 1).cast("int")})
        .select("lang", "key", F.substring("text", F.col("at"), F.lit(excerpt_chars)).alias("part"))
        .groupBy("lang", "key")
        .agg(F.min("part").alias("part"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
        .where(F.col("n") <= sample_texts)
        .collect()
    )
    # with very many languages each has fewer excerpts, all of them whole
    most = max(1, DICTIONARIES_BYTES // len(counts) // (4 * excerpt_chars + 1))
    content = {}
    for lang in sorted(counts):
        parts = [r["part"] for r in sorted(picked, key=lambda r: r["key"]) if r["lang"] == lang]
        if parts:
            content[lang] = "\n".join(parts[:most]).encode()
    return Languages(content)


class Classifier:
    def __init__(self, languages: Languages, level: int = LEVEL):
        self.names = sorted(languages.content)
        self.coders = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(
                languages.content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            data.precompute_compress(level=level)
            self.coders.append(
                zstandard.ZstdCompressor(
                    dict_data=data,
                    write_checksum=False,
                    write_content_size=False,
                    write_dict_id=False,
                ).compress
            )

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text in each language's coding, block by block."""
        data = text.encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(code(b)) for b in blocks) for code in self.coders]

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language of the smallest coding (ties: the first name) and its margin, 0 to 1."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = np.array(self.sizes(text), np.float64)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = np.delete(sizes, best).min()
        return self.names[best], float((second - sizes[best]) / second)


def identify(
    df: DataFrame,
    languages: Languages,
    *,
    id_col="doc_id",
    text_col="text",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """(doc_id, lang_pred, score, reliable) of every row, from its whole text alone.

    ``score`` is how much smaller the best coding is than the second best, as a share;
    ``reliable`` is false where that margin is under ``min_margin``. A null, empty or
    letterless text, or nothing learnt, gives ``und`` with score 0. Repeated rows are judged
    each; very long texts are coded whole, block by block; ties go to the first name.
    """
    shared = df.sparkSession.sparkContext.broadcast(languages)

    def work(batches):
        classify = Classifier(shared.value).classify
        for batch in batches:
            found = [classify(value.as_py()) for value in batch.column("text")]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([n != UNKNOWN and s >= min_margin for n, s in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "reliable"],
            )

    schema = "doc_id long, lang_pred string, score double, reliable boolean"
    return arrow_pass(texts(df, id_col, text_col), work, schema)
