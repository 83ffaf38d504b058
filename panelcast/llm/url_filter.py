"""URL filters: a trie over reversed host labels and path segments, longest match wins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import arrow_pass

# Lists up to this many rules are broadcast as a trie (some 100 bytes a rule); longer ones are joined.
MAX_TRIE_RULES = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True, order=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; verdict allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        # the longer rule, then the deeper host, then block before allow
        return (len(self.host) + len(self.path), len(self.host), self.verdict == "block")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path columns; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)  # next label or whole segment
    paths: _Node | None = None  # at a host's last label: its path trie
    tails: dict[str, Rule] = field(default_factory=dict)  # beginnings of the next segment
    tail_sizes: set[int] = field(default_factory=set)


class UrlTrie:
    """Host labels from the right, then path segments; a rule's last segment is a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.children.setdefault(label, _Node())
            if node.paths is None:
                node.paths = _Node()
            node = node.paths
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.children.setdefault(segment, _Node())
            if tail not in node.tails or rule.rank > node.tails[tail].rank:
                node.tails[tail] = rule
                node.tail_sizes.add(len(tail))

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits, walking only nodes that exist."""
        best: Rule | None = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            step = node.paths
            for segment in segments:
                if step is None:
                    break
                for n in step.tail_sizes:
                    rule = step.tails.get(segment[:n]) if n <= len(segment) else None
                    if rule is not None and (best is None or rule.rank > best.rank):
                        best = rule
                step = step.children.get(segment)
        return best


def judge_urls(
    df: DataFrame,
    rules: DataFrame | Iterable[Rule],
    *,
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule`` and ``verdict`` of each row.

    Null or malformed urls have an empty host and path; they and urls that no rule fits
    get a null rule and the ``default`` verdict. Of several rules the longest wins, then
    the deeper host, then block. Repeated rows stay. Rules with a null field are ignored.
    A rule list beyond ``max_trie_rules`` is joined instead of broadcast, with equal results.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    urls = df.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").na.drop()
        head = rules.limit(max_trie_rules + 1).collect()
        if len(head) > max_trie_rules:
            return judge_by_join(urls, rules, default)
        rules = [Rule(*row) for row in head]
    rules = sorted(rules)
    if len(rules) > max_trie_rules:
        fields = [(rule.host, rule.path, rule.verdict) for rule in rules]
        table = df.sparkSession.createDataFrame(fields, "host string, path string, verdict string")
        return judge_by_join(urls, table, default)
    listed = df.sparkSession.sparkContext.broadcast(rules)

    def judge(batches):
        match = UrlTrie(listed.value).match
        for batch in batches:
            found, verdicts = [], []
            for h, p in zip(
                batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True
            ):
                rule = match(h, p)
                found.append(rule.text if rule else None)
                verdicts.append(rule.verdict if rule else default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                [*batch.schema.names, "rule", "verdict"],
            )

    schema = urls.withColumns({"rule": F.lit(""), "verdict": F.lit("")}).schema
    return arrow_pass(urls, judge, schema)


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same verdicts by equality joins, for rule lists of any size.

    Distinct (host, path) pairs look up each host suffix, then each path prefix whose
    length some rule of that suffix has: never all rules of a host.
    """
    rules = rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict"
    ).dropDuplicates()
    best_of = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("verdict").alias("verdict"),
    )
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = rules.select("r_host", F.length("r_path").alias("n")).distinct()
    hits = (
        pairs.withColumn("r_host", F.explode(suffixes))
        .join(lengths, "r_host")
        .where(F.col("n") <= F.length("path"))
        .withColumn("r_path", F.expr("substring(path, 1, n)"))
        .join(rules, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(F.max(best_of).alias("best"))
    )
    return (
        urls.join(hits, ["host", "path"], "left")
        .select(
            *urls.columns,
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
