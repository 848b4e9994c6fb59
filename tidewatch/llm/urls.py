"""URL filters: rules first, then naive Bayes over segmented hosts and paths.

Concatenated host names are split into words by a unigram Viterbi search.  The
words of pages that a rule judges train a multinomial naive Bayes model, which
judges the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.sources.staging import stage

# Verdict and beginning of a url (host, which holds for its subdomains, then path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Rows of tokens sent on at once.
TOKEN_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one.  Of equally long rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one put in front is asked first: the longest, and of equals the earliest.
    for says, begin in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = begin.index("/")
        fits = ((host == begin[:at]) | host.endswith("." + begin[:at])) & path.startswith(begin[at:])
        rule = F.when(fits, F.lit(begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits names into the words that are most probable together.

    ``counts`` needs the words that are in the names only, if ``total`` is the
    sum of the counts of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(sum(counts.values()) if total is None else total, 1)
        self.logs = {word: math.log(n / self.total) for word, n in counts.items()}
        self.lengths = sorted({len(word) for word in counts}, reverse=True)

    def words(self, name: str) -> list[str]:
        """Viterbi over the ends of words; a stretch without known words stays one word."""
        if not self.logs:
            return [name] if name else []
        # A word that is not known is the less probable the longer it is.
        first, each = math.log(1.0 / self.total), 2.3
        best = [0.0] + [-math.inf] * len(name)
        back = [0] * (len(name) + 1)
        # Where an unknown word begins best: that does not depend on where it ends.
        start = 0
        for end in range(1, len(name) + 1):
            if best[end - 1] + each * (end - 1) > best[start] + each * start:
                start = end - 1
            for length in self.lengths:
                word = name[end - length : end] if length <= end else None
                if word in self.logs and best[end - length] + self.logs[word] > best[end]:
                    best[end], back[end] = best[end - length] + self.logs[word], end - length
            unknown = best[start] + (first - each * (end - start))
            if unknown > best[end]:
                best[end], back[end] = unknown, start
        found, end = [], len(name)
        while end:
            found.append(name[back[end] : end])
            end = back[end]
        return found[::-1]


_RUNS = re.compile(r"[^\W\d_]+|\d+")


def host_tokens(host: str, segmenter: Segmenter) -> list[str]:
    """Words of the host; numbers count as one token."""
    tokens = []
    for run in _RUNS.findall(host):
        tokens += ["h:#"] if run[0].isdigit() else ["h:" + w for w in segmenter.words(run)]
    return tokens


def path_tokens(path: str) -> list[str]:
    """Words of the path, told apart from those of hosts; numbers count as one token."""
    return ["p:#" if run[0].isdigit() else "p:" + run for run in _RUNS.findall(path.lower())]


def substrings(host: str, lengths: list[int], sieve: Sieve) -> Iterator[str]:
    """What of these lengths is in the runs of letters of a host and may be a word, each once."""
    seen = set()
    for run in _RUNS.findall(host):
        if run[0].isdigit():
            continue
        # Ends of the letters in the bytes of the run.
        raw = run.encode()
        ends = [at for at, byte in enumerate(raw) if byte & 0xC0 != 0x80] + [len(raw)]
        for n in lengths:
            for at in range(len(run) - n + 1):
                piece = raw[ends[at]:ends[at + n]]
                if piece not in seen and piece in sieve:
                    # Only words and the few that the sieve lets through are held.
                    seen.add(piece)
                    yield piece.decode()


class Sieve:
    """A bit map of words by hash: lets all of them through, and few others.

    Its size is fixed: with very many words it lets more through, which costs time only.
    """

    BITS = 1 << 23

    def __init__(self, bits: bytes):
        self.bits = bits

    def __contains__(self, word: bytes) -> bool:
        place = xxhash.xxh64_intdigest(word, seed=42) % self.BITS
        return bool(self.bits[place >> 3] >> (place & 7) & 1)

    @classmethod
    def of(cls, words: DataFrame) -> Sieve:
        place = F.pmod(F.xxhash64("word"), F.lit(cls.BITS))
        # Parts of 4 KB, 256 of them at most.
        bit = F.bitmap_construct_agg(F.bitmap_bit_position(place + 1))
        parts = words.groupBy(F.bitmap_bucket_number(place + 1).alias("part")).agg(bit.alias("bits")).collect()
        bits = bytearray(cls.BITS // 8)
        for row in parts:
            begin = (row["part"] - 1) * 4096
            bits[begin:begin + 4096] = row["bits"]
        return cls(bytes(bits))


def exploded(rows: DataFrame, found_in: Callable[[object], Iterable], field: StructField) -> DataFrame:
    """Each row once per value found in its last column, which the value replaces as ``field``."""
    schema = StructType([*rows.schema.fields[:-1], field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(batch, at, values):
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*kept, pa.array(values)], names=schema.names)

        for batch in batches:
            at, values = [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for found in found_in(value):
                    at.append(i)
                    values.append(found)
                    if len(at) >= TOKEN_ROWS:
                        yield batch_of(batch, at, values)
                        at, values = [], []
            if at:
                yield batch_of(batch, at, values)

    return rows.mapInArrow(run, schema)


def lexicon(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Rows (word, n): how often each word is in the titles of all pages."""
    title = F.regexp_extract(F.lower(F.coalesce(F.col(f"`{html_column}`"), F.lit(""))), r"(?s)<title[^>]*>(.*?)</title>", 1)
    word = F.explode(F.split(title, r"[^\p{L}]+"))
    return pages.select(word.alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def tokens_of_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (number, allow, block, token) of ``hosts`` (number, host, allow, block), split by the lexicon ``words``.

    The substrings of each host meet the words in a join, so a host is split by
    the counts of those that are in it, and no task holds the lexicon.  A sieve
    keeps most substrings that are no words out of the join, so a host of a
    million letters needs little more memory than its words.
    """
    known = words.agg(F.sum("n"), F.collect_set(F.length("word"))).first()
    total, lengths = known[0] or 0, sorted(known[1])
    sieve = Sieve.of(words)
    pieces = exploded(hosts.select("number", "host"), lambda host: substrings(host, lengths, sieve), StructField("word", StringType()))
    found = pieces.join(words, "word").groupBy("number").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    # A host may be long and have many tokens: they carry its number.
    named = hosts.join(found, "number", "left").select("number", "allow", "block", F.struct("host", "words").alias("name"))

    def tokens(name: dict) -> list[str]:
        return host_tokens(name["host"], Segmenter({w["word"]: w["n"] for w in name["words"] or ()}, total))

    return exploded(named, tokens, TOKEN)


TOKEN = StructField("token", StringType())


def learn(hosts: DataFrame, by_host: DataFrame, parsed: DataFrame) -> tuple[DataFrame, float]:
    """Rows (token, odds), log odds (block to allow) of each token, and the odds of a page.

    From all pages that a rule judges; a token of none of them is not there and says nothing.  Hosts carry how many of their pages are
    allowed and blocked, so a host which is most of the table is counted once.
    """
    block = (F.col("ruled") == "block").cast("long")
    judged = parsed.where("rule is not null").select((1 - block).alias("allow"), block.alias("block"), "path")
    by_path = exploded(judged, path_tokens, TOKEN)
    sums = [F.sum("allow").alias("allow"), F.sum("block").alias("block")]
    counts = stage(
        by_host.select("allow", "block", "token").where("allow + block > 0").unionByName(by_path).groupBy("token").agg(*sums),
        "token-counts",
    )
    tokens, pages = counts.agg(*sums, F.count("*").alias("distinct")).first(), hosts.agg(*sums).first()
    allow, block = (math.log((tokens[c] or 0) + max(tokens["distinct"], 1)) for c in ("allow", "block"))
    odds = F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0) - (block - allow)
    return counts.select("token", odds.alias("odds")), math.log(((pages[1] or 0) + 1.0) / ((pages[0] or 0) + 1.0))


def summed(tokens: DataFrame, odds: DataFrame, key: str) -> DataFrame:
    """Rows (key, sum of the odds of its tokens), the smallest first, so that the sum does not depend on their order."""
    each = tokens.select(key, "token").join(odds, "token").select(key, "odds")
    total = F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda a, b: a + b)
    return each.groupBy(key).agg(total.alias(f"{key}_odds"))


def judge(
    pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (probability of block by the model).

    A null url, or one without ``://``, has an empty host and path and fits no
    rule; the model then goes by the share of blocked pages.  Without pages that
    a rule judges, it allows.  Repeated rows are judged each; other columns are
    ignored; an empty table stays empty.
    """
    url = F.col(f"`{url_column}`").cast("string")
    parsed = pages.select(F.col(f"`{id_column}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": ruled})
    # Rows with equal ids are told apart by a number, which must not be given anew: the table is written once.
    parsed = stage(parsed.withColumn("row", F.monotonically_increasing_id()), "urls")
    judged = [F.count(F.when(F.col("ruled") == says, 1)).alias(says) for says in ("allow", "block")]
    hosts = parsed.groupBy("host").agg(*judged).withColumn("number", F.monotonically_increasing_id())
    hosts = stage(hosts.select("number", "host", "allow", "block"), "hosts")
    by_host = stage(tokens_of_hosts(hosts, stage(lexicon(pages, html_column), "lexicon")), "host-tokens")
    odds, prior = learn(hosts, by_host, parsed)
    by_row = exploded(parsed.select("row", "path"), path_tokens, TOKEN)
    z = F.lit(prior) + F.coalesce("number_odds", F.lit(0.0)) + F.coalesce("row_odds", F.lit(0.0))
    scored = (
        parsed.join(summed(by_row, odds, "row"), "row", "left")
        .join(hosts.join(summed(by_host, odds, "number"), "number").select("host", "number_odds"), "host", "left")
        .withColumn("score", 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))))
    )
    by_model = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score"
    )
