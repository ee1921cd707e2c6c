"""Collocations by SON partitioning: shards are mined whole at their share of the support, then all candidates are counted."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from slopeweave.llm.shards import GOLDEN, in_batches, mix, shards
from slopeweave.llm.tokenizing import decoded
from slopeweave.operators.ranking import with_position
from slopeweave.session import cut

SUPPORT, MOST_WORDS, COVER, REPORTED = 10, 3, 50, 2_000
SHARD_TEXT = 4 << 20
# Languages whose size is sent to the tasks; shards of any further language are mined at support 1, which loses nothing.
SIZED = 1_000
# The filter of candidates has some 16 bits for each, and at most so many; the fuller it is, the more phrases are counted in vain.
MOST_BITS = 27
UNKNOWN = "und"

# Words and the marks that end a piece, as bytes after lower-casing A-Z.
_tokens = re.compile(rb"[.,;:!?\x0a-\x0d]|[^\x20\x09.,;:!?\x0a-\x0d]+").findall
_MARKS = [bytes([b]) for b in (*b".,;:!?", *range(0x0A, 0x0E))]


class _Numbers(dict):
    """Numbers of words in order of their first use; all marks are 0."""

    def __init__(self) -> None:
        super().__init__(dict.fromkeys(_MARKS, 0))
        self.words: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


@dataclass
class Mined:
    """Distinct phrases of one length in a shard: the first ``k - 1`` words as a phrase of the level below, the last word, number and hash."""

    before: np.ndarray
    last: np.ndarray
    n: np.ndarray
    hash: np.ndarray


def mine(texts: list[bytes], lang: str, most_words: int = MOST_WORDS, least: int = 1) -> tuple[list[bytes], int, list[Mined]]:
    """Words by number, number of word occurrences, and the phrases of 1 to ``most_words`` words that occur ``least`` times at least."""
    number = _Numbers()
    ids = np.fromiter((number[t] for text in texts for t in (*_tokens(decoded(text).encode().lower()), b"\n")), np.int64)
    seed = xxhash.xxh64_intdigest(lang)
    of_word = mix(np.fromiter(map(xxhash.xxh64_intdigest, number.words), np.uint64, len(number.words)) ^ np.uint64(seed))
    at = np.flatnonzero(ids)
    total = len(at)
    group = np.zeros(len(at), np.int64)
    hashes = np.full(1, seed, np.uint64)
    levels = []
    for k in range(1, most_words + 1):
        # ``at`` are the places of the phrase's last word, ``group`` the numbers of the phrases that end before it.
        if k > 1:
            follows = (at + 1 < len(ids)) & (ids[np.minimum(at + 1, len(ids) - 1)] > 0)
            at, group = at[follows] + 1, group[follows]
        keys, inverse, n = np.unique(group * len(number.words) + ids[at], return_inverse=True, return_counts=True)
        before, last = np.divmod(keys, len(number.words))
        hash_ = mix(hashes[before] * GOLDEN + of_word[last])
        # Longer phrases hold only phrases that are as frequent; the others go no further.
        often = n >= least
        levels.append(Mined(before[often], last[often], n[often], hash_[often]))
        renamed = np.cumsum(often) - 1
        kept = often[inverse]
        at, group, hashes = at[kept], renamed[inverse[kept]], hash_[often]
    return number.words, total, levels


def spelled(words: list[bytes], levels: list[Mined], wanted: list[np.ndarray]) -> list[pa.Array]:
    """The wanted phrases of each level (by index), words joined by a space."""
    known = pa.array(words, pa.large_binary())
    out = []
    for k, index in enumerate(wanted):
        chain = []
        for level in reversed(levels[:k + 1]):
            chain.append(known.take(pa.array(level.last[index])))
            index = level.before[index]
        out.append(pc.binary_join_element_wise(*reversed(chain), pa.scalar(b" ", pa.large_binary())))
    return out


def _by_lang(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, list[bytes]]:
    parts: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), texts):
        parts[lang].append(text)
    return parts


def local_support(size: int, whole: int, support: int) -> int:
    """The least number in a part of ``size`` out of ``whole`` that some part must hold of whatever occurs ``support`` times."""
    return max(1, -(-support * size // max(whole, 1)))


def candidates(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS) -> DataFrame:
    """``h``: 64-bit hashes of language and words that hold those of all phrases which occur ``support`` times in a language.

    What occurs that often does so, in some shard, at its share of the support at least, by bytes of the language's text. Each shard is mined
    whole at that support. Where shards are so small beside the language that every share is 1, the counts reported are complete, and
    candidates that stay below the support in all shards together are dropped where the reports meet.
    """
    narrow = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    size = F.octet_length("text")
    sized = narrow.groupBy("lang").agg(F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.coalesce(F.max(size), F.lit(0)).alias("longest"))
    rows = sized.orderBy(F.desc("size")).limit(SIZED).collect()
    # The rest, and languages of which no shard can have more than a share of 1, report plain counts.
    shared = {r["lang"]: r["size"] for r in rows if support * (SHARD_TEXT + max(r["longest"] for r in rows)) > r["size"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shards(batches, SHARD_TEXT):
            for lang, part in _by_lang(batch, texts).items():
                least = local_support(sum(map(len, part)), shared[lang], support) if lang in shared else 1
                for level in mine(part, lang, most_words, least)[2]:
                    n = np.maximum(level.n, support) if lang in shared else level.n
                    yield pa.RecordBatch.from_arrays([pa.array(level.hash.view(np.int64)), pa.array(n)], ["h", "n"])

    reports = in_batches(narrow, run, "h long, n long")
    return reports.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= support).select("h")


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64((1 << bits) - 1), hashes >> np.uint64(64 - bits)


def bit_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the long column ``h`` as 64-bit words with two bits for each, and the logarithm of its size, which has a bound."""
    n = hashes.count()
    bits = min(MOST_BITS, max(12, (16 * n).bit_length()))
    places = F.explode(F.array(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("h", 64 - bits))).alias("at")
    # At most 2^(MOST_BITS - 6) rows.
    words = (hashes.select(places).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).toArrow())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    return table.view(np.uint64), bits


def _has(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, bits):
        found &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def counts(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of up to ``most_words`` words that occur ``support`` times or more in their language, and for each
    language a row with null phrase and 0 words whose ``n`` counts all word occurrences. Null text is as empty, null language as ``und``.

    A phrase is words that follow each other within a piece, joined by a space. Candidates are looked up in a filter of fixed bound and counted
    exactly, as text; what passes the filter by chance stays below the support and is dropped.
    """
    narrow = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    table, bits = bit_filter(cut(candidates(docs, support, most_words), "candidates"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shards(batches, SHARD_TEXT):
            for lang, part in _by_lang(batch, texts).items():
                words, total, levels = mine(part, lang, most_words)
                wanted = [np.flatnonzero(_has(shared.value, bits, level.hash)) for level in levels]
                shown = [pc.cast(p, pa.large_string()) for p in spelled(words, levels, wanted)]
                for k, (index, phrase) in enumerate(zip(wanted, shown), 1):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(index), pa.string()), pc.cast(phrase, pa.string()), pa.array([k] * len(index), pa.int32()),
                                                      pa.array(levels[k - 1].n[index])], schema.names)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([total], pa.int64())], schema.names)

    found = in_batches(narrow, run, schema)
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= support) | (F.col("words") == 0))


def _part(first: Column | int, size: Column | int) -> Column:
    """Some words of the column ``w`` as a phrase."""
    return F.array_join(F.slice("w", first, size), " ")


def scored(counted: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the phrases of two words or more in ``counted`` (as ``counts`` gives them).

    For each cut after the first k words, ``l`` and ``r`` count the two sides, and the score is floor(10^6 a^2 / (l r)), in decimals of 38 digits. The cut
    with the lowest score stands, of several the one with the smallest k. Both sides are as frequent as the phrase, so they are in ``counted``.
    """
    known = counted.filter("words > 0").select("lang", F.col("phrase").alias("side"), F.col("n").alias("side_n"))
    long = counted.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", "words", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), _part(F.lit(1), F.col("k")).alias("side")),
        F.struct(F.lit(False).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("side")))).alias("s")).select("*", "s.left", "s.side").drop("s")
    both = (sides.join(known, ["lang", "side"]).groupBy("lang", "phrase", "words", "a", "k")
            .agg(F.max(F.when(F.col("left"), F.col("side_n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("side_n"))).alias("r")))
    score = F.expr("(CAST(a AS DECIMAL(18,0)) * CAST(a AS DECIMAL(18,0)) * 1000000BD) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def not_covered(found: DataFrame, cover: int = COVER) -> DataFrame:
    """Rows of ``found (lang, phrase, words, a)`` but for those whose words lie inside a longer phrase with at least ``cover`` percent of their count."""
    long = found.filter("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", F.col("a").alias("longer"))
    inside = (long.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
              .select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
              .select("lang", _part(F.col("first"), F.col("size")).alias("phrase"), "longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    return kept.drop("longer")


def collocations(docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS, cover: int = COVER, reported: int = REPORTED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``reported`` collocations of each language in ``docs (text, lang)``.

    Order is by score, then count (both descending), then phrase by its bytes, which no two of a language share. Repeated documents count as often as they are
    there; bytes that are not UTF-8 count as the replacement character. An empty table has no languages and no rows.
    """
    counted = cut(counts(docs, support, most_words), "phrases")
    found = not_covered(cut(scored(counted), "scored"), cover)
    totals = counted.filter("words = 0").select("lang", F.col("n").alias("of_lang"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Rows are range-partitioned by language and order; no language is ranked in one task.
    ranked = with_position(found, ["lang"], order, "rank").filter(F.col("rank") < reported)
    return ranked.join(totals, "lang").select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("of_lang").alias("n"), "score")
