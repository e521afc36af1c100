"""Phrase collocations: frequent phrases by multikey quicksort of suffix pointers.

Every word of a piece of text starts a suffix, read to ``LONGEST`` words. Suffixes are routed by
their leading words, so those that begin alike meet in one bucket wherever they come from. There
pointers to them are sorted by three-way quicksort, one word deeper each time: the part equal to the
pivot is a phrase, its size the phrase's count. A part below the least count can hold no frequent
phrase, longer ones included, and is abandoned.

A word that starts very many suffixes is routed by its first two words, a pair that does by three,
and so on: each round counts the prefixes that grew out of crowded ones. So no route holds much more
than ``CROWDED`` suffixes, and what the buckets count of a crowded prefix is added up at the end.

Which words are frequent, and which prefixes crowded, travels as bit maps of fixed size. A bit set
by chance sends some suffixes more, or further apart; it changes no count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.substring_dedup import mix
from cardwarden.llm.words import record_batch, tidy
from cardwarden.operators.joins import fits_broadcast, hot_keys, spread_join
from cardwarden.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words that a map step sorts together, and suffixes aimed at for one bucket.
CHUNK, BUCKET = 1 << 19, 1 << 20
#: Suffixes of one prefix above which it is routed by one more word.
CROWDED = BUCKET // 4
#: Words that a task remembers, beside those of its current chunk.
KNOWN = 200_000
MAX_PARTITIONS = 20_000
#: Bits of a map, counters of a task that looks for crowded prefixes, and blocks that they travel in.
BITS, SLOTS, BLOCKS = 1 << 25, 1 << 22, 64
#: Small tables are broadcast up to, join keys spread above, this many rows.
BROADCAST_ROWS, HOT_ROWS = 100_000, 500_000

# A-Z become a-z, the piece separators a full stop, a tab a blank.
_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = b"."
_K = np.uint64(0x9E3779B97F4A7C15)
PARCEL = "bucket long, lang string, route int, shape binary, counts binary, load binary"


def tokens(text: bytes) -> list[bytes]:
    """Words, with a full stop for every end of a piece; no word holds one."""
    return text.translate(_TABLE).replace(_STOP, b" . ").split()


def _rows_of(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang")
    return docs.where(docs[text_col].isNotNull()).select(lang, docs[text_col].cast("binary").alias("text"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens) of a few hundred thousand words; texts are parted by a full stop."""
    held: dict[str, list] = {}
    sizes: Counter = Counter()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py()
        held.setdefault(lang, []).append(text)
        sizes[lang] += len(text)
        if sizes[lang] > CHUNK * 6:
            yield lang, tokens(_STOP.join(held.pop(lang)))
            del sizes[lang]
    for lang, texts in held.items():
        yield lang, tokens(_STOP.join(texts))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of every word; the row with a null word counts all of the language."""
    schema = T.StructType.fromDDL("lang string, word binary, n long")
    arrow = to_arrow_schema(schema)

    @tidy
    def run(batches):
        found: dict[str, Counter] = {}

        def flush():
            for lang, counts in found.items():
                stops = counts.pop(_STOP, 0)
                words = list(counts)
                n = list(counts.values())
                total = sum(n)
                if words or stops:
                    columns = [[lang] * (len(words) + 1), [None, *words], [total, *n]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            found.clear()

        for batch in batches:
            for lang, words in _chunks(batch):
                found.setdefault(lang, Counter()).update(words)
                if sum(map(len, found.values())) > KNOWN:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bit_map(keys: DataFrame, size: int = BITS) -> np.ndarray | None:
    """The lowest bits of ``key`` as one map of ``size`` bits, a power of two, or None if there are
    none; the driver gets size/64 rows at most."""
    word, bit = F.expr(f"shiftright(key & {size - 1}L, 6)"), F.expr("shiftleft(1L, CAST(key & 63L AS INT))")
    words = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    if not words:
        return None
    out = np.zeros(size // 64, np.uint64)
    out[[r["w"] for r in words]] = np.array([r["b"] for r in words], np.int64).view(np.uint64)
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) != 0


class Vocabulary:
    """Numbers and hashes of the words of one language that may be frequent; other words are -1."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.seed = zlib.crc32(lang.encode() + b"\0")
        self.frequent = frequent
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {_STOP: -1}
        self.names: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.clear()
        new = list(set(words).difference(self.known))
        if new:
            hashes = np.fromiter((zlib.crc32(w, self.seed) for w in new), np.uint64, len(new))
            often = has_bit(self.frequent, hashes)
            numbers = np.where(often, np.cumsum(often) - 1 + len(self.names), -1)
            self.known.update(zip(new, numbers.tolist()))
            self.names += [w for w, o in zip(new, often.tolist()) if o]
            self.hashes = np.concatenate([self.hashes, hashes[often]])
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))


def suffixes(ids: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes of two words and more, one row each, -1 after their end."""
    n = len(ids)
    padded = np.concatenate([ids, np.full(longest, -1, np.int32)])
    columns = [ids]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] >= 0, padded[k : k + n], -1))
    return np.stack(columns, 1)[(ids >= 0) & (columns[1] >= 0)]


def merged_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes in order, and how often each is there."""
    keys = []
    for at in range(0, rows.shape[1], 3):
        key = np.zeros(len(rows), np.uint64)
        for column in rows[:, at : at + 3].T:
            key = (key << np.uint64(21)) | (column + 1).astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    heads = np.flatnonzero(new)
    return rows[order[heads]], np.diff(np.append(heads, len(rows)))


def grown(route: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(route * _K + hashes)


def routes(rows: np.ndarray, hashes: np.ndarray, crowded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the leading words, how many of them) that each suffix is routed by.

    A suffix that ends where more words would be needed counts as routed by them: what it adds to
    its own prefix is part of a sum, too.
    """
    key = hashes[rows[:, 0]]
    route, depth = mix(key), np.ones(len(rows), np.int32)
    at = np.arange(len(rows))
    for k, bits in enumerate(crowded):
        at = at[has_bit(bits, key[at] if k == 0 else route[at])]
        depth[at] += 1
        at = at[rows[at, k + 1] >= 0] if k + 1 < rows.shape[1] else at[:0]
        route[at] = grown(route[at], hashes[rows[at, k + 1]])
    return route, depth


def crowded_prefixes(rows: DataFrame, frequent, crowded: list, limit: int) -> np.ndarray | None:
    """Bits of the prefixes, one word longer than those of the last map in ``crowded``, of more than
    ``limit`` suffixes.

    A task counts into ``SLOTS`` counters by hash, whatever it reads, and sends them in blocks that
    are added up side by side. Prefixes in one slot are crowded together, which only sends their
    suffixes further apart.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL("block int, counts binary"))
    depth, width = len(crowded) + 1, SLOTS // BLOCKS

    @tidy
    def run(batches):
        known: dict[str, Vocabulary] = {}
        counters = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for lang, words in _chunks(batch):
                vocabulary = _vocabulary(known, lang, frequent.value)
                found = suffixes(vocabulary(words), depth)
                found = found[has_bit(crowded[0], vocabulary.hashes[found[:, 0]])]
                if len(found):
                    route, used = routes(found, vocabulary.hashes, crowded)
                    keys = route[(used == depth) & (found[:, depth - 1] >= 0)] & np.uint64(SLOTS - 1)
                    slots, n = np.unique(keys, return_counts=True)
                    counters[slots.astype(np.int64)] += n.astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        blocks = [(i, press.compress(c.tobytes())) for i, c in enumerate(counters.reshape(BLOCKS, width)) if c.any()]
        yield record_batch(blocks, arrow)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), np.uint32)
                sums[block] = sums.get(block, 0) + part.astype(np.int64)
        keys = [np.flatnonzero(n > limit) + block * width for block, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["key"])

    counted = rows.mapInArrow(run, "block int, counts binary").repartitionById(BLOCKS, F.col("block"))
    return bit_map(counted.mapInArrow(add, "key long"), SLOTS)


def _vocabulary(known: dict[str, Vocabulary], lang: str, frequent: np.ndarray) -> Vocabulary:
    if lang not in known:
        if len(known) >= 16:
            known.clear()
        known[lang] = Vocabulary(lang, frequent)
    return known[lang]


def parcels(lang: str, vocabulary: Vocabulary, words: list[bytes], crowded: list, longest: int, n_buckets: int) -> list[tuple]:
    """What one chunk sends: per bucket and number of routing words its suffixes in order, each
    without the words it shares with the one before."""
    found = suffixes(vocabulary(words), longest)
    if not len(found):
        return []
    press = zstandard.ZstdCompressor(level=1, write_content_size=True)
    found, counts = merged_suffixes(found)
    route, depth = routes(found, vocabulary.hashes, crowded)
    bucket = (route % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((depth, bucket))
    found, counts, bucket, depth = found[order], counts[order], bucket[order], depth[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (depth[1:] != depth[:-1])
    length = (found >= 0).sum(1)
    same = np.zeros(found.shape, bool)
    same[1:] = (found[1:] == found[:-1]) & (found[1:] >= 0)
    shared = np.where(new, 0, np.logical_and.accumulate(same, 1).sum(1))
    shape = (shared * 16 + length).astype(np.uint8)
    at = np.arange(longest)
    sent = (at >= shared[:, None]) & (at < length[:, None])
    edges = [*np.flatnonzero(new).tolist(), len(found)]
    names, out = vocabulary.names, []
    for a, b in zip(edges, edges[1:]):
        load = b" ".join([names[i] for i in found[a:b][sent[a:b]].tolist()])
        out.append((int(bucket[a]), lang, int(depth[a]), shape[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(), press.compress(load)))
    return out


class Bucket:
    """The suffixes of one bucket, language and number of routing words."""

    def __init__(self, longest: int):
        self.longest = longest
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, shape: bytes, counts: bytes, load: bytes) -> None:
        shape = np.frombuffer(shape, np.uint8)
        shared, length = (shape >> 4).astype(np.int64), shape & 15
        words = zstandard.ZstdDecompressor().decompress(load).split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(known)
        at = np.arange(self.longest)
        rows = np.full((len(shape), self.longest), -1, np.int32)
        rows[(at >= shared[:, None]) & (at < length[:, None])] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        for k in range(self.longest):
            source = np.maximum.accumulate(np.where(shared <= k, np.arange(len(shape)), 0))
            rows[:, k] = rows[source, k]
        self.parts.append(rows)
        self.counts.append(np.frombuffer(counts, np.uint32))

    def phrases(self, route: int, least: int) -> Iterator[tuple[bytes, int, int]]:
        """(phrase, words, count); counts of fewer words than ``route`` are parts of a sum."""
        names = list(self.known)
        columns = np.ascontiguousarray(np.concatenate(self.parts).T)
        weight = np.concatenate(self.counts).astype(np.int64)
        for pointer, depth, size in multikey_quicksort(columns, weight, route, least):
            yield b" ".join([names[i] for i in columns[:depth, pointer].tolist()]), depth, size


def multikey_quicksort(columns: np.ndarray, weight: np.ndarray, whole: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(a pointer, depth, weight) of every prefix of two words and more that weighs ``least``.

    ``columns[k]`` holds the word at depth k of each suffix, -1 past its end. Pointers are parted by
    a pivot at one depth into less, equal and greater; the equal part goes one deeper. Parts below
    ``least`` are abandoned, but prefixes shorter than ``whole`` are all given.
    """
    deepest = len(columns)
    stack = [(np.arange(columns.shape[1]), 0)]
    while stack:
        pointers, depth = stack.pop()
        floor = least if depth + 1 >= whole else 1
        w = weight[pointers]
        if w.sum() < floor:
            continue
        key = columns[depth][pointers]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))  # the median of three
        equal = key == pivot
        below, above = pointers[key < pivot], pointers[key > pivot]
        if len(below):
            stack.append((below, depth))
        if len(above):
            stack.append((above, depth))
        size = int(w[equal].sum())
        if pivot < 0 or size < floor:
            continue
        same = pointers[equal]
        if depth:
            yield int(same[0]), depth + 1, size
        if depth + 1 < deepest:
            stack.append((same, depth + 1))


def frequent_phrases(rows: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, length, f) of all phrases of 2 to ``longest`` words counted ``least`` times.

    ``words`` is the written result of :func:`word_counts`, at least of the frequent words.
    """
    spark: SparkSession = rows.sparkSession
    named = words.where("word is not null").select("n", F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), "word")).alias("key"))
    bits = bit_map(named.where(F.col("n") >= least))
    schema = T.StructType.fromDDL("lang string, phrase string, length int, f long")
    if bits is None:
        return spark.createDataFrame([], schema)
    frequent = spark.sparkContext.broadcast(bits)
    crowded = []
    more = bit_map(named.where(F.col("n") > CROWDED))
    while more is not None and len(crowded) + 1 < longest:
        crowded.append(more)
        more = crowded_prefixes(rows, frequent, crowded, CROWDED) if len(crowded) + 1 < longest else None
    total = words.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    routed = spark.sparkContext.broadcast(crowded)
    parcel = to_arrow_schema(T.StructType.fromDDL(PARCEL))

    @tidy
    def pack(batches):
        known: dict[str, Vocabulary] = {}
        for batch in batches:
            for lang, found in _chunks(batch):
                sent = parcels(lang, _vocabulary(known, lang, frequent.value), found, routed.value, longest, n_buckets)
                yield record_batch(sent, parcel)

    out = to_arrow_schema(schema)

    @tidy
    def count(batches):
        current, bucket = None, None

        def results():
            lang, route = current[1:]
            rows = []
            for phrase, length, n in bucket.phrases(route, least):
                rows.append((lang, phrase.decode(), length, n))
                if len(rows) == 20_000:
                    yield record_batch(rows, out)
                    rows = []
            yield record_batch(rows, out)

        for batch in batches:
            for at in range(batch.num_rows):
                number, lang, route, shape, counts, load = (c[at].as_py() for c in batch.columns)
                if (number, lang, route) != current:
                    if bucket is not None:
                        yield from results()
                    current, bucket = (number, lang, route), Bucket(longest)
                bucket.add(shape, counts, load)
        if bucket is not None:
            yield from results()

    n_parts = min(n_buckets, MAX_PARTITIONS)
    sent = rows.mapInArrow(pack, PARCEL)
    dealt = sent.repartitionById(n_parts, F.pmod("bucket", F.lit(n_parts)).cast("int"))
    found = dealt.sortWithinPartitions("bucket", "lang", "route").mapInArrow(count, schema)
    whole = found.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f"))
    return whole.where(F.col("f") >= least)


def _looked_up(rows: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count ``name`` of the phrase in ``key``; parts of very many rows are spread."""
    keys = ["lang", key]
    groups = found.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    if fits_broadcast(groups, BROADCAST_ROWS):
        return rows.join(F.broadcast(groups), keys)
    hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("rows")), keys, "rows", HOT_ROWS, BROADCAST_ROWS)
    return spread_join(rows, groups, keys, "phrase", hot, "inner")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``longest`` words (at most 6) within a piece of text, counted
    ``least`` times. A cut after k words gives 1000*a*n/(l*r), rounded down, and the lowest cut is
    the score (ties: the smallest k). A candidate inside a longer one of the same count is dropped. Counts are over
    all rows, repeated ones included; ids are not read. A null language is ``und``; null, empty and
    wordless texts add nothing, and an empty table has no phrases. Extra columns are not read.
    """
    rows = _rows_of(docs, lang_col, text_col)
    counted = word_counts(rows)
    words = materialize(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    longer = materialize(frequent_phrases(rows, words, longest, least), "phrases")
    single = words.where("word is not null").select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("length"), F.col("n").alias("f"))
    known = single.unionByName(longer)

    # Inside a longer phrase of the same count means inside one that is longer by a single word.
    parts = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(parts, 1, F.col("length") - 1), " "), F.array_join(F.slice(parts, 2, F.col("length") - 1), " "))
    inside = longer.where("length > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = longer.join(inside, ["lang", "phrase", "f"], "left_anti").select("lang", "phrase", "length", F.col("f").alias("a"))

    words_of = F.split("phrase", " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words_of, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words_of, F.col("k") + 1, F.col("length")), " ")})
    cuts = _looked_up(_looked_up(cuts, "head", known, "l"), "tail", known, "r")
    totals = words.where("word is null").select("lang", "n")
    hinted = F.broadcast(totals) if fits_broadcast(totals, BROADCAST_ROWS) else totals
    # 1000*a*n has at most 38 digits while a and n stay below 10^17.
    exact = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))"
    score = F.expr(f"{exact} DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))").cast("long")
    scored = cuts.join(hinted, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
