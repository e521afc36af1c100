"""Substring deduplication by super-k-mers of words.

A window is 50 consecutive words; its minimiser is the least hash of its 6-word runs. Consecutive
windows with one minimiser form a super-k-mer: a single packed string that holds them all. Every
string goes to the bucket its minimiser names, so equal windows meet there, and sorting a bucket's
windows finds each repeated one exactly. A bucket is a few megabytes, whatever the corpus.

A passage that very many documents share would crowd its minimiser's bucket with neighbours that
differ. The windows of such minimisers travel one by one, by a 128-bit hash of their words, after
each batch has kept one occurrence of every window; they spread over all buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.words import free_name, record_batch, slim, tidy
from cardwarden.operators.joins import fits_broadcast
from cardwarden.session import materialize

WINDOW, MINIMISER = 50, 6
#: Text bytes that a map step packs together, and packed bytes aimed at for one bucket.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 10 << 20
#: Packed bytes per byte of text: a super-k-mer of w windows repeats the 49 words beside them.
OVERLAP = 3.2
MAX_PARTITIONS = 20_000
#: Minimisers in more super-k-mers than this send their windows one by one. They are looked for
#: in one document of ``HOT_SAMPLE``; the list only decides how windows travel, never the result.
HOT_COUNT, HOT_SAMPLE, HOT_LIST = 512, 8, 1_000_000

#: Repeated (id, text) pairs are broadcast up to this many.
BROADCAST_ROWS = 500_000

PACKED, SINGLE, COVERED = 0, 1, 2
PARCEL = "bucket long, kind int, ids binary, tags binary, starts binary, lengths binary, load binary"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hash(values: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` values, from powers of ``factor`` by doubling."""
    with np.errstate(over="ignore"):
        out, have, power = values, 1, factor
        done, done_len = None, 0
        left = length
        while left:
            if left & 1:
                if done is None:
                    done, done_len = out, have
                else:
                    n = len(values) - done_len - have + 1
                    shift = np.uint64(pow(int(factor), have, 1 << 64))
                    done = done[:n] * shift + out[done_len : done_len + n]
                    done_len += have
            left >>= 1
            if left:
                n = max(0, len(values) - 2 * have + 1)
                out = out[:n] * power + out[have : have + n]
                power, have = power * power, 2 * have
        return mix(done)


def run_min(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each run of ``length`` values."""
    out, have = values, 1
    while 2 * have <= length:
        out, have = np.minimum(out[: len(out) - have], out[have:]), 2 * have
    rest = length - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Hasher:
    """64-bit hashes of words, kept in a dictionary of bounded size."""

    def __init__(self, limit: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        new = set(words).difference(known)
        known.update(zip(new, map(digest, new)))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Chunk:
    """Windows of a few documents: their words, minimisers and places."""

    def __init__(self, texts: list[bytes], window: int, hasher: Hasher):
        split = [t.split() for t in texts]
        self.words = [w for words in split for w in words]
        sizes = np.array([len(words) for words in split])
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        doc = np.repeat(np.arange(len(texts)), sizes)
        self.hashes = hasher(self.words)
        n = len(self.words) - window + 1
        if n <= 0:
            self.valid = np.zeros(0, bool)
            return
        with np.errstate(over="ignore"):
            runs = run_hash(self.hashes, min(MINIMISER, window), _K1)
        self.minimiser = run_min(runs, window - min(MINIMISER, window) + 1)[:n]
        self.doc = doc[:n]
        self.valid = doc[:n] == doc[window - 1 :]

    def super_kmers(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window, windows) of each run of chosen windows with one minimiser and document."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at, at
        m, d = self.minimiser[at], self.doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        return at[heads], np.diff(np.append(heads, len(at)))


def in_sorted(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def chunks_of(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Ids, tags and texts of a batch's documents that can hold a window, a few megabytes each."""
    ids, tags, texts, size = [], [], [], 0
    for doc_id, tag, text in zip(*(batch.column(i) for i in range(3))):
        text = text.as_py() or b""
        if doc_id.as_py() is None or len(text) < 2 * window - 1:
            continue
        ids.append(doc_id.as_py()), tags.append(tag.as_py()), texts.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield ids, tags, texts
            ids, tags, texts, size = [], [], [], 0
    if ids:
        yield ids, tags, texts


def parcels(chunk: Chunk, ids: np.ndarray, tags: np.ndarray, window: int, hot: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """What one chunk sends: packed strings by minimiser, single windows, windows known covered."""
    if not len(chunk.valid):
        return
    press = zstandard.ZstdCompressor(level=1, write_content_size=True)
    crowded = in_sorted(chunk.minimiser, hot) & chunk.valid

    def send(kind, bucket, docs, starts, lengths, loads):
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            load = press.compress(loads(part))
            d = docs[part]
            place = (starts[part] - chunk.first[d]).astype(np.int32)
            yield (int(bucket[part[0]]), kind, ids[d].tobytes(), tags[d].tobytes(), place.tobytes(), lengths[part].astype(np.int32).tobytes(), load)

    starts, counts = chunk.super_kmers(chunk.valid & ~crowded)
    if len(starts):
        bucket = (mix(chunk.minimiser[starts]) % np.uint64(n_buckets)).astype(np.int64)
        words, a, b = chunk.words, starts.tolist(), (starts + counts + window - 1).tolist()
        yield from send(PACKED, bucket, chunk.doc[starts], starts, counts, lambda p: b"\n".join([b" ".join(words[a[i] : b[i]]) for i in p.tolist()]))

    at = np.flatnonzero(crowded)
    if not len(at):
        return
    with np.errstate(over="ignore"):
        one = run_hash(chunk.hashes, window, _K1)[at]
        two = run_hash(mix(chunk.hashes + _K2), window, _K2)[at]
    owner = ids[chunk.doc[at]]
    least, group = least_owner(one, two, owner)
    mine = owner == least[group]
    if (~mine).any():
        gone = np.zeros(len(chunk.valid), bool)
        gone[at[~mine]] = True
        s, c = chunk.super_kmers(gone)
        bucket = (mix(chunk.minimiser[s]) % np.uint64(n_buckets)).astype(np.int64)
        yield from send(COVERED, bucket, chunk.doc[s], s, c, lambda p: b"")
    at, one, two = at[mine], one[mine], two[mine]
    bucket = (one % np.uint64(n_buckets)).astype(np.int64)
    both = np.stack([one, two], 1)
    yield from send(SINGLE, bucket, chunk.doc[at], at, np.ones(len(at), np.int32), lambda p: both[p].tobytes())


def least_owner(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least owner of each distinct (one, two), and each row's group."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return np.minimum.reduceat(owner[order], np.flatnonzero(new)), group


class Bucket:
    """Collects the parcels of one bucket and finds the windows that a smaller document holds."""

    def __init__(self, window: int):
        self.window = window
        self.parts: dict[int, list[tuple]] = {PACKED: [], SINGLE: [], COVERED: []}
        self.open = zstandard.ZstdDecompressor()

    def add(self, kind, ids, tags, starts, lengths, load) -> None:
        arrays = [np.frombuffer(x, t) for x, t in zip((ids, tags, starts, lengths), (np.int64, np.int32, np.int32, np.int32))]
        self.parts[kind].append((*arrays, load))

    def _joined(self, kind: int) -> list[np.ndarray]:
        return [np.concatenate([p[i] for p in self.parts[kind]]) for i in range(4)]

    def covered(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids, tags, first windows, numbers of windows) of runs of repeated windows."""
        if self.parts[COVERED]:
            yield tuple(self._joined(COVERED))
        if self.parts[SINGLE]:
            ids, tags, starts, lengths = self._joined(SINGLE)
            load = b"".join(self.open.decompress(p[4]) for p in self.parts[SINGLE])
            both = np.frombuffer(load, np.uint64).reshape(-1, 2)
            least, group = least_owner(both[:, 0], both[:, 1], ids)
            gone = ids > least[group]
            yield ids[gone], tags[gone], starts[gone], lengths[gone]
        if self.parts[PACKED]:
            yield self._packed()

    def _packed(self) -> tuple[np.ndarray, ...]:
        ids, tags, starts, counts = self._joined(PACKED)
        known = defaultdict(count().__next__)  # a word's number is the next one when it is first met
        pieces = []
        for part in self.parts[PACKED]:
            words = self.open.decompress(part[4]).split()
            pieces.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        word = np.concatenate(pieces)
        # Windows of a super-k-mer start at its first words; the last 49 start none.
        n = counts.astype(np.int64)
        base = np.concatenate([[0], np.cumsum(n + self.window - 1)])[:-1]
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = base[owner] + inside
        with np.errstate(over="ignore"):
            keys = run_hash(mix(word.astype(np.uint64) + _K2), self.window, _K1)[at]
        order = np.argsort(keys)
        keys = keys[order]
        same = np.concatenate([[False], keys[1:] == keys[:-1]])
        self._confirm(word, at[order], same)
        heads = np.flatnonzero(~same)
        doc = ids[owner[order]]
        least = np.minimum.reduceat(doc, heads)
        gone = np.zeros(len(order), bool)
        gone[order] = doc > np.repeat(least, np.diff(np.append(heads, len(doc))))
        flagged = np.flatnonzero(gone)
        if not len(flagged):
            return ids[:0], tags[:0], starts[:0], counts[:0]
        new = np.concatenate([[True], (flagged[1:] != flagged[:-1] + 1) | (owner[flagged][1:] != owner[flagged][:-1])])
        first = flagged[new]
        length = np.diff(np.append(np.flatnonzero(new), len(flagged)))
        o = owner[first]
        return ids[o], tags[o], (starts[o] + inside[first]).astype(np.int32), length.astype(np.int32)

    def _confirm(self, word: np.ndarray, at: np.ndarray, same: np.ndarray) -> None:
        """Compare the words of neighbours with equal keys; where they differ, part them."""
        span = np.arange(self.window)
        rows = np.flatnonzero(same)
        for k in range(0, len(rows), 20_000):
            r = rows[k : k + 20_000]
            equal = (word[at[r][:, None] + span] == word[at[r - 1][:, None] + span]).all(1)
            same[r[~equal]] = False


RUN = "doc_id long, tag int, starts binary, lengths binary"


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id (``docs``: doc_id, tag, text)."""
    spark = docs.sparkSession
    arrow = to_arrow_schema(T.StructType.fromDDL(PARCEL))
    total = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(least, int(total * OVERLAP) // BUCKET_BYTES + 1)
    hot = spark.sparkContext.broadcast(_hot_minimisers(docs, window))

    @tidy
    def pack(batches):
        hasher = Hasher()
        for batch in batches:
            for ids, tags, texts in chunks_of(batch, window):
                chunk = Chunk(texts, window, hasher)
                rows = list(parcels(chunk, np.array(ids, np.int64), np.array(tags, np.int32), window, hot.value, n_buckets))
                yield record_batch(rows, arrow)

    sent = docs.mapInArrow(pack, T.StructType.fromDDL(PARCEL))
    n_parts = min(n_buckets, MAX_PARTITIONS)
    dealt = sent.repartitionById(n_parts, F.pmod("bucket", F.lit(n_parts)).cast("int"))
    if n_buckets > n_parts:
        dealt = dealt.sortWithinPartitions("bucket")
    out = to_arrow_schema(T.StructType.fromDDL(RUN))

    @tidy
    def find(batches):
        bucket, current = None, None

        def results(b):
            for ids, tags, starts, lengths in b.covered():
                order = np.lexsort((tags, ids))
                ids, tags, starts, lengths = (x[order] for x in (ids, tags, starts, lengths))
                cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])) + 1
                edges = [0, *cuts.tolist(), len(ids)] if len(ids) else [0]
                rows = [(int(ids[a]), int(tags[a]), starts[a:z].tobytes(), lengths[a:z].tobytes()) for a, z in zip(edges, edges[1:])]
                yield record_batch(rows, out)

        for batch in batches:
            for at in range(batch.num_rows):
                number, *row = (c[at].as_py() for c in batch.columns)
                if number != current:
                    if bucket:
                        yield from results(bucket)
                    bucket, current = Bucket(window), number
                bucket.add(*row)
        if bucket:
            yield from results(bucket)

    return dealt.mapInArrow(find, T.StructType.fromDDL(RUN))


def _hot_minimisers(docs: DataFrame, window: int) -> np.ndarray:
    """Minimisers of many super-k-mers, from the documents whose id hashes into the sample."""
    arrow = to_arrow_schema(T.StructType.fromDDL("minimiser long, n long"))

    @tidy
    def count(batches):
        hasher = Hasher()
        for batch in batches:
            for _, _, texts in chunks_of(batch, window):
                chunk = Chunk(texts, window, hasher)
                if len(chunk.valid):
                    starts, _ = chunk.super_kmers(chunk.valid)
                    keys, n = np.unique(chunk.minimiser[starts], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], schema=arrow)

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    counted = some.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    often = materialize(counted.where(F.col("n") > HOT_COUNT // HOT_SAMPLE), "hot-minimisers")
    limit = (often.agg(F.sum("n")).first()[0] or 0) // HOT_LIST  # so the list keeps within HOT_LIST
    rows = often.where(F.col("n") > limit).select("minimiser").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def covered_words(n_words: int, runs: list[tuple[bytes, bytes]], window: int) -> np.ndarray:
    """Which words lie in a window of the runs."""
    step = np.zeros(n_words + 1, np.int64)
    for starts, lengths in runs:
        s, n = np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(lengths, np.int32)
        np.add.at(step, s, 1)
        np.add.at(step, s + n + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _one_each(rows: DataFrame) -> DataFrame:
    """One row per (doc_id, tag). Copies have the same windows in the same places, so one of them
    finds the runs of all; an id that repeats without end sends one row.

    Only ids and hashes are counted; texts move only for those that are repeated.
    """
    keys = ["doc_id", "tag"]
    again = rows.where("doc_id is not null").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    again = materialize(again, "repeated-rows")
    if not again.limit(1).count():
        return rows
    hinted = F.broadcast(again) if fits_broadcast(again, BROADCAST_ROWS) else again
    first = rows.join(hinted, keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"))
    return rows.join(hinted, keys, "left_anti").unionByName(first)


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of runs, and its name. The tag keeps rows apart that share an id, not
    a text; the added names are none of ``docs``."""
    own = F.hash(docs[text_col].cast("binary"))
    rows = slim(docs, id_col, text_col).withColumn("tag", F.hash(F.col("text"))).select("doc_id", "tag", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    name, doc, tag = (free_name(n, docs) for n in ("_runs", "_run_doc", "_run_tag"))
    runs = repeated_runs(_one_each(rows), window).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("starts", "lengths")).alias(name))
    runs = materialize(runs.select(F.col("doc_id").alias(doc), F.col("tag").alias(tag), name), "repeated-runs")
    keys = runs.select(doc, tag)
    on = (docs[id_col].cast("long") == runs[doc]) & (own == runs[tag])
    if not fits_broadcast(keys, BROADCAST_ROWS):
        return docs.join(runs, on, "left").drop(doc, tag), name
    # Only the texts that lose words are shuffled to their runs; the rest stay in the scan.
    hinted = F.broadcast(keys)
    here = (docs[id_col].cast("long") == hinted[doc]) & (own == hinted[tag])
    some = docs.join(hinted, here, "left_semi").join(runs, on).drop(doc, tag)
    return docs.join(hinted, here, "left_anti").withColumn(name, F.lit(None).cast(runs.schema[name].dataType)).unionByName(some), name


def _parts(runs) -> list[tuple[bytes, bytes]]:
    return [(r["starts"], r["lengths"]) for r in runs] if runs is not None else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256. See ``cut_repeats`` for the texts themselves.

    A word goes if a window that covers it also starts in a document with a smaller id. A null or
    empty text has no words; texts under 50 words lose none; rows that share an id don't count
    as smaller than each other; rows with a null id lose nothing and count for nothing. Other
    columns of ``docs`` are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    joined, name = _with_runs(rows, "doc_id", "text", window)
    joined = joined.select("doc_id", F.col("text").cast("binary").alias("text"), name)
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string").fields])
    arrow = to_arrow_schema(out)

    @tidy
    def cut(batches):
        for batch in batches:
            made = []
            for doc_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = (text or b"").split()
                removed = 0
                if runs:
                    gone = covered_words(len(words), _parts(runs), window)
                    removed = int(gone.sum())
                    words_left = [w for w, g in zip(words, gone) if not g]
                else:
                    words_left = words
                made.append((doc_id, len(words), removed, hashlib.sha256(b" ".join(words_left)).hexdigest()))
            yield record_batch(made, arrow)

    return joined.mapInArrow(cut, out)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut from the text, all columns and rows kept.

    A cut word takes the white space after it along, and white space before the first word of such
    a text goes too; texts that lose nothing stay as they are, null included.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(text, s, n):
            if text is None or s is None or not len(s):
                return text
            tokens = _TOKEN.findall(text.encode())
            gone = covered_words(len(tokens), list(zip(s, n)), window)
            return b"".join(t for t, g in zip(tokens, gone) if not g).decode()

        return pd.Series([one(*x) for x in zip(texts, starts, lengths)], dtype=object)

    joined, name = _with_runs(docs, id_col, text_col, window)
    text = F.when(F.col(name).isNotNull(), F.col(text_col))  # other texts stay on the JVM side
    cut_text = cut(text, F.col(f"{name}.starts"), F.col(f"{name}.lengths"))
    return joined.withColumn(text_col, F.coalesce(cut_text, F.col(text_col))).select(*docs.columns)
