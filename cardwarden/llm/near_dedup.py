"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle falls into one of T bins with value i + h, h in [0, 1), by that
round's hash; a bin keeps its least value. After T rounds, round T + j throws everything into bin
j, so all bins fill. Small sets take more rounds, large sets one or two, and sketches agree bin by
bin with the similarity of the sets, with the concentration of independent minima.

Links: texts with one shingle set form a class. A class joins the bucket of each of its bands. In
a few rounds every class proposes one bucket mate of another component, proposals are verified on
full sets, and components merge; so a group of n near copies costs about n verifications. What then
still shares a bucket across components is verified pair by pair; in crowded buckets, members
outside the largest component are compared with all members in blocks that emit links only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.components import connected_components
from cardwarden.llm.substring_dedup import Hasher, mix
from cardwarden.llm.words import free_name, record_batch, slim, tidy
from cardwarden.operators.joins import hot_keys, spread_join
from cardwarden.session import materialize

#: Bins of a sketch; bands times rows of a band are the bins.
BINS, ROWS = 128, 4
THRESHOLD_PERCENT = 80
#: Rounds of single proposals before the rest is listed; they only save verifications.
PROPOSALS = 2
#: Members of a bucket above which its remaining pairs are compared in blocks of this size.
CROWDED, BLOCK = 64, 512
#: Lists of ids up to this length are broadcast (16 bytes an entry), longer ones are shuffled.
BROADCAST_IDS = 1_000_000
#: A key with more rows than this, and than an even task of a shuffle, is salted.
HOT_ROWS = 1000

_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x100000001B3)


def shingles(text: bytes, size: int, hasher: Hasher) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles, A-Z lower-cased.

    A text of fewer words is one shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hasher(words)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix(out) * _STEP + h[i : len(h) - n + 1 + i]
        return np.unique(mix(out + np.uint64(n)))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: round in the high byte, hash below it."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < bins:
            rounds = min(max(1, 5 * bins // len(items)), bins - i)
            h = mix(items[None, :] ^ _SEEDS[i : i + rounds, None])
            value = (h >> np.uint64(8)) | (np.arange(i, i + rounds, dtype=np.uint64)[:, None] << np.uint64(56))
            np.minimum.at(out, (h & np.uint64(bins - 1)).astype(np.intp).ravel(), value.ravel())
            i += rounds
            if out.max() != np.iinfo(np.uint64).max:
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            h = mix(items ^ _SEEDS[bins + j])
            out[j] = (h.min() >> np.uint64(8)) | np.uint64((bins + int(j)) << 56)
    return out


def band_keys(bins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        bands = bins.reshape(-1, rows)
        key = np.arange(1, len(bands) + 1, dtype=np.uint64)
        for i in range(rows):
            key = mix(key * _STEP + bands[:, i])
        return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = THRESHOLD_PERCENT) -> bool:
    """100 * |intersection| >= percent * |union|; empty sets are linked with nothing."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _few(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _hot(counts: DataFrame, key: str) -> DataFrame | None:
    """Keys of the written table ``counts`` (key, k) with more rows than an even task would get.

    Fewer keys than partitions can have so many rows, which bounds the list that is broadcast.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("k").alias("rows")).first()["rows"] or 0
    return hot_keys(counts, [key], "k", max(HOT_ROWS, total // tasks), tasks)


def _spread(rows: DataFrame, groups: DataFrame, key: str, id_col: str, how: str = "inner") -> DataFrame:
    """The written ``rows`` joined to ``groups``, one row a key, with the keys counted and hot ones salted."""
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("k")), "key-counts")
    return spread_join(rows, groups, [key], id_col, _hot(counts, key), how)


class _Finder:
    def __init__(self, docs: DataFrame, size: int, percent: int, broadcast_ids: int = BROADCAST_IDS, crowded: int = CROWDED):
        self.docs, self.size, self.percent = docs, size, percent
        self.broadcast_ids, self.crowded = broadcast_ids, crowded
        #: Hot band keys and their salts.
        self.hot: DataFrame | None = None

    def _hint(self, ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if _few(ids, self.broadcast_ids) else ids

    def sketches(self) -> DataFrame:
        """(doc_id, n_shingles, print, bands) of every row."""
        size = self.size
        fields = [self.docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, print binary, bands array<long>").fields]
        out = T.StructType(fields)
        arrow = to_arrow_schema(out)

        @tidy
        def run(batches):
            hasher = Hasher()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    items = shingles(text or b"", size, hasher)
                    mark = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                    keys = band_keys(sketch(items)) if len(items) else None
                    rows.append((doc_id, len(items), mark, keys))
                yield record_batch(rows, arrow)

        return self.docs.mapInArrow(run, out)

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those rows of the written table ``pairs`` (a, b, ...) whose full sets are linked."""
        size, percent = self.size, self.percent
        hinted = self._hint(pairs)
        left = hinted.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        if hinted is not pairs:
            ends = F.broadcast(pairs.select(F.col("b").alias("doc_id")).distinct())
            texts = texts.join(ends, "doc_id", "left_semi")
        # Many classes may propose one mate.
        mates = materialize(pairs.groupBy("b").agg(F.count("*").alias("k")), "mates")
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        both = spread_join(left, right, ["b"], "a", _hot(mates, "b"), "inner").select(*pairs.columns, "ta", "tb")
        schema, names, n = pairs.schema, pairs.columns, len(pairs.columns)
        arrow = to_arrow_schema(schema)

        @tidy
        def run(batches):
            hasher = Hasher()
            recent: dict[bytes, np.ndarray] = {}

            def items(text):
                if text not in recent:
                    if len(recent) > 64:
                        recent.clear()
                    recent[text] = shingles(text, size, hasher)
                return recent[text]

            for batch in batches:
                yes = [linked(items(s), items(t), percent) for s, t in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
                kept = batch.select(names).filter(pa.array(yes, pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow)], schema=arrow)

        return materialize(both.mapInArrow(run, schema), "links-of-round")

    def _ratio(self) -> F.Column:
        return 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")

    def proposals(self, live: DataFrame, turn: int) -> DataFrame:
        """One pair for each class at most: with a mate of another component that it shares most
        buckets with. The mate of a bucket is its most central member, in later turns any."""
        order = F.struct(-F.col("central"), F.col("doc")) if turn == 0 else F.xxhash64("doc", F.lit(turn))
        first = live.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("doc").alias("mate"), F.col("n").alias("nb"), F.col("comp").alias("mc"))).alias("f"))
        first = first.select("key", "f.mate", "f.nb", "f.mc")
        seen = spread_join(live.withColumnRenamed("n", "na"), first, ["key"], "doc", self.hot, "inner")
        seen = seen.where((F.col("comp") != F.col("mc")) & self._ratio())
        shared = seen.groupBy("doc", "mate", "comp", "mc").agg(F.count("*").alias("k"))
        best = shared.groupBy("doc").agg(F.max(F.struct("k", (-F.col("mate")).alias("m"), "comp", "mc")).alias("x"))
        mate = -F.col("x.m")
        ends = [F.col("doc").alias("a"), mate.alias("b"), F.col("x.comp").alias("ca"), F.col("x.mc").alias("cb")]
        return best.select(*ends)

    def with_centrality(self, live: DataFrame) -> DataFrame:
        """``live`` with the members ``k`` of all buckets that a class is in, added up. The text that a
        group's copies come from shares buckets with most of them, so it is the mate to try first."""
        central = live.groupBy("doc").agg(F.sum("k").alias("central"))
        return live.join(central, "doc").select("key", "doc", "n", "comp", "central")

    def remaining(self, live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What still shares a bucket across components: all pairs of small buckets, as (a, b),
        and the rows of crowded buckets, with each bucket's largest component as ``top``."""
        per = live.groupBy("key", "comp").agg(F.count("*").alias("k"))
        kinds = per.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("size"))
        kinds = kinds.where("comps > 1").select("key", F.col("top.comp").alias("top"), "size")
        mixed = materialize(spread_join(live, kinds, ["key"], "doc", self.hot, "inner"), "mixed")
        crowds = mixed.where(F.col("size") > self.crowded).select("doc", "comp", "top").distinct()
        return self._across(mixed.where(F.col("size") <= self.crowded), ["key"]), materialize(crowds, "crowds")

    def crowded_links(self, crowds: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between components in crowded buckets: the members outside a bucket's largest
        component are a query set, compared with all its members block by block. Each block pair
        counts common shingles through one sorted index; only links leave it."""
        size, percent = self.size, self.percent
        outside = F.col("comp") != F.col("top")
        sizes = crowds.groupBy("top").agg(F.count("*").alias("all"), F.count_if(outside).alias("some"))
        cells = [F.ceil(F.col(c) / F.lit(BLOCK)).cast("int").alias(n) for c, n in (("all", "rows"), ("some", "cols"))]
        sizes = sizes.where("some > 0").select("top", *cells)
        held = texts.join(self._hint(crowds).withColumnRenamed("doc", "doc_id"), "doc_id").join(sizes, "top")
        held = materialize(held.select("top", F.col("doc_id").alias("doc"), "comp", "text", "rows", "cols"), "crowd-texts")

        def every(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        row = F.pmod(F.xxhash64("doc"), F.col("rows")).cast("int")
        col = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("cols")).cast("int")
        left = held.select("top", row.alias("i"), every("cols").alias("j"), "doc", "comp", "text")
        right = held.where(outside).select("top", every("rows").alias("i"), col.alias("j"), "doc", "comp", "text")
        out = T.StructType.fromDDL("a long, b long")
        arrow = to_arrow_schema(out)

        def block(members: pa.Table, queries: pa.Table) -> pa.Table:
            hasher = Hasher()
            sets = [shingles(t, size, hasher) for t in members["text"].to_pylist()]
            docs, comps = members["doc"].to_numpy(), members["comp"].to_numpy()
            values = np.concatenate([np.zeros(0, np.uint64), *sets])
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            lengths = np.array([len(x) for x in sets])
            links = []
            for doc, comp, text in zip(*(queries[c].to_pylist() for c in ("doc", "comp", "text"))):
                own = shingles(text, size, hasher)
                first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                spans = last - first
                at = np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                yes = (100 * common >= percent * (lengths + len(own) - common)) & (comps != comp)
                links += [(min(doc, d), max(doc, d)) for d in docs[yes].tolist()]
            return pa.Table.from_batches([record_batch(links, arrow)], schema=arrow)

        cell = ["top", "i", "j"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(block, out)
        return materialize(found, "crowd-links")

    def _across(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """Pairs of different components that share ``key``; one end is outside its top one."""
        a = rows.where("comp <> top").select(*key, F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        b = rows.select(*key, F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "top")
        once = (F.col("cb") == F.col("top")) | (F.col("a") < F.col("b"))
        pairs = a.join(b, key).where((F.col("ca") != F.col("cb")) & once & self._ratio())
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(live: DataFrame, links: DataFrame) -> DataFrame:
    """``live`` after the new links (ca, cb) joined components, followed for two steps.

    Long chains of components may stay in parts until the end; that costs verifications, no links.
    """
    up = links.select(F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("to"))
    up = materialize(up.groupBy("comp").agg(F.min("to").alias("to")), "merged")
    again = up.select(F.col("comp").alias("to"), F.col("to").alias("far"))
    up = _spread(up, again, "to", "comp", "left").select("comp", F.coalesce("far", "to").alias("to"))
    moved = _spread(live, up, "comp", "doc", "left")
    return materialize(moved.select("key", "doc", "n", F.coalesce("to", "comp").alias("comp"), "central"), "buckets")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = THRESHOLD_PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
    crowded: int = CROWDED,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least id reachable over links; ``kept`` is true where it is the row's
    own. Null, empty and wordless texts have no shingles and are linked with
    nothing. Rows with a null id are linked with nothing and kept, with a null component. Repeated
    rows get a row each with one component. Ids must be integers; other columns are not read.
    """
    rows = slim(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    finder = _Finder(rows, size, percent, broadcast_ids, crowded)
    marked = materialize(finder.sketches(), "sketches")
    usable = marked.where("n_shingles > 0 and doc_id is not null")
    # Rows of a class have one set, so one sketch.
    facts = [F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("k")]
    classes = usable.groupBy("print").agg(*facts)
    classes = materialize(classes, "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "doc", "n")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "shared-keys")
    finder.hot = _hot(shared, "key")
    live = materialize(spread_join(keyed, shared, ["key"], "doc", finder.hot, "inner").withColumn("comp", F.col("doc")), "buckets")
    live = materialize(finder.with_centrality(live), "central")

    ids = live.select(F.col("doc").alias("doc_id")).distinct()
    texts = rows.where("doc_id is not null").join(finder._hint(materialize(ids, "candidates")), "doc_id", "left_semi")
    if _some(usable.groupBy("doc_id").count().where("count > 1")):
        # Pairs join both ends' texts, so the copies of two ids would multiply.
        texts = texts.dropDuplicates(["doc_id", "text"])
    texts = materialize(texts, "candidate-texts")
    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    for turn in range(PROPOSALS):
        pairs = finder.proposals(live, turn)
        if tested:
            pairs = pairs.join(_both_ways(tested), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "proposed")
        if not _some(pairs):
            break
        tested.append(pairs)
        links.append(finder.verified(pairs, texts))
        live = _merged(live, links[-1])
    # Also where no turn proposed anything: a bucket's other members may still be linked.
    rest, crowds = finder.remaining(live)
    if tested:
        rest = rest.distinct().join(_both_ways(tested), ["a", "b"], "left_anti")
    rest = materialize(rest, "remaining")
    if _some(rest):
        links.append(finder.verified(rest, texts))
    if _some(crowds):
        links.append(finder.crowded_links(crowds, texts))
    return _result(marked, classes, links)


def _both_ways(tested: list[DataFrame]) -> DataFrame:
    pairs = reduce(DataFrame.union, [t.select("a", "b") for t in tested])
    return pairs.union(pairs.select("b", "a"))


def _result(marked: DataFrame, classes: DataFrame, links: list[DataFrame]) -> DataFrame:
    of_class = classes.select("print", "doc")
    if links:
        found = connected_components(reduce(DataFrame.union, [x.select("a", "b") for x in links]))
        of_class = of_class.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    else:
        of_class = of_class.withColumn("component", F.col("doc"))
    of_class = of_class.select("print", F.coalesce("component", "doc").alias("component_id"))
    linked_rows = marked.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "print")
    linked_rows = spread_join(linked_rows, of_class, ["print"], "doc_id", _hot(classes.select("print", "k"), "print"), "inner")
    linked_rows = linked_rows.select("doc_id", "n_shingles", "component_id")
    alone = marked.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One document of each group: the rows of ``docs``, all columns, whose id its component keeps.

    Of several rows with a kept id and one text, all stay.
    """
    gone = near_duplicates(docs, id_col, text_col, size, percent).where("not kept")
    name = free_name("_gone", docs)
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "near-duplicates")
    hinted = F.broadcast(gone) if _few(gone, BROADCAST_IDS) else gone
    return docs.join(hinted, docs[id_col] == gone[name], "left_anti")
