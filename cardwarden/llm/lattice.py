"""Subword lattice likelihood: the marginal probability of a text over all segmentations.

The pieces are those of an existing vocabulary file. Such files here hold merge ranks, not
probabilities, so the ranks give starting weights (Zipf's law) and expectation maximisation over
the words of the learning documents turns them into unigram scores; no piece is added or dropped.
A text is its lower-cased words, each led by a word mark, and one end. Words don't share pieces,
so a text's log-probability is the sum of its words', each the outcome of a forward recursion.

Every distinct word is segmented once, in a table of words. Frequent words reach the documents
by broadcast (a list of bounded length), all others by a join.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.substring_dedup import mix
from cardwarden.llm.words import id_remainder, record_batch, slim
from cardwarden.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, END = "▁", "</s>"
#: Rounds of expectation maximisation, and the count that every piece gets in advance.
ROUNDS, PRIOR = 3, 0.1
#: At most this many frequent words are broadcast.
FREQUENT = 200_000
HELD_OUT_MODULUS, HELD_OUT = 7, 2
NO_PIECE = -60.0


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a vocabulary file with starting log-probabilities from their ranks."""
    from sentencepiece import SentencePieceProcessor

    with open(path, "rb") as f:
        p = SentencePieceProcessor(model_proto=f.read())
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not p.is_unknown(i)]
    names = [n for n in names if n != "<s>"]
    weight = {n: 1.0 / (i + 10) for i, n in enumerate(n for n in names if not n.startswith("<"))}
    low = min(weight.values(), default=1.0)
    weight |= {n: low for n in names if n not in weight}
    weight[END] = max(weight.values())
    total = sum(weight.values())
    return {n: math.log(w / total) for n, w in weight.items()}


class Lattice:
    """All segmentations of words into pieces, for many words of one length at a time.

    Scores are natural logarithms. A character that is no piece falls back to its bytes' pieces.
    """

    def __init__(self, pieces: dict[str, float]):
        names = [p for p in pieces if not (p.startswith("<0x") or p == END)]
        self.names, self.end = names, pieces[END]
        self.bytes = [pieces.get(f"<0x{b:02X}>", NO_PIECE) for b in range(256)]
        self.longest = max(map(len, names), default=1)
        keys = np.zeros(len(names), np.uint64)
        for size in {len(p) for p in names}:
            of_size = [i for i, p in enumerate(names) if len(p) == size]
            chars = np.array([[ord(c) for c in names[i]] for i in of_size], np.uint64)
            key = np.zeros(len(of_size), np.uint64)
            for k in range(size):
                key = self._longer(key, chars[:, k])
            keys[of_size] = key
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.maybe = np.zeros(1 << 20, bool)  # rules out most substrings before the search
        self.maybe[keys >> np.uint64(44)] = True
        self.scores = np.array([pieces[p] for p in names])

    @staticmethod
    def _longer(key: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The key of a string that is one character longer."""
        with np.errstate(over="ignore"):
            return mix(key * np.uint64(0x100000001B3) + char)

    def _fallback(self, char: int) -> float:
        return sum(self.bytes[b] for b in chr(char).encode("utf-8", "replace"))

    def edges(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length k: (ids, scores) of the pieces at every place; -1 and -inf for none."""
        out = []
        n = chars.shape[1]
        key = np.zeros(chars.shape, np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            key = self._longer(key[:, : n - k + 1], chars[:, k - 1 :])
            ids = np.full(key.shape, -1)
            scores = np.full(key.shape, -np.inf)
            row, col = np.nonzero(self.maybe[key >> np.uint64(44)])
            found = key[row, col]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            row, col, piece = row[hit], col[hit], self.ids[at[hit]]
            ids[row, col], scores[row, col] = piece, self.scores[piece]
            if k == 1 and len(piece) < key.size:
                missing = ids < 0
                odd, where = np.unique(chars[missing], return_inverse=True)
                scores[missing] = np.array([self._fallback(int(c)) for c in odd])[where]
            out.append((ids, scores))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        stack = np.stack(terms)
        top = stack.max(0)
        return top + np.log(np.exp(stack - top).sum(0))

    def forward(self, edges, n: int, rows: int) -> np.ndarray:
        alpha = np.zeros((n + 1, rows))
        for j in range(1, n + 1):
            alpha[j] = self._sum([alpha[j - k] + edges[k - 1][1][:, j - k] for k in range(1, min(j, len(edges)) + 1)])
        return alpha

    @staticmethod
    def by_length(words: list[bytes]):
        """(places in ``words``, code points) of the words of each length, the end left out."""
        groups: dict[int, list[int]] = defaultdict(list)
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        for i, w in enumerate(words):
            if w:
                groups[len(texts[i])].append(i)
        for size, places in sorted(groups.items()):
            for k in range(0, len(places), max(1, 200_000 // size)):
                part = places[k : k + max(1, 200_000 // size)]
                flat = "".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass")
                yield np.array(part), np.frombuffer(flat, np.uint32).reshape(len(part), size).astype(np.uint64)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability; the end token is b''."""
        out = np.full(len(words), self.end)
        for places, chars in self.by_length(words):
            out[places] = self.forward(self.edges(chars), chars.shape[1], len(places))[-1]
        return out

    def expect(self, words: list[bytes], counts: np.ndarray, into: np.ndarray, bytes_into: np.ndarray) -> None:
        """Add the expected uses of each piece, and of bytes, in words that occur ``counts`` times."""
        for places, chars in self.by_length(words):
            edges, n = self.edges(chars), chars.shape[1]
            alpha = self.forward(edges, n, len(places))
            beta = np.zeros((n + 1, len(places)))
            for i in range(n - 1, -1, -1):
                beta[i] = self._sum([edges[k - 1][1][:, i] + beta[i + k] for k in range(1, min(n - i, len(edges)) + 1)])
            times = counts[places]
            for k, (ids, scores) in enumerate(edges, 1):
                use = np.exp(alpha[: n - k + 1].T + scores + beta[k:].T - alpha[-1][:, None]) * times[:, None]
                known = ids >= 0
                into += np.bincount(ids[known], weights=use[known], minlength=len(into))
                if k == 1 and not known.all():
                    odd, where = np.unique(chars[~known], return_inverse=True)
                    for c, total in zip(odd, np.bincount(where, weights=use[~known])):
                        for b in chr(int(c)).encode("utf-8", "replace"):
                            bytes_into[b] += total


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, n_all) of all tokens; n counts rows with ``learn`` only. The end is b''."""
    out = T.StructType.fromDDL("word binary, n long, n_all long")
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            learn, held = Counter(), Counter()
            for flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = learn if flag else held
                into.update((text or b"").lower().split())
                into[b""] += 1
            rows = [(w, n, n + held.pop(w, 0)) for w, n in learn.items()] + [(w, 0, n) for w, n in held.items()]
            yield record_batch(rows, arrow)

    counted = docs.select("learn", "text").mapInArrow(run, out)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def fit_pieces(words: DataFrame, pieces: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Unigram scores of the pieces after ``rounds`` over (word, n). The driver holds the pieces."""
    sc = words.sparkSession.sparkContext
    out = T.StructType.fromDDL("piece string, uses double")
    arrow = to_arrow_schema(out)
    for _ in range(rounds):
        sent = sc.broadcast(pieces)

        def run(batches, sent=sent):
            lattice = Lattice(sent.value)
            into, from_bytes, ends = np.zeros(len(lattice.names)), np.zeros(256), 0.0
            for batch in batches:
                found, n = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), float)
                lattice.expect(found, n, into, from_bytes)
                ends += sum(c for w, c in zip(found, n) if not w)
            rows = [(p, u) for p, u in zip(lattice.names, into.tolist()) if u]
            rows += [(f"<0x{b:02X}>", u) for b, u in enumerate(from_bytes.tolist()) if u]
            yield record_batch([*rows, (END, ends)], arrow)

        summed = words.where("n > 0").select("word", "n").mapInArrow(run, out).groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = {r["piece"]: r["uses"] for r in summed.collect()}
        total = sum(uses.values()) + PRIOR * len(pieces)
        pieces = {p: round(math.log((uses.get(p, 0.0) + PRIOR) / total), 9) for p in pieces}
        sent.unpersist()
    return pieces


def _frequent_from(words: DataFrame, limit: int) -> int:
    """The least count such that at most ``limit`` words have as many tokens."""
    step = F.floor(F.log2(F.col("n_all").cast("double")) * 8).cast("int")
    sizes = words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["s"]):
        total += row["k"]
        if total > limit:
            break
        least = row["s"]
    if least is None:
        return 1 << 62
    return math.ceil(2 ** (least / 8) - 1e-9)


def lattice_scores(
    docs: DataFrame,
    learn=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces: dict[str, float] | None = None,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a condition on the id column; by default all but one in seven by checksum.
    A null or empty text is the end alone. Rows with a null id are scored, not learned from, and
    not held out. Repeated rows count as often as they occur. With nothing to learn from, counts
    are zero and pieces keep their prior. Other columns are not read.
    """
    rows = slim(docs, id_col, text_col)
    rest = id_remainder(F.col("doc_id"), HELD_OUT_MODULUS)
    rows = rows.withColumn("learn", F.coalesce(rest != HELD_OUT if learn is None else learn, F.lit(False)))
    rows = rows.withColumn("held_out", F.coalesce(rest == HELD_OUT, F.lit(False)))
    counted = materialize(count_words(rows), "words")
    size = counted.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    fitted = fit_pieces(counted, pieces or load_pieces(), rounds)
    words = materialize(_with_scores(counted, fitted), "word-scores")

    least = _frequent_from(words, frequent)
    listed = {bytes(r["word"]): (r["n"], r["lp"]) for r in words.where(F.col("n_all") >= least).toLocalIterator()}
    parts = materialize(_frequent_parts(rows, listed), "score-parts")
    parts_id = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    rare = words.where(F.col("n_all") < least).select("word", "n", "lp")
    found = parts_id.join(rare, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("base"),
        F.sum(F.col("times") * F.col("lp")).alias("lp"),
    )
    total = parts.drop("rare").join(found, "row", "left")
    # The denominator of the base: N + 1 * (V + 1).
    floor = math.log10(size["tokens"] + size["kinds"] + 1)
    base = F.col("base_top") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)
    score = (F.col("lp_top") + F.coalesce("lp", F.lit(0.0))) / F.lit(math.log(10))
    return total.select(
        "doc_id", "held_out", "n_tokens", (F.col("known_top") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(size["tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def _with_scores(counted: DataFrame, pieces: dict[str, float]) -> DataFrame:
    sent = counted.sparkSession.sparkContext.broadcast(pieces)
    out = T.StructType([*counted.schema.fields, T.StructField("lp", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        lattice = Lattice(sent.value)
        for batch in batches:
            word, n, n_all = (batch.column(i).to_pylist() for i in range(3))
            yield record_batch(list(zip(word, n, n_all, lattice.log_probabilities(word).tolist())), arrow)

    return counted.select("word", "n", "n_all").mapInArrow(run, out)


def _frequent_parts(rows: DataFrame, listed: dict[bytes, tuple[int, float]]) -> DataFrame:
    """Per row the sums over frequent words, and its other words with their counts."""
    table = {w: (int(n > 0), math.log10(n + 1), lp) for w, (n, lp) in listed.items()}
    sent = rows.sparkSession.sparkContext.broadcast(table)
    fields = "n_tokens long, known_top long, base_top double, lp_top double, rare array<struct<word:binary,times:long>>"
    out = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *T.StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        table = sent.value
        for batch in batches:
            made = []
            for doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = Counter((text or b"").lower().split())
                counts[b""] += 1
                n = known = 0
                base = lp = 0.0
                rare = []
                for word, times in counts.items():
                    n += times
                    row = table.get(word)
                    if row is None:
                        rare.append({"word": word, "times": times})
                    else:
                        known += times * row[0]
                        base += times * row[1]
                        lp += times * row[2]
                made.append((doc_id, held, n, known, base, lp, rare))
            yield record_batch(made, arrow)

    parts = rows.select("doc_id", "held_out", "text").mapInArrow(run, out)
    return parts.withColumn("row", F.monotonically_increasing_id())

