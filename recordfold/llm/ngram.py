"""Language-model scores by a weighted backoff automaton.

Tokens are white-space delimited words after lowering A-Z, and one end per
text.  The model interpolates nothing: a bigram that is kept has its discounted
relative frequency; for any other pair the history's backoff weight times the
add-one unigram probability holds, so every history sums to one.  Every bigram
with ``CUTOFF`` occurrences is kept, whatever the size of the corpus.

Automaton: a state for every word and the beginning of a text.  Kept bigrams
are arcs; every state has a failure arc to the root that costs its backoff
weight; the root has an arc for every word.  A text is walked once, from left
to right, adding log10 probabilities.

Scale: counts cover all training texts and stay tables.  Words and arcs with
at least ``SHARE`` of all training tokens are broadcast: at most 1 / SHARE of
each at any size.  This is where the automaton is held, not what it knows: for
all other words and pairs the walk emits (text, hash, occurrences), and a join
with the tables adds the root's arcs and backoff weights of those words, and
for those pairs that are kept the difference between their arc and the failure
path.  Words and pairs are told apart by 64-bit hashes.
"""
from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordfold.llm import common
from recordfold.llm.simhash import LOWER

SHARE, CUTOFF, DISCOUNT = 1e-6, 2, 0.75
#: Jobs that score the texts one after another: the shuffled rows of one are on disk at a time.
SLICES = 3
#: A join's tables are hashed, and the rows of the texts not sorted, while each of their partitions is at most this.
HASHED = "64MB"
#: Entries of a task's count table before it is handed on, and of its memo.
HELD, MEMO = 400_000, 300_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


#: Hashes of the beginning and the end of a text: of white space, which no word is.
START, END = _signed(xxhash.xxh64_intdigest(b"\n")), _signed(xxhash.xxh64_intdigest(b" "))


def pair_hash(a: Column, b: Column) -> Column:
    """Hash of a pair of word hashes: the left one xor the right one turned by 21 bits."""
    return a.bitwiseXOR(F.shiftleft(b, 21).bitwiseOR(F.shiftrightunsigned(b, 43)))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``pair_hash`` of arrays."""
    turned = b.view(np.uint64)
    return a ^ (turned << np.uint64(21) | turned >> np.uint64(43)).view(np.int64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id's text (null: empty) modulo ``folds`` is ``fold``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Numbers(dict):
    """A task's own numbers of words, filled on use, with the words' hashes.
    The beginning of a text is 0, the end 1."""

    def __init__(self):
        super().__init__()
        self.hashes = array("q", (START, END))
        self.found = np.empty(0, np.int64)  # states of the first of them

    def __missing__(self, word: bytes) -> int:
        v = self[word] = len(self.hashes)
        self.hashes.append(_signed(xxhash.xxh64_intdigest(word)))
        return v

    def full(self) -> bool:
        return len(self) > MEMO

    def pairs(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left number, right number, tokens of each text) of all pairs of the texts, in order."""
        flat, sizes = [], []
        for t in texts:
            at = len(flat)
            flat.append(0)
            flat.extend(map(self.__getitem__, words(t)))
            flat.append(1)
            sizes.append(len(flat) - at - 1)
        seq = np.array(flat, np.int64)
        right = seq[1:]
        inside = right != 0
        return seq[:-1][inside], right[inside], np.array(sizes, np.int64)


@dataclass
class Model:
    """The broadcast part of the automaton.  State i is the i-th hash, START and END among them."""

    tokens: int  # N, ends included
    types: int  # V, the end included
    ends: int  # training texts
    hashes: np.ndarray  # of the frequent words, ascending
    unigram: np.ndarray  # log10 probability of every state's word
    backoff: np.ndarray  # log10 cost of every state's failure arc
    arcs: np.ndarray  # state * states + state, ascending
    weights: np.ndarray  # log10 probability of the arcs
    whole: bool  # no arc is elsewhere

    def states(self, hashes: np.ndarray) -> np.ndarray:
        """State of every hash, -1 without one."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def walk(self, numbers: Numbers, texts: list) -> tuple[np.ndarray, ...]:
        """Of every text: tokens, frequent tokens, their unigram sum, the sum of
        what is known here.  Then the other words as (text, hash, occurrences,
        occurrences as a history off the arcs), and the other pairs as (text,
        pair hash, occurrences)."""
        left, right, sizes = numbers.pairs(texts)
        hashes = np.frombuffer(numbers.hashes, np.int64).copy()
        state = numbers.found = np.append(numbers.found, self.states(hashes[len(numbers.found):]))
        text, many = np.repeat(np.arange(len(texts)), sizes), len(hashes)
        a, b = state[left], state[right]
        both = (a >= 0) & (b >= 0)
        key = np.where(both, a * len(self.hashes) + b, -1)
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        arc = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
        base = np.where(b >= 0, self.unigram[b], 0.0)
        score = np.where(a >= 0, self.backoff[a], 0.0) + base
        score[arc] = self.weights[at[arc]]
        off, sums = ~arc, lambda x: np.bincount(text, x, minlength=len(texts))
        rare = np.concatenate([(text * many + right)[b < 0], (text * many + left)[(a < 0) & off]])
        split = int((b < 0).sum())
        entries, where = np.unique(rare, return_inverse=True)
        tf = np.bincount(where[:split], minlength=len(entries))
        history = np.bincount(where[split:], minlength=len(entries))
        others = off & (not self.whole)
        pairs, pair_tf = np.unique((text[others] * many + left[others]) * many + right[others], return_counts=True)
        return (sizes, sums(b >= 0).astype(np.int64), sums(base), sums(score),
                entries // many, hashes[entries % many], tf, history,
                pairs // many // many, pair_hashes(hashes[pairs // many % many], hashes[pairs % many]), pair_tf)


# ------------------------------------------------------------------ training

def _sums(table: Counter):
    keys = list(table)
    return pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "n": pa.array([table[k] for k in keys], pa.int64())})


def word_counts(training: DataFrame) -> DataFrame:
    """(h, n): occurrences of every word of the training texts by its hash."""
    def count(batches):
        table: Counter = Counter()

        def out():
            return _sums(Counter({_signed(xxhash.xxh64_intdigest(w)): n for w, n in table.items()}))
        for b in batches:
            for t in b.column("text").to_pylist():
                table.update(words(t))
                if len(table) > HELD:
                    yield out()
                    table.clear()
        if table:
            yield out()
    return training.select("text").mapInArrow(count, "k bigint, n bigint") \
        .groupBy(F.col("k").alias("h")).agg(F.sum("n").alias("n"))


def bigram_counts(training: DataFrame) -> DataFrame:
    """(a, b, n): occurrences of every pair of hashes, the beginning and the end among them."""
    def count(batches):
        numbers, held, size = Numbers(), [], 0

        def out():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            hashes = np.frombuffer(numbers.hashes, np.int64).copy()
            return pa.RecordBatch.from_pydict({"a": pa.array(hashes[k >> 32]), "b": pa.array(hashes[k & 0xFFFFFFFF]),
                                               "n": pa.array(c, pa.int64())})
        for b in batches:
            left, right, _ = numbers.pairs(b.column("text").to_pylist())
            held.append(left << 32 | right)
            size += len(left)
            if size > 8 * HELD or numbers.full():
                yield out()
                numbers, held, size = Numbers(), [], 0
        if size:
            yield out()
    return training.select("text").mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, training: Column, share: float = 0.0, discount: float = DISCOUNT,
          broadcast: float = SHARE) -> tuple[Model, DataFrame]:
    """The broadcast automaton of the rows of ``docs`` for which ``training``
    holds, and the table (k, n, one, back) of the whole one: for words their hash,
    occurrences, root arc and backoff weight, for kept pairs the hash of both
    hashes, null, and what their arc differs from the failure path.

    ``share``: the model also leaves out bigrams below that share of the tokens;
    ``broadcast``: what is at least that share of them is broadcast (changes no score)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED)
    chosen = docs.where(training)
    counts = common.written(word_counts(chosen), "word-counts")
    ends = chosen.count()
    total = counts.agg(F.count("h"), F.sum("n")).first()
    tokens, types = (total[1] or 0) + ends, total[0] + (1 if ends else 0)
    least = max(CUTOFF, math.ceil(tokens * share))
    often = max(least, math.ceil(tokens * broadcast))
    seen = counts.union(spark.createDataFrame([(START, ends), (END, ends)], "h bigint, n bigint"))
    p = (F.col("m") + 1) / F.lit(float(tokens + types + 1))
    pairs = common.written(bigram_counts(chosen).where(F.col("n") >= least)
                           .join(seen.select(F.col("h").alias("b"), F.col("n").alias("m")), "b").select("a", "b", "n", p.alias("p")), "bigrams")
    mass = pairs.groupBy(F.col("a").alias("h")).agg(F.sum(F.col("n") - discount).alias("mass"), F.sum("p").alias("below"))
    back = F.log10((1 - F.col("mass") / F.col("n")) / (1 - F.col("below")))
    words_ = common.written(seen.join(mass, "h", "left").select("h", "n", F.coalesce(back, F.lit(0.0)).alias("back")), "word-backoffs")
    arc = F.log10((F.col("n") - discount) / F.col("m"))
    arcs = common.written(
        pairs.join(words_.select(F.col("h").alias("a"), F.col("n").alias("m"), "back"), "a")
        .select(*(F.when(F.col("n") >= often, c).alias(name) for name, c in (("a", F.col("a")), ("b", F.col("b")), ("arc", arc))),
                pair_hash(F.col("a"), F.col("b")).alias("k"), "n", (arc - F.col("back") - F.log10("p")).alias("one")), "arcs")
    # at most 1 / broadcast rows each: every one has that share of the tokens
    held = words_.where((F.col("n") >= often) | F.col("h").isin(START, END)).toArrow().sort_by("h")
    hashes, n = held["h"].to_numpy(), held["n"].to_numpy()
    top = arcs.where(F.col("n") >= often).select("a", "b", "arc").toArrow()
    unigram = np.log10((n + 1) / (tokens + types + 1))
    model = Model(tokens, types, ends, hashes, unigram, held["back"].to_numpy(), np.empty(0, np.int64), np.empty(0), often <= least)
    key = model.states(top["a"].to_numpy()) * len(hashes) + model.states(top["b"].to_numpy())
    order = np.argsort(key)
    model.arcs, model.weights = key[order], top["arc"].to_numpy()[order]
    one = F.log10(F.col("n") + 1) - math.log10(tokens + types + 1)
    facts = words_.where((F.col("n") < often) & ~F.col("h").isin(START, END)).select(F.col("h").alias("k"), "n", one.alias("one"), "back")
    return model, facts.unionByName(arcs.where(F.col("n") < often).select(
        "k", F.lit(None).cast("bigint").alias("n"), "one", F.lit(0.0).alias("back")))


# ------------------------------------------------------------------- scoring

def score(docs: DataFrame, held: Column, model: Model, facts: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams), score (the automaton), both log10.

    Every row is in one of the ``slices``, by a hash of its id and text; all but
    the last are scored and written here, the last one where the result is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices))
    done = [common.written(_scored(docs.where(own == i), held, model, shared, facts), "lm-scores") for i in range(slices - 1)]
    return reduce(DataFrame.unionByName, done + [_scored(docs.where(own == slices - 1), held, model, shared, facts)])


def _scored(docs: DataFrame, held: Column, model: Model, shared: Broadcast, facts: DataFrame) -> DataFrame:
    """``score`` in one job."""
    doc_type = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                          ("base", pa.float64()), ("score", pa.float64())])
    schema = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("tf", pa.int32()), ("hist", pa.int32()), ("doc", doc_type)])

    def walk(batches):
        m, numbers = shared.value, Numbers()

        def batch(row, k, tf, hist, doc=None):
            cols = (row, k, tf, hist, doc)
            return pa.RecordBatch.from_arrays([pa.nulls(len(row), t.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t.type)
                                               for c, t in zip(cols, schema)], schema=schema)
        for b in batches:
            if numbers.full():
                numbers = Numbers()
            row = b.column("row").to_numpy()
            size, known, base, total, wt, h, tf, hist, pt, pair, pn = m.walk(numbers, b.column("text").to_pylist())
            if not m.ends:
                known = known - 1  # the end is unknown without training texts
            doc = pa.StructArray.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(size), pa.array(known), pa.array(base),
                                              pa.array(total)], fields=list(doc_type))
            zero = np.zeros(len(row), np.int32)
            yield batch(row, row, zero, zero, doc)  # spread by its own number; it adds nothing if a word has that hash
            yield batch(row[wt], h, tf, hist)
            yield batch(row[pt], pair, pn, None)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       held.alias("held_out"), "text")
    parts = rows.mapInArrow(walk, "row bigint, k bigint, tf int, hist int, doc struct<doc_id:bigint,held_out:boolean,"
                                  "n_tokens:bigint,known:bigint,base:double,score:double>")
    word, unseen = F.col("hist").isNotNull(), -math.log10(model.tokens + model.types + 1)
    one = F.col("tf") * F.coalesce("one", F.when(word, unseen).otherwise(0.0))
    # a text's own values one by one: fixed-width, so the aggregate is a hash map
    summed = parts.join(facts, "k", "left").groupBy("row").agg(
        *[F.max(f"doc.{f.name}").alias(f"doc_{f.name}") for f in doc_type],
        F.sum(F.when(word & (F.col("n") > 0), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.when(word, one).otherwise(0.0)).alias("rare"),
        F.sum(one + F.coalesce(F.col("hist") * F.col("back"), F.lit(0.0))).alias("more"))
    return summed.select(
        F.col("doc_doc_id").alias("doc_id"), F.col("doc_held_out").alias("held_out"), F.col("doc_n_tokens").alias("n_tokens"),
        (F.col("doc_known") + F.col("known")).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("doc_base") + F.col("rare")).alias("base_score"), (F.col("doc_score") + F.col("more")).alias("score"))


def train_and_score(docs: DataFrame, share: float = 0.0, broadcast: float = SHARE) -> DataFrame:
    """Learn from the documents that aren't held out and score all.  Null
    texts are just an end; null ids count as an empty id text; repeated rows
    are learnt and scored each; extra columns are ignored; an empty table gives
    an empty result."""
    held = held_out(F.col("doc_id"))
    model, facts = train(docs, ~held, share, broadcast=broadcast)
    return score(docs, held, model, facts)
