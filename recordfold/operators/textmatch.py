"""Exact "passage occurs in text" matching with equi-joins only.

If passage P is a substring of text T, every *complete interior word* of P (a
maximal run of word characters that neither starts nor ends P) is also a
complete word of T.  So a passage with an interior word gets one key -- its
longest interior word -- and candidate (text, passage) pairs come from an
equi-join of the texts' distinct words with those keys; ``instr`` then checks
the whole passage.  AQE broadcasts the passage side at run time when it is
small and falls back to a sort-merge join when it is not.

Short passages (two words or fewer) have no interior word.  Their longest
token is still a substring of some word of T, so they go through the corpus
*vocabulary*: distinct words are indexed by their substrings of the lengths in
use, at most GRAM; the token's first (up to) GRAM characters pick candidate words,
``contains`` confirms them, and the confirmed words lead back to the texts by
equi-join.
Passages made only of separators use the same path on the texts' separator
runs.  Empty passages are ignored.  Every candidate is verified with
``instr`` on the full text, so the result is exact.  A passage that is one token
is in a text if it is in one of its words: ``passages_in``, which gives no
offsets, needs no text for these.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordfold.session import materialised

# Anything that is not a letter, digit or underscore separates words.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"
SEP_SPLIT = r"[\p{L}\p{N}_]+"
#: Long enough that few words share a substring of it, in lists as long as the vocabulary too.
GRAM = 8


def passage_keys(passages: DataFrame, text_col: str = "passage") -> DataFrame:
    """Add ``_key`` (longest complete interior word, ties: the first, else NULL)
    and ``_frag`` (longest token, used when there is no interior word)."""
    toks = F.split(F.col(text_col), WORD_SPLIT)
    interior = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))

    def longest(arr):
        ranked = F.transform(arr, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"),
                                                        t.alias("t")))
        return F.when(F.size(arr) > 0, F.array_min(ranked)["t"])

    key = longest(interior)
    frag = longest(toks)
    return (passages.withColumn("_key", F.when(key != "", key))
            .withColumn("_frag", F.when(frag != "", frag)))


def _gram_index(units: DataFrame, lengths: Column) -> DataFrame:
    """(unit, gram) for every distinct substring of the ``lengths`` of each distinct unit."""
    u = F.col("_unit")
    grams = F.transform(F.filter("_lengths", lambda k: k <= F.length(u)), lambda k: F.transform(
        F.sequence(F.lit(1), F.length(u) - k + 1), lambda s: F.substr(u, s, k)))
    return units.select("_unit", lengths.alias("_lengths")) \
        .select("_unit", F.explode(F.array_distinct(F.flatten(grams))).alias("_gram"))


def _unit_hits(texts_units: DataFrame, frags: DataFrame, pids) -> DataFrame:
    """(pids, unit) for every distinct unit that contains the fragment of a passage."""
    vocab = texts_units.select("_unit").distinct()
    lengths = frags.agg(F.collect_set(F.least(F.length("_frag"), F.lit(GRAM)))).scalar()
    index = _gram_index(vocab, lengths)
    fk = frags.withColumn("_gram", F.substring("_frag", 1, GRAM))
    return fk.join(index, "_gram").where(F.col("_unit").contains(F.col("_frag"))).select(*pids, "_unit")


def _via_fragments(texts_units: DataFrame, frags: DataFrame, tids, pids) -> DataFrame:
    """(tids, pids) candidates for passages keyed by a fragment contained in a unit."""
    unit_hits = _unit_hits(texts_units, frags, pids).distinct()
    return texts_units.join(unit_hits, "_unit").select(*tids, *pids).distinct()


def find_passages(texts: DataFrame, text_ids: Sequence[str], text_col: str,
                  passages: DataFrame, passage_ids: Sequence[str], passage_col: str) -> DataFrame:
    """All (text id, passage id, offset) with the passage inside the text.

    ``offset`` is the 1-based position of the first occurrence.
    """
    tids, pids = list(text_ids), list(passage_ids)
    p = passage_keys(passages.select(*pids, F.col(passage_col).alias("_passage"))
                     .where(F.col("_passage").isNotNull() & (F.col("_passage") != "")), "_passage")
    keyed = p.where(F.col("_key").isNotNull())
    short = p.where(F.col("_key").isNull() & F.col("_frag").isNotNull())
    seps = p.where(F.col("_key").isNull() & F.col("_frag").isNull()) \
        .withColumn("_frag", F.col("_passage"))

    def units(split_regex):
        return texts.select(*tids, F.explode(F.array_distinct(F.split(F.col(text_col), split_regex)))
                            .alias("_unit")).where(F.col("_unit") != "")

    words = units(WORD_SPLIT)
    cands = words.join(keyed.select(F.col("_key").alias("_unit"), *pids), "_unit").select(*tids, *pids)
    # The vocabulary paths cost a pass over all words; a one-row probe of the
    # (small) passage side tells whether they are needed at all.
    if short.take(1):
        cands = cands.unionByName(_via_fragments(words, short.select(*pids, "_frag"), tids, pids))
    if seps.take(1):
        cands = cands.unionByName(_via_fragments(units(SEP_SPLIT), seps.select(*pids, "_frag"), tids, pids))

    # Candidates are few next to the texts.  Written first, their size is known:
    # they are broadcast to the texts where that is small, and then no text moves.
    cands = materialised(cands.distinct(), "candidates")
    body = texts.select(*tids, F.col(text_col).alias("_text"))
    both = body.join(cands, tids).join(p.select(*pids, "_passage"), pids)
    offset = F.instr(F.col("_text"), F.col("_passage")).cast("bigint")
    return both.select(*tids, *pids, offset.alias("offset")).where(F.col("offset") > 0)


def passages_in(texts: DataFrame, text_ids: Sequence[str], text_col: str, passages: DataFrame, passage_ids: Sequence[str],
                passage_col: str, about: DataFrame | None = None) -> DataFrame:
    """The distinct (text id, passage id) with the passage inside the text; or,
    with ``about``, these joined to its rows by the passage id and the columns it
    shares with the text id, where rows may repeat: they then move once, without
    an exchange that makes the pairs distinct and one that joins them."""
    tids, pids = list(text_ids), list(passage_ids)
    p = passage_keys(passages.select(*pids, F.col(passage_col).alias("_passage")), "_passage")
    token = F.coalesce(F.col("_key").isNull() & (F.col("_frag") == F.col("_passage")), F.lit(False))
    tokens, others = p.where(token).select(*pids, "_frag"), p.where(~token).select(*pids, "_passage")
    shared = [] if about is None else [c for c in about.columns if c in tids]
    found = None
    if not tokens.isEmpty():
        # a word that is shorter than all tokens contains none
        shortest = tokens.agg(F.min(F.length("_frag"))).scalar()
        unit = F.explode(F.filter(F.array_distinct(F.split(F.col(text_col), WORD_SPLIT)), lambda w: F.length(w) >= F.col("_shortest")))
        words = texts.withColumn("_shortest", shortest).select(*tids, unit.alias("_unit"))
        if about is None:
            found = _via_fragments(words, tokens, tids, pids)
        else:
            known = about.join(_unit_hits(words, tokens, pids), pids)
            found = words.join(known, ["_unit", *shared]).select(*tids, *[c for c in about.columns if c not in tids])
    if found is None or not others.isEmpty():
        more = find_passages(texts, tids, text_col, others, pids, "_passage").select(*tids, *pids).distinct()
        if about is not None:
            more = more.join(about, [*pids, *shared]).select(*tids, *[c for c in about.columns if c not in tids])
        found = more if found is None else found.unionByName(more)
    return found
