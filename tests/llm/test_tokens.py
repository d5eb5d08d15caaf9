import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordfold.llm import bpe_codec, merging, token_counts, transducer
from tests_llm_texts import odd_texts

P = pytest.importorskip("public_tokenizers")


def brute_merge(pairs, seq):
    seq = list(seq)
    while True:
        found = [(pairs[p][0], i) for i, p in enumerate(zip(seq, seq[1:])) if p in pairs]
        if not found:
            return seq
        _, i = min(found)
        seq[i:i + 2] = [pairs[seq[i], seq[i + 1]][1]]


def test_merging_equals_leftmost_lowest_rank():
    rng = random.Random(3)
    for _ in range(30):
        pairs, top = {}, 4
        for rank in rng.sample(range(40), rng.choice([3, 10, 25])):
            a, b = rng.randrange(top), rng.randrange(top)
            if (a, b) not in pairs:
                pairs[a, b] = (rank, top if rng.random() < .8 else rng.randrange(4, top + 1))
                top = max(top, pairs[a, b][1] + 1)
        seqs = [[rng.choice([0, 0, 1, 2, 3, -2]) for _ in range(rng.choice([1, 2, 5, 30]))] for _ in range(60)]
        got, kept = merging.merge_all(merging.PairTable(pairs), np.array(sum(seqs, [])), np.array(list(map(len, seqs))))
        parts = np.split(got, np.cumsum(kept)[:-1])
        assert [p.tolist() for p in parts] == [brute_merge(pairs, s) for s in seqs]


def test_token_counts_equal_the_library(spark, make_docs):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    texts = odd_texts() + [None, "dup", "dup"]
    docs = make_docs([(None if i == 5 else i, t) for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit(-1))
    got = token_counts.token_counts(docs, path, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(None if i == 5 else i, len((t or "").encode()), n, n > 100) for i, (t, n) in
            enumerate(zip(texts, [len(x) for x in sp.encode([t or "" for t in texts], num_threads=1)]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_transducer_is_exact_and_minimal():
    words = [b"", b"a", b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "été".encode(), b"tap"]
    lex = transducer.Lexicon(transducer.compile_lexicon([(w, [k, k + 1]) for k, w in enumerate(words)]))
    probe = [*words, b"ta", b"tapss", b"x"]
    at = lex.find(probe)
    ids = [lex.ids_of(i) if i >= 0 else None for i in at.tolist()]
    assert ids == [None, [1, 2], [2, 3], [3, 4], [4, 5], [5, 6], [6, 7], [7, 8], [8, 9], [2, 3], None, None, None]
    assert len(lex.final) < sum(map(len, set(words)))  # suffixes are shared
    empty = transducer.Lexicon(transducer.compile_lexicon([]))
    assert empty.find([b"a", b""]).tolist() == [-1, -1]


def test_codec_equals_the_library(spark, make_docs):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    texts = odd_texts() + [None, "dup The", "dup The"]
    docs = make_docs(texts).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("x"))
    want = []
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tk.decode(ids, skip_special_tokens=False)))
    got = bpe_codec.encoded(docs, path)
    assert sorted(map(tuple, got.collect())) == want
    assert bpe_codec.digests(docs.limit(0), path).count() == 0
    assert set(bpe_codec.frequent_words(docs)) >= {"the", "quick", "fox", "dup"}
