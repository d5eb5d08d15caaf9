"""Odd texts for comparisons with the tokenizer libraries."""
import random


def odd_texts(n=800):
    rng = random.Random(1)
    al = list("ab cde  \n\tàéÉß中文🙂Σςσ İıµ²½'0123_-.,▁") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "the ", "é", "Å",
                                                              "\x1c", "\x85", "\xa0", "ﬁ", "\x00", "ǅ", "<s>", "<unk>", "<0x0A>"]
    return ["".join(rng.choice(al) for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(n)] \
        + ["", "a" * 5000, "ab" * 3000, " " * 999, "The quick brown fox. " * 40]
