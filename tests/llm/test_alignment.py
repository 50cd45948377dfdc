"""Tokenizer alignment against a brute-force version over whole texts, odd ones included."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import public_tokenizers
from pairlens.llm import tokenizer_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  x  y ", "a b c", "▁x y", "aé日\U0001F600 b\n  <s><0x41> c\tq\x00z", "\U0001FAE0\U0001FAE0 ꙮꙮ é 𒀀𒀁 x", "<|endoftext|> </s> <unk>",
    "x\r\n \r\ny　z z w", "ﬁn Á b", "9" * 3000, "é è", "abc  def ghi\n jkl", "Straße, über die Brücke.", "the cat sat", "the cat sat", "the cats at", "w " * 5000,
]


def brute(rows):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = ta.tokens_of_a(A), ta.tokens_of_b(B)
    made, counts = [], Counter()
    for i, text in rows:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            if b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
                a = b = []
        a_end = dict(zip(np.cumsum([len(a_bytes[k]) for k in a]).tolist(), a))
        b_end = dict(zip(np.cumsum([len(b_bytes[k]) for k in b]).tolist(), b))
        cuts, groups, lo = sorted(a_end.keys() & b_end.keys()), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[e]) for e in x if lo < e <= cut) for x in (a_end, b_end)))
            lo = cut
        links = [(a_end[c], b_end[c]) for c in cuts]
        counts.update(links)
        made.append((i, len(a), len(b), ";".join(groups), links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(i, a, b, len(ls), len(ls), digest(g), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), g) for i, a, b, g, ls in made]


@pytest.mark.parametrize("cut", [True, False])
def test_alignment_against_brute_force(spark, cut, monkeypatch):
    if not cut:  # whole texts as single words give the same
        monkeypatch.setattr(ta.WordAligner, "words", lambda self, texts, plain=ta.WordAligner.words: (setattr(self, "cuttable", False), plain(self, texts))[1])
    rows = [*enumerate(TEXTS), (None, "no id"), (4, "repeated id")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_a string, `odd.name` int").repartition(3)
    made = ta.align(docs, A, B, with_groups=True)
    assert made.columns == ["doc_id", "odd.name", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum"]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum, r.groups) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert ta.align(docs.limit(0), A, B).count() == 0


def test_spans_are_refined_inside_characters():
    aligner = ta.WordAligner(A, B)
    # two tokens share a character of four bytes, one of two bytes follows on its own
    ends, wrong = aligner._ends(np.array([0, 0, 4]), np.array([4, 4, 6]), np.array([3, 1, 2]), np.array([0]), np.zeros(3, np.int64))
    assert ends.tolist() == [3, 4, 6] and not wrong.any()
    assert aligner._ends(np.array([0, 4]), np.array([4, 6]), np.array([3, 2]), np.array([0]), np.zeros(2, np.int64))[1].any()


def test_pairs_stay_below_the_bound():
    a, b = [b"ab", b"b"], [b"b", b"xab"]
    assert ta.pair_bound(a, b) >= 4


def test_new_words_are_encoded_together():
    """Words that stand between cuts go to the tokenizers as one text, with the same tokens as alone; a word that fails there fails alone only."""
    class Counting:
        def __init__(self, model):
            self.model, self.texts = model, 0

        def encode_batch(self, texts, **options):
            self.texts += len(texts)
            return self.model.encode_batch(texts, **options)

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinst.0é日'"), int(n))) for n in rng.integers(1, 12, 800)]
    words = [w.encode() for w in dict.fromkeys([*words, "▁x", "a▁", " ", "", "x\n", "\ny", "<s>", "ﬁn", "́e", "9" * 300])]
    together, alone = ta.WordAligner(A, B), ta.WordAligner(A, B)
    together.a_model = Counting(together.a_model)
    together._align(words)
    alone.cuttable = False
    alone._align(words)
    for aligner in (together, alone):
        aligner._settle()
    assert together.a_model.texts < len(words) // 2
    for w in words:
        i, j = together.number[w], alone.number[w]
        assert together.good[i] == alone.good[j] and together.shown[i] == alone.shown[j]
        if alone.good[j]:
            assert (together.n_a[i], together.n_b[i]) == (alone.n_a[j], alone.n_b[j])
            assert together.links(np.array([i])).tolist() == alone.links(np.array([j])).tolist()
