import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from touchline.llm import tokens as T


def reference():
    t = Tokenizer.from_file(T.tokenizer_path())
    t.encode_special_tokens = True
    return t


def streamed(x, vocab, step):
    e, got = T.Encoder(vocab), []
    for i in range(0, len(x), step):
        got += e.feed(x[i : i + step])
    return got + e.finish()


def test_stream_equals_whole(monkeypatch):
    vocab, ref = T.vocabulary(T.tokenizer_path()), reference()
    monkeypatch.setattr(T, "OPEN", 24)
    random.seed(11)
    for _ in range(120):
        parts = ["a", "ab", "the", "  ", " ", "\n", "'re", "!!", "éé", "99", "日本", "<|endoftext|>"]
        x = "".join(random.choice(parts) * random.randint(1, 40) for _ in range(5))
        got = streamed(x, vocab, random.choice([1, 3, 7, 50]))
        assert got == ref.encode(x, add_special_tokens=False).ids
        d, text = T.Decoder(vocab), ""
        for i in got:
            text += d.feed([i])
        assert text + d.finish() == x


def test_lookahead_is_sufficient_and_needed(monkeypatch):
    """Tokens emitted with the computed lookahead are those of the whole word; without it they aren't."""
    vocab, ref = T.vocabulary(T.tokenizer_path()), reference()
    assert 8 <= vocab.lookahead <= 4 * vocab.longest
    random.seed(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ing", "=-", "日本語のé", "0123456789", "ACEIMNRSTaeinorst"]
    words = ["".join(random.choice(a) for _ in range(random.randint(300, 3000))) for a in alphabets * 6]
    pieces = [t.decode() for t in vocab.ids if len(t) > 3 and t.isalpha()]
    words += ["".join(random.choice(pieces) for _ in range(300)) for _ in range(30)]
    want = [ref.encode(w, add_special_tokens=False).ids for w in words]
    assert [T.encode(w, vocab) for w in words] == want

    def stable(word, lookahead):
        """Tokens of each prefix that end the lookahead before its end."""
        for n in range(lookahead, len(word), 7):
            end = 0
            for i in vocab.merged(word[:n]):
                end += len(vocab.bytes_of[i])
                if end <= n - lookahead:
                    yield end

    def boundaries(word):
        out, end = set(), 0
        for i in vocab.merged(word):
            end += len(vocab.bytes_of[i])
            out.add(end)
        return out

    raw = [w.encode()[:400] for w in words]
    assert all(set(stable(w, vocab.lookahead)) <= boundaries(w) for w in raw)
    assert not all(set(stable(w, 0)) <= boundaries(w) for w in raw)
    monkeypatch.setattr(vocab, "lookahead", 0)
    vocab.memo.clear()
    assert [T.encode(w, vocab) for w in words] != want


def test_lookahead_of_a_small_list():
    ab, bc = (b"a", b"b"), (b"b", b"c")
    assert T.sufficient_lookahead([]) == 0
    # ab stays whatever follows, once it is there; a waits for one byte
    assert T.sufficient_lookahead([ab]) == 1
    # whether a b is merged depends on c, whether b c is on d
    assert T.sufficient_lookahead([(b"c", b"d"), bc, ab]) == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_merges_follow_from_ranks(name):
    path = f"{T.TOKENIZERS}/{name}.tiktoken"
    vocab = T.Vocabulary(path)
    lib = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})
    for x in ("hello worlds, größte 日本語 Ελλάδα", "x" * 5000, "  \n\n a  ", "naïve façade " * 50):
        assert T.encode(x, vocab) == lib.encode_ordinary(x)


def test_corpus(spark):
    texts = [None, "", " ", "Tore, Tore!", "x" * 9000, "a b " * 3000, "same", "same", "é" * 70_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_corpus(df).collect()}
    ref = reference()
    assert got == {i: ref.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert T.encode_corpus(df.limit(0)).count() == 0
    counted = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df).collect()}
    assert counted == {k: len(v) for k, v in got.items()}
