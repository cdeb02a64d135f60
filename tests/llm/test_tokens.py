import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from lexweave.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "▁x", "a▁▁b", "é\nñ\t日本語 🙂🙂 x", "<s> <unk>", "<0x41>", "ab\x00\x01", "x" * 3000, "<unk><unk>日", "don't", "\u0301e"]


def exact(vocabulary, fall_back):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fall_back))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_match_the_tokenizer(spark, data):
    vocabulary = tokens.read_vocabulary(PATH)
    count, mine = exact(vocabulary, True), tokens.UnigramCounter(vocabulary)
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert [mine.count(x)[0] for x in texts] == [count(x) for x in texts]


def test_ties_in_small_vocabularies():
    rng = random.Random(1)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc▁d日") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        vocabulary = [("<unk>", 0.0)] + [(p, float(rng.randint(-4, 0))) for p in sorted(pieces)]
        count, mine = exact(vocabulary, False), tokens.UnigramCounter(vocabulary)
        for _ in range(10):
            text = "".join(rng.choice("abcd 日é") for _ in range(rng.randint(0, 14)))
            assert mine.count(text)[0] == count(text), (vocabulary, text)


def test_long_words_are_cut_into_windows_without_a_trace(monkeypatch):
    rng = random.Random(3)
    vocabulary = tokens.read_vocabulary(PATH)
    texts = ["".join(rng.choice("ab日🙂é▁xyz12") for _ in range(400)) for _ in range(20)] + ["日" * 500 + "🙂" * 700, "the" * 300]
    want = [tokens.UnigramCounter(vocabulary).segment(x) for x in texts]
    count = exact(vocabulary, True)
    monkeypatch.setattr(tokens, "WINDOW", 7)
    assert [tokens.UnigramCounter(vocabulary).segment(x) for x in texts] == want
    assert [tokens.UnigramCounter(vocabulary).count(x)[0] for x in texts] == [count(x) for x in texts]


def test_a_text_of_one_long_word_takes_little_memory():
    import tracemalloc

    mine = tokens.UnigramCounter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -1.5)] + [(f"<0x{b:02X}>", -9.0) for b in range(256)])
    text = "a" * 300_000 + "🙂" * 300_000
    tracemalloc.start()
    assert mine.count(text)[0] > 1_200_000 and tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 1000)
    mine = tokens.UnigramCounter([("<unk>", 0.0), ("a", -1.0)])
    for i in range(50):
        assert mine.count(f"{i}" * 100)[0] >= 1
        assert sum(map(len, mine.known)) <= 1300


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one two", 5), (3, "one two", 5), (None, "x " * 100_000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.count_tokens(docs, PATH).collect())
    assert got[:2] == [("1", 0), ("2", 0)] and got[2] == got[3] and got[2][1] > 0 and got[4] == ("None", exact(tokens.read_vocabulary(PATH), True)("x " * 100_000))
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0
