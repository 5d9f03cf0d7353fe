import hashlib
import itertools
import random

import public_tokenizers
from tokenizers import Tokenizer

from tidewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "  two  spaces ", "tab\tand\nline\r\nends\n\n", "it's we'll I'm", "x" * 5000, "no safe point" * 1, "日本語の文章" * 400, "naïve café – “quoted” …",
    "before<|endoftext|>after <|endoftext|> end", " non breaking　wide", "\x1c\x1d odd \x85 controls", "emoji 👩‍👩‍👧 joined", "á combining ﬀ", "1234567890 12 3,4.5", "end in spaces   ", "ʰmodifier ⅷ roman ² sup",
]


def test_ids_and_text_equal_the_library(spark):
    words = "The quick brown fox, jumped over; it's a lazy dog's 123 back! été über señor".split()
    long = [" ".join(words[(7 * i + k * k) % len(words)] + ("\n" if i % 11 == 0 else "") for i in range(1500)) for k in range(4)]
    texts = TEXTS + long + [TEXTS[8] + t + TEXTS[10] for t in long] + [long[0] * 2]
    own = Tokenizer.from_file(PATH)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encoded(rows, PATH).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = own.encode(t, add_special_tokens=False).ids
        back = own.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), t[:50]
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_ids_of_both_encoders_on_single_characters():
    c, own = bpe.coder(PATH), Tokenizer.from_file(PATH)
    for code in [*range(1, 0x300), *range(0x2000, 0x2070), 0x20AC]:
        t = f"a{chr(code)} {chr(code)}b {chr(code)}{chr(code)}\n"
        assert c.encode(t) == own.encode(t, add_special_tokens=False).ids, hex(code)


def test_chunks_are_reused_and_join_to_the_text():
    c = bpe.Coder(PATH)
    shared = " ".join(f"word{i * i % 9973} and" for i in range(3000))
    a, b = ("first text. " + shared).encode(), ("another beginning, " + shared).encode()
    assert b"".join(p for p, _ in c.parts(a)) == a and b"".join(p for p, _ in c.parts(b)) == b
    assert len({p for p, core in c.parts(a) if core} & {p for p, core in c.parts(b) if core}) > 5


def test_joins_cut_anywhere_are_repaired_until_ids_agree(monkeypatch):
    c, own, rng = bpe.Coder(PATH), Tokenizer.from_file(PATH), random.Random(4)
    words = "Überraschend don't tokens  of\n many , kinds; 12345 é".split(" ")

    def anywhere(text):
        cuts = sorted({len(text.decode()[: rng.randrange(len(text.decode()) + 1)].encode()) for _ in range(6)} | {0, len(text)})
        return [(text[a:b], k % 2 == 0) for k, (a, b) in enumerate(itertools.pairwise(cuts))]

    monkeypatch.setattr(c, "parts", anywhere)
    for n in range(1, 80):
        t = " ".join(rng.choice(words) for _ in range(n))
        assert c.encode(t) == own.encode(t, add_special_tokens=False).ids


def test_long_and_unbroken_texts_equal_the_library():
    c, own = bpe.Coder(PATH), Tokenizer.from_file(PATH)
    for t in ("a" * 200_000, "word " * 60_000, "x\n\n " * 30_000):
        assert c.encode(t) == own.encode(t, add_special_tokens=False).ids
        assert c.decode(c.encode(t)) == t


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    c = bpe.Coder(PATH)
    for i in range(200):
        c.both_ways(f"text number {i} of many".encode())
    assert c.held <= 2000


def test_names_that_clash_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "hello world", "x")], "doc_id long, text string, n_tokens string")
    assert bpe.encoded(rows, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encoded(rows.limit(0), PATH).count() == 0
    assert [list(r.token_ids) for r in bpe.with_ids(rows, PATH).collect()] == [[31373, 995]]
