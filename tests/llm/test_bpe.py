from __future__ import annotations

import hashlib
import random
import signal

import pytest
import public_tokenizers
import tiktoken

from mailfleet.llm import bpe
from mailfleet.llm.queries import token_digests, tokenizer
from tests.llm.test_exact_pieces import docs_of

PATH = tokenizer("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    yield from [None, "", " ", "a", "  two  spaces ", "don't I'LL\n\n\tx", "<|endoftext|>", "é́\x85 x",
                "日本語 テキスト 😀👍🏽", "a" * 3000, "ab" * 700 + " " * 50, "\x1c\x1d \x1f​　q",
                "%%%%***&&& 12345 ٣٤ ½"]
    for _ in range(150):
        yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz éüñ \n'!%0123", k=rng.randint(1, 200)))
    for _ in range(40):
        yield "".join(chr(c) for c in rng.choices(range(1, 0x3000), k=60) if not 0xD800 <= c < 0xE000)


def test_ids_are_the_library_s(spark, library):
    docs = list(enumerate(texts()))
    for known in (0, 1000):
        got = {r.doc_id: r.ids for r in bpe.encode(
            docs_of(spark, docs).repartition(3), PATH, public_tokenizers.PATTERN, known_words=known, batch_bytes=900).collect()}
        rows = spark.createDataFrame([(i, ids) for i, ids in got.items()], "doc_id bigint, ids array<int>")
        assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(rows, PATH).collect()} == {i: t or "" for i, t in docs}
        for i, text in docs:
            assert list(got[i]) == library.encode_ordinary(text or ""), text


def test_documents_and_round_trip(spark, library, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in token_digests(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_white_space_and_letters_as_the_library(library):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    odd = []
    for start in range(0, 0x30000, 64):
        chars = "".join(f"{chr(c)}a1 " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        words = pattern.findall(chars)
        if [t for w in words for t in library.encode_ordinary(w)] != library.encode_ordinary(chars):
            odd.append(start)
    assert not odd


def test_empty_table(spark):
    assert token_digests(docs_of(spark, [])).count() == 0
    assert [r.n_tokens for r in token_digests(docs_of(spark, [(None, None), (4, "x"), (4, "x")])).collect()] == [0, 1, 1]


def test_every_pair_has_its_slot():
    """Rows of hundreds of right ids, laid between others, once were tried for ever."""
    pairs = bpe.mergeable(bpe.ranks_of(PATH))
    signal.alarm(120)
    starts, slots = bpe.displaced(pairs)
    signal.alarm(0)

    def found(left, right):
        at = starts[left] + right
        return slots[at] & 65535 if at < len(slots) and slots[at] is not None and slots[at] >> 16 == left else None

    assert all(found(key >> 16, key & 65535) == merged for key, merged in pairs.items())
    rng = random.Random(5)
    others = {(rng.randrange(len(starts)), rng.randrange(50_000)) for _ in range(50_000)}
    assert all(found(a, b) == pairs.get(a << 16 | b) for a, b in others)
    assert bpe.displaced({}) == ([0], [None])


def test_fast_words_are_the_pattern_s():
    """The spelled-out classes against the pattern's own library: all characters, and odd mixtures of them."""
    import regex

    assert public_tokenizers.PATTERN == bpe.WORDS
    find, want = bpe._finder(bpe.WORDS), regex.compile(bpe.WORDS).findall
    rng = random.Random(8)
    odd = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u180e\u200b'sdtmrevlab1½é.,-日\U0001f600"
    tried = ["".join(rng.choices(odd + "    '", k=rng.randint(1, 30))) for _ in range(5000)]
    tried += ["".join(rng.choices(odd[:-1] + "    '", k=rng.randint(1, 30))) for _ in range(5000)]
    tried += ["".join(f"{chr(c)}a1 '{chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
              for start in range(0, 0x110000, 64)]
    assert all(find(text) == want(text) for text in tried)
    assert bpe._finder(r"\w+|\W+")("a b,") == ["a", " ", "b", ","]


def test_plans_do_not_print_the_rank_table(spark, capsys):
    """Megabytes of ranks in each printed plan once filled the driver."""
    out = token_digests(docs_of(spark, [(1, "some words"), (2, "more")]))
    assert out.count() == 2
    out.explain("formatted")
    out.explain("extended")
    assert 500 < len(capsys.readouterr().out) < 100_000
