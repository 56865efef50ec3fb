import base64
import hashlib
import os
import re
import zlib

import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bpe, packing, pii

TEXTS = st.text(st.one_of(st.sampled_from("ab é'sßİΣ\n\t 12.@+-<|"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_bpe_is_the_library_and_round_trips(codec, reference, text):
    packed = codec.encode([text])[0]
    assert ids(packed) == reference.encode_ordinary(text)
    assert codec.decode(packed) == text.encode()


def test_bpe_of_long_pre_tokens(codec, reference):
    for text in ("a" * 5000, "xq" * 3000, "é" * 2000, " " * 3000, "<|endoftext|>"):
        assert ids(codec.encode([text])[0]) == reference.encode_ordinary(text)


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.whole.find(codec.tokens)) == list(range(len(codec.tokens)))
    assert codec.whole.find([b"no such token at all", b""]) == [-1, -1]


def test_bpe_operator_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a b", 5), (3, "a b", 6), (3, "a b", 7)], "doc_id long, text string, ids int")
    args = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    rows = bpe.decode(bpe.encode(docs, *args), *args).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in rows) == [("1", 0, b""), ("2", 0, b""), ("3", 2, b"a b"), ("3", 2, b"a b"), ("None", 2, b"a b")]
    assert bpe.encode(docs.limit(0), *args).count() == 0


# -- private data -----------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(st.sampled_from("ab@.-+_%1234567890 ()é"), max_size=50), st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "@", "10.0.0.255", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "-", ".", " ", "x", "256.1.1.1", "+", "49"]), max_size=10).map("".join)))
def test_base_spans_are_those_of_the_patterns(text):
    found = [s for s in pii.spans(text, ANCHORS) if s[0] in ("email", "ip", "card", "phone")]
    assert found == plain_spans(text)


ANCHORS = pii.automaton()


def test_added_kinds_and_masking():
    text = "See https://user@ex.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 x"
    kinds = [(k, text[a:b]) for k, a, b in pii.spans(text, ANCHORS)]
    assert ("url", "https://user@ex.org/a?b=1") in kinds and ("account", "DE89 3704 0044 0532 0130 00") in kinds and ("account", "12345678") in kinds
    assert pii.masked(text, pii.spans(text, ANCHORS)) == "See [URL]. IBAN: [ACCOUNT], account no. [ACCOUNT] x"


def test_secrets_are_found_and_plain_words_left():
    token, other = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zk3vQ9+/xT7bLm2NpR8sW1yA=="
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc\n+/x=\n-----END RSA PRIVATE KEY-----"
    text = f'so token = "{token}" and API_KEY: {other}, Password="hunter2-Apple" | {pem} accessToken={token}.'
    found = [text[a:b] for k, a, b in pii.spans(text, ANCHORS) if k == "secret"]
    assert found == [token, other, "hunter2-Apple", pem, token]
    for plain in ("the token = value of the thing", "key: internationalisation", "a password: please", "tokens = 04dbebab91ab85687d33", "token 04dbebab91ab85687d33eeaaf9ac699e", 'key = "aaaaaaaaaaaaaaaaaaaaaaaa1"', "monkey = 04dbebab91ab85687d33eeaaf9ac699e"):
        assert not pii.spans(plain, ANCHORS), plain
    assert pii.masked(f'token = "{token}"', pii.spans(f'token = "{token}"', ANCHORS)) == 'token = "[SECRET]"'
    text = f"İ IBAN de89370400440532013000 İİ Token={token}"
    assert [text[a:b] for _, a, b in pii.spans(text, ANCHORS)][-1] == token


def test_no_assigned_token_of_the_sample_is_left(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no sample tables")
    left = pii.find(spark.read.parquet(path), mask=True)
    assert left.where("masked rlike 'token = \"[0-9a-f]{8,}'").count() == 0
    assert left.where("masked like '%token = \"[SECRET]%'").count() > 100


def test_pii_operator_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a@b.cd", 0), (4, "é" * 100_000 + "a@b.cd", 1), (4, "a@b.cd", 1)], "doc_id long, text string, spans int")
    rows = pii.find(docs, mask=True).collect()
    assert sorted((len(r.spans), r.masked is None) for r in rows) == [(0, False), (0, True), (1, False), (1, False), (1, False)]
    assert max(s.start for r in rows for s in r.spans) == 100_000
    assert pii.find(docs.limit(0)).count() == 0


# -- packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.Tokens(f.read())


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_tokens_are_the_tokenizers(tokens, text):
    assert ids(tokens.encode([text])[0]) == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_keeps_every_id_once(spark, parts):
    texts = ["word " * n for n in (0, 1, 5, 300, 2047, 2048, 5000, 17, 900, 900, 900, 1200)] * 4
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y", 1), (99, None, 1)], "doc_id long, text string, offset int").repartition(parts)
    rows = packing.pack_documents(docs, public.path("word_bpe_49k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {*range(len(texts)), None, 99}
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        whole = ids(b"".join(r.ids for r in own))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and len(whole) == own[0].doc_tokens and whole[-1] == 1
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    used = sum(r.length for r in rows)
    padding = sum(2048 - n for own in by_sequence.values() if (n := sum(r.length for r in own)) & (n - 1))
    assert padding <= 0.01 * used
    assert packing.pack_documents(docs.limit(0), public.path("word_bpe_49k.json")).count() == 0


def test_leftovers_end_in_powers_of_two():
    pieces = [packing.Piece(i, 0, bytes(4 * n), n) for i, n in enumerate((700, 2000, 37))]
    sizes = [sum(map(len, w)) for w in packing.end_to_end(pieces, 2048)]
    assert sum(sizes) == 2737 and sizes[0] == 2048 and all(n & (n - 1) == 0 for n in sizes)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
