"""The registered queries, with their production parameters, over a whole sample table against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from sluice.llm import html, pii
from sluice.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def auc(good, bad):
    return np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])


@pytest.mark.parametrize("name, label, modulus, rest, cut", [("op1_toxicity", "toxic", 3, 1, 0.7), ("op9_quality", "quality", 5, 0, 0.3)])
def test_scores(spark, name, label, modulus, rest, cut):
    """On the next larger tables: the smallest have some forty labels to learn from."""
    data = DATA.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = QUERIES[name](spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert by_text.setdefault(docs[r.doc_id], r.score) == r.score, "equal texts, equal scores"
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert auc([s for s, y in held if y], [s for s, y in held if not y]) > 0.9


def test_main_texts(spark, run):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = run("op2_html")
    assert sorted(r.page_id for r in rows) == sorted(pages) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        # The sample's articles hold no other part; block tags part words, inline ones don't.
        held = " ".join(re.findall(r"<article\b[^>]*>(.*?)(?:</article>|\Z)", pages[r.page_id], re.DOTALL))
        if held and not re.search(r"<(script|style|aside|nav|form|footer|header|div|section|table|!--)", held):
            plain = html.references.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(b|i|em|strong|a|span|code|u|sup|sub)\b", m[0]) else " ", held))
            assert r.text == " ".join(plain.split()), r.page_id


def test_media(run, texts):
    rows = run("op3_media")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_private_data(run, texts):
    rows = run("op4_pii")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda t: re.sub("[^0-9]", "", t)
    legal = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 16 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 8 <= len(digits(t)) <= 15}
    for r in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, texts[r.doc_id]) if legal[k](m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and [s for s in r.spans.split(",") if s.split(":")[0] in patterns] == spans
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in spans) for k in patterns]


def test_packing(run, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rows, docs, sequences = run("op5_packing"), {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, own in docs.items():
        ids, at = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes)


def test_byte_level_tokens(run, texts):
    import base64

    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run("op6_bpe")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_neighbours(spark, run):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    found = {}
    for r in run("op7_ann"):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r.score - x[ids.index(r.vec_id)] @ x[ids.index(q)]) < 1e-9 for r in own)
        score = x @ x[ids.index(q)]
        best = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:20]
        hits += len({i for _, i in best} & {r.vec_id for r in own})
    assert hits >= 0.9 * 20 * len(found)


def test_repeats(run, texts):
    data = {i: t.encode() for i, t in texts.items()}
    counts = Counter(hash(t[k : k + 200]) for t in data.values() for k in range(len(t) - 199))
    rows = run("op8_repeats")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t, gone = data[r.doc_id], np.zeros(len(data[r.doc_id]) + 1, int)
        for k in range(len(t) - 199):
            if counts[hash(t[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()) if len(t) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()), r.doc_id


def test_near_duplicates(run, texts):
    from test_duplicates_and_search import brute_near

    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in run("op10_near")} == brute_near(texts.items())
