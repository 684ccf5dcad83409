"""Byte-level BPE and token alignment against the tokenizers and sentencepiece libraries."""

import hashlib
import os
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import frame, odd

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    from scenaria.llm import byte_tokens as B

    return B.Encoder(B.Automaton()), Tokenizer.from_file(B.MODEL)


def _same(tools, texts):
    encoder, library = tools
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == want.ids, text[:80]
        assert encoder.decode(ids.astype(np.int64)) == library.decode(want.ids, skip_special_tokens=False) == text


def test_automaton_encodes_as_the_library(tools):
    rng = random.Random(3)
    labels = list(tools[0].automaton.ids)
    _same(tools, ["".join(rng.choice("abehtonrsi ") for _ in range(rng.randrange(60))) for _ in range(3000)])
    _same(tools, [c * k for c in ("a", " ", "\n", "-", "ab", "é") for k in range(1, 150)])
    _same(tools, [b"".join(rng.choice(labels) for _ in range(5)).decode("utf-8", "ignore") for _ in range(3000)])
    _same(tools, ["".join(chr(rng.choice([rng.randrange(0x400), rng.randrange(0xD800), rng.randrange(0x10000, 0x110000)])) for _ in range(40)) for _ in range(1500)])
    _same(tools, ["", "a<|endoftext|>b  <|endoftext|><|endoftext|>", "<|endoftext|", "I'll we're IT'S", "x" * 100_000, "漢字" * 30_000])


def test_all_characters_split_as_the_library(tools):
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for s in [*range(0, 0x34000, 128), *range(0x3D000, 0x40000, 128), *range(0xE0000, 0xE0200, 128), 0xF0000, 0x10FF80]:
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(s, s + 128) if not 0xD800 <= c < 0xE000)
        assert tools[0].splitter(text).findall(text) == [text[x:y] for _, (x, y) in library.pre_tokenize_str(text)]


def test_gadgets_tell_which_tokens_may_follow(tools):
    """An arc stands where the library leaves the two tokens' bytes as these two tokens."""
    from tokenizers import Tokenizer, pre_tokenizers

    from scenaria.llm.byte_tokens import MODEL, byte_letters

    library = Tokenizer.from_file(MODEL)
    library.pre_tokenizer = pre_tokenizers.Sequence([])  # words are given as they are
    letter = {b: c for c, b in byte_letters().items()}
    a, rng = tools[0].automaton, random.Random(8)
    ids = list(a.ids.values())
    found = Counter()
    for _ in range(4000):
        x, y = rng.choice(ids[:600]), rng.choice(ids[:600] if rng.random() < 0.5 else ids)
        word = "".join(letter[b] for b in a.labels[x] + a.labels[y])
        assert a.has_arc(x, y) == (library.encode(word, add_special_tokens=False).ids == [x, y])
        found[a.has_arc(x, y)] += 1
    assert min(found.values()) > 50


def test_bad_vocabularies_are_told(tmp_path):
    from scenaria.llm.byte_tokens import Automaton

    with pytest.raises(ValueError):
        Automaton("/opt/tokenizers/word_bpe_49k.json")


def test_byte_tokens_of_odd_rows(spark, tools):
    from scenaria.llm import byte_tokens as B

    df = odd(spark)
    rows = B.token_digests(df).collect()
    want = Counter()
    for r in df.collect():
        ids = tools[1].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert B.token_digests(df.limit(0)).collect() == []
    back = B.decoded(B.encoded(df)).collect()
    assert all(r.decoded == (r.text or "") and r.node == "clash" for r in back) and len(back) == df.count()
    plain = B.encoded(frame(spark, ["a<|endoftext|>"]), specials=False).first().tokens
    assert 50256 not in plain and 50256 in B.encoded(frame(spark, ["a<|endoftext|>"])).first().tokens


def test_whole_query_against_the_library(spark, tools):
    from scenaria.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tools[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def brute_alignment(rows):
    """The contract, written out link by link."""
    import sentencepiece
    from tokenizers import Tokenizer

    from scenaria.llm.byte_tokens import MODEL, byte_letters
    from scenaria.llm.token_alignment import PIECE_MODEL

    a = Tokenizer.from_file(MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    byte = byte_letters()

    def spans(pieces):
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        return list(zip([0, *ends[:-1]], ends))
    done, count = [], Counter()
    for i, text in rows:
        x = y = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            px = [bytes(byte[c] for c in a.id_to_token(t)) for t in x]
            py = [bytes([int(b.id_to_piece(t)[1:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
            if not b"".join(px) == b"".join(py) == (" " + text).encode():
                x = y = []
        if not x:
            done.append((i, 0, 0, 0, [], ""))
            continue
        sx, sy = spans(px), spans(py)
        near = defaultdict(list)  # B tokens by the bytes they hold
        for j, (s, e) in enumerate(sy):
            for k in range(s, e):
                near[k].append(j)
        links = [(x[m], y[j]) for m, (s, e) in enumerate(sx) for j in sorted({j for k in range(s, e) for j in near[k]})]
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        sides = [defaultdict(list), defaultdict(list)]
        for of, ids, spans_of in ((sides[0], x, sx), (sides[1], y, sy)):
            for t, (_, e) in zip(ids, spans_of):
                of[bisect_left(cuts, e)].append(str(t))
        text_of = [",".join(sides[0][g]) + "|" + ",".join(sides[1][g]) for g in range(len(cuts))]
        count.update(links)
        done.append((i, len(x), len(y), len(cuts), links, hashlib.sha256(";".join(text_of).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, t), n in count.items():
        top[t] = max(top[t], n)
    return Counter((i, n, m, g, len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), h) for i, n, m, g, ls, h in done)


def test_alignment_of_odd_rows(spark):
    from scenaria.llm.token_alignment import alignment

    extra = ["▁ mark", "<|endoftext|> here", "<0x41> <unk> </s>", "a\tb\r\n c ", "  two  spaces ", "ﬁ ½ Å é", "🙂🙂 漢字 ไทย", "x" * 500, " "]
    df = odd(spark).unionByName(frame(spark, extra, range(100, 100 + len(extra))), allowMissingColumns=True)
    want = brute_alignment([(r.doc_id, r.text) for r in df.collect()])
    assert Counter(map(tuple, alignment(df).collect())) == want
    assert any(k[1] == 0 and k[0] == 100 for k in want), "the mark itself is not given back"
    assert alignment(df.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in alignment(frame(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_whole_alignment_in_small_chunks(spark, monkeypatch):
    from scenaria.llm import token_alignment as T

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    want = brute_alignment([(r.doc_id, r.text) for r in rows])
    monkeypatch.setattr(T, "CHUNK", 20_000)
    df = spark.createDataFrame(rows).repartition(3)
    assert Counter(map(tuple, T.alignment(df).collect())) == want


def test_long_texts_are_aligned_by_windows(spark, monkeypatch):
    from scenaria.llm import token_alignment as T

    words = sorted({w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect() for w in r.text.split()})
    draw = random.Random(4)
    texts = [" ".join(draw.choices(words, k=n)) for n in (900, 3, 1, 400)] + ["", None, "▁ mark" * 200, "x" * 3000, "漢字 é" * 300, "a\n b  c" * 300]
    df = frame(spark, texts)
    want = brute_alignment([(r.doc_id, r.text) for r in df.collect()])
    monkeypatch.setattr(T, "WINDOW", 200)
    assert Counter(map(tuple, T.alignment(df).collect())) == want


def test_a_chunk_is_aligned_in_little_memory(tools):
    import tracemalloc

    import pyarrow as pa

    from scenaria.llm import token_alignment as T

    with open(T.PIECE_MODEL, "rb") as f:
        a, b = T.encoder(tools[0].automaton), T.Pieces(f.read())
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(draw.choices(words, k=500)) for _ in range(T.CHUNK // 3300)], pa.large_string())
    digits = T._digits(max(len(a.size), len(b.size)))
    tracemalloc.start()
    try:
        row = T.align(a, b, pa.array(range(len(texts))), texts, digits)
        assert row["n_links"].sum() > 1_000_000
        assert tracemalloc.get_traced_memory()[1] < 40 * T.CHUNK
    finally:
        tracemalloc.stop()
