import random
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm.packing import LINEAR, QUADRATIC, pack, pack_documents
from tributary.llm.queries import vocabulary
from tributary.llm.token_files import EliasFano, Reader, token_round_trip, write_token_files
from tributary.llm import tokens
from tributary.llm.tokens import Encoder

pytest.importorskip("public_tokenizers")
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    bits = ["a", "b ", " ", "\n", "  ", " ", "'s", "1", "é", "\t", "Σ", "İ", ". ", "　", "<|endoftext|>", "word", ", ", "don't ", "naïve. ", "x" * 70, "\x1e", "*&* ", "1st, "]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)] + ["", " ", "\n", "a", "a\n", "\na", "a \n b", "Hello world. Hello, world\nHello world."]


def plain(name):
    """The library's own ids, by a tokenizer that nothing has touched."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_whole_texts_ids(name, monkeypatch):
    ids, texts = plain(name), odd_texts() + ["x<|endoftext|>", "a <|startoftext|> b", "<|endoftext|>", "word " * 300 + "<|endoftext|> " + "end. " * 300]
    want = [ids(t) for t in texts]
    for stretch in (tokens.STRETCH, 7):  # as wholes, and cut wherever a text may be
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        e = Encoder(vocabulary(name), words=100)  # so few that words are forgotten on the way
        for _ in range(2):  # afresh and from memory
            assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode_all(texts)] == want
        assert [np.frombuffer(e.encode(t), e.dtype).tolist() for t in texts] == want


@pytest.mark.parametrize("gaps", [[0], [0, 0, 0, 5], [1] * 300, [1000, 0, 3, 99999, 1] * 50, [7] * 70_000, [1 << 40, 1 << 62]])
def test_elias_fano(gaps):
    values = np.cumsum(gaps)
    code = EliasFano.of(values, int(values[-1]))
    assert code.some(0, len(values)).tolist() == code.some(0, 1 << 40).tolist() == values.tolist()
    r = random.Random(5)
    for i, k in [(0, 0), (0, 1), (len(values) - 1, 1), (len(values), 3), *((r.randrange(len(values)), r.choice((1, 2, 63, 64, 65, 700))) for _ in range(200))]:
        assert code.some(i, k).tolist() == values[i : i + k].tolist()
    some = range(0, len(values), 1 + len(values) // 500)
    assert [code.select(i) for i in some] == values[:: some.step].tolist()
    assert len(code.tobytes()) <= sum(EliasFano.sizes(len(values), int(values[-1])))


def documents(spark):
    texts = odd_texts(60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (500, None), (501, "word " * 6000), (7, texts[7]), (7, "another")]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(5)


def test_round_trip(spark):
    rows, df = documents(spark)
    ids, want = plain(NAMES[0]), []
    for d, t in rows:
        own = np.array([*ids(t or ""), 0], dtype="<u4")
        want.append((d is not None, d or 0, len(own), zlib.crc32(own.tobytes())))
    got = sorted(token_round_trip(df, vocabulary(NAMES[0])).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    assert token_round_trip(df.limit(0), vocabulary(NAMES[0])).count() == 0


def test_file_gives_single_documents(spark, tmp_path):
    _, df = documents(spark)
    (file, *_), *_ = write_token_files(df, f"file://{tmp_path}", vocabulary(NAMES[0]))
    r = Reader(file)
    assert sum(len(r.document(i)) for i in range(r.n)) == r.total and all(r.document(i)[-1] == 0 for i in range(r.n))


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1], [5000, 3000, 3000, 2000, 100, 8193], [random.Random(2).randrange(1, 9000) for _ in range(700)]])
def test_pack(lengths):
    pieces = pack(lengths, 4096)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, n, seq, offset in pieces:
        by_doc[d].append((start, n))
        by_seq[seq].append((offset, n))
    for d, total in enumerate(lengths):
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at and n > 0
            at += n
        assert at == total
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_seq) == -(-sum(x % 4096 for x in lengths) // 4096) + sum(x // 4096 for x in lengths)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_go_to_the_sequence_of_least_cost(seed):
    r, cost = random.Random(seed), lambda n: LINEAR * n + QUADRATIC * n * n
    lengths = [r.choice([r.randrange(1, 60), r.randrange(1, 300)]) for _ in range(120)]
    got, place = pack(lengths, 100), {}
    for d, start, n, seq, offset in got:
        place.setdefault(d, []).append((start, n, seq))
    full = sum(x // 100 for x in lengths)
    bins = [[0.0, 0] for _ in range(-(-sum(x % 100 for x in lengths) // 100))]
    for n, d in sorted(((x % 100, i) for i, x in enumerate(lengths) if x % 100), key=lambda x: (-x[0], x[1])):
        room = [(b[0], i) for i, b in enumerate(bins) if b[1] + n <= 100]
        if room:  # what fits nowhere is cut later
            b = min(room)[1]
            assert place[d][-1] == (lengths[d] - n, n, full + b)
            bins[b][0] += cost(n)
            bins[b][1] += n


def test_packed_documents(spark):
    rows, df = documents(spark)
    encode, name = plain(NAMES[1]), vocabulary(NAMES[1])
    want = sorted(((d is not None, d or 0), tuple([*encode(t or ""), 2])) for d, t in rows if d != 7)
    got = pack_documents(df, name, window=5000).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    ids = dict(want)
    for r in got:
        if r.doc_id != 7:
            own = ids[(r.doc_id is not None, r.doc_id or 0)]
            part = np.array(own[r.start : r.start + r.length], dtype="<u4")
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert sum(r.length for r in got if r.doc_id == 7) == sum(len(encode(t)) + 1 for d, t in rows if d == 7)
    assert pack_documents(df.limit(0), name).count() == 0
