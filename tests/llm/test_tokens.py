import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from clipledger.llm import packing, token_store
from clipledger.llm.tokens import vocabulary_path

from . import odd

TOKENIZER = Tokenizer.from_file(vocabulary_path())


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frames(spark, small):
    return {"odd": odd.frame(spark), "small": spark.read.parquet(f"{small}/documents.parquet")}


@pytest.mark.parametrize("name", ["odd", "small"])
@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shards_round_trip(spark, small, name, kind):
    df = frames(spark, small)[name]
    from clipledger.llm.common import written

    shards = written(token_store.write_shards(df, vocabulary_path(), kind=kind), "t")
    got = sorted(tuple(r) for r in token_store.read_shards(shards).collect())
    docs = [(r.doc_id, ids_of(r.text, 2)) for r in df.where("doc_id IS NOT NULL").orderBy("doc_id").collect()]
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((d, len(x), crc(x)) for d, x in docs)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted(g[0] for g in got)


def test_planes():
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 65_535, 65_536, 2**31):
        ids = rng.integers(0, top, 1001).astype(np.uint32)
        for kind in ("bit", "byte"):
            assert (token_store.ids_of(token_store.planes_of(ids, kind), len(ids), kind) == ids).all()


def check_packing(rows, docs, room):
    """rows: (doc_id, piece, start, length, crc, sequence, offset)."""
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    want = Counter()
    for doc_id, x in docs:
        first = len(x) % room or room
        edges = [0, *range(first, len(x) + 1, room)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc_id, k, a, b - a, crc(x[a:b])] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    # the plain algorithm over single pieces
    left = []
    for length in sorted((r[3] for r in rows), reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(room - length)
    assert len(bins) == len(left)


@pytest.mark.parametrize("name,room", [("odd", 2048), ("small", 2048), ("small", 300)])
def test_packing(spark, small, name, room):
    df = frames(spark, small)[name]
    rows = [tuple(r) for r in packing.pack_documents(df, vocabulary_path(), room).collect()]
    docs = [(r.doc_id, ids_of(r.text, 0)) for r in df.where("doc_id IS NOT NULL").collect()]
    check_packing(rows, docs, room)


def test_plan_steps_follow_lengths_not_pieces():
    few = packing.plan({n: 3 for n in range(1, 400)}, 512)
    many = packing.plan({n: 3_000_000 for n in range(1, 400)}, 512)
    assert sum(map(len, many.values())) < 40 * sum(map(len, few.values()))


def test_empty(spark):
    assert packing.pack_documents(odd.empty(spark), vocabulary_path()).count() == 0
    assert token_store.read_shards(token_store.write_shards(odd.empty(spark), vocabulary_path())).count() == 0


def test_words_go_straight_to_the_model(monkeypatch):
    """Letters of many kinds, marks, white space and tiny generations: always the ids of the whole text."""
    import random

    from clipledger.llm import tokens as T

    monkeypatch.setattr(T, "CACHED_WORDS", 500)
    rnd, letters = random.Random(1), "abzABZéßñÀÿ×÷ºªſƏɏɐ日本ةא.,;:!?'-_0129 \t\n  ́"
    enc = T.Encoder(T.vocabulary_path())
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["a.????? it's don't 's xİ ıI ǅ,", None, ""]
    texts += [" ".join(rnd.choice(["the", "of,", "wörd.", "naïve", "x1", "end!?"]) for _ in range(30)) for _ in range(500)]
    whole = enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    got = [x for i in range(0, len(texts), 40) for x in enc.encode(texts[i : i + 40])]
    assert [x.tolist() for x in got] == [x.ids for x in whole]
    assert enc.direct and len(enc.words) <= 500 + 40 * 60 and enc.older


def test_lines_are_words(monkeypatch):
    """A text is cut at line ends as well: equal lines in unlike texts are learned once, and ids stay those of the whole text."""
    import random

    from clipledger.llm import tokens as T

    enc, asked = T.Encoder(T.vocabulary_path()), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: learn(asked.extend(words) or words))
    texts = [f"Alpha of{chr(97 + k)}.\nBeta of" for k in range(20)]
    for text in texts:
        enc.encode([text])
    assert sum("Beta" in w for w in asked) == sum("Alpha" in w for w in asked) == 1
    rnd = random.Random(2)
    parts = ["\n", "\n\n", "\n\n\n", "\r\n", "\t", " ", "  ", "\x1c", "\u180e", "\u200b", "\x85", "a", "Beta", "été,", "ɐ", "日本", "'s", "x1", "-", "12.", "_", "\u0301", "\ufeff", "<|endoftext|>"]
    texts += ["".join(rnd.choice(parts[: rnd.choice((6, 22, 24))]) if rnd.random() < 0.5 else rnd.choice([" to", "\nof", "A."]) for _ in range(rnd.randrange(9))) for _ in range(20_000)]
    got = [x for i in range(0, len(texts), 50) for x in enc.encode(texts[i : i + 50])]
    whole = enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in got] == [x.ids for x in whole]


def test_readers_hold_no_words(spark, small, monkeypatch):
    """A worker that encoded gives its words back when it reads shards; here the reading function runs in this process."""
    import pyarrow as pa

    from clipledger.llm import tokens
    from clipledger.llm.common import written

    shards = written(token_store.write_shards(spark.read.parquet(f"{small}/documents.parquet"), vocabulary_path()), "t")
    ran, plain = [], type(shards).mapInArrow
    monkeypatch.setattr(type(shards), "mapInArrow", lambda df, f, *rest: ran.append(f) or plain(df, f, *rest))
    token_store.read_shards(shards)
    tokens.encoder(vocabulary_path()).encode(["some words"])
    path = shards.first()["path"]
    batch = pa.RecordBatch.from_pydict({"path": [path], "base": [0]})
    assert sum(b.num_rows for b in ran[0](iter([batch]))) > 0 and not tokens._ENCODERS


def test_many_texts_are_encoded_at_once(small, monkeypatch, spark):
    """A batch of 3 MB is one call of the encoder, so a word met in all its texts is looked up once; here the writing function runs in this process."""
    import pyarrow as pa
    from pyspark import TaskContext

    from clipledger.llm import tokens as T

    docs = spark.read.parquet(f"{small}/documents.parquet")
    ran, asked, plain, encode = [], [], type(docs).mapInArrow, T.Encoder.encode
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *rest: ran.append(f) or plain(df, f, *rest))
    token_store.write_shards(docs, vocabulary_path())
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(T.Encoder, "encode", lambda self, texts: asked.append(len(texts)) or encode(self, texts))
    texts = [f"of the{k % 7} wörd, and\nLine x{k} " * 30 for k in range(3_000)] + [None, ""]
    (told,) = ran[0](iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})]))
    whole = T.encoder(vocabulary_path()).tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert told.column(3).to_pylist() == [sum(len(x.ids) + 1 for x in whole)]
    assert asked == [len(texts)]


def test_ids_are_put_in_place_piece_by_piece(monkeypatch):
    """Texts of one slab, cut into words and put together again a few words at a time, keep the ids of the whole text."""
    import random

    from clipledger.llm import tokens as T

    monkeypatch.setattr(T, "GATHERED_WORDS", 7)
    rnd, parts = random.Random(3), ["a", "The", " ", " ", "\n", "\nOf", " of", ".", "é", "日本", "\t", "x1"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(4_000)] + [None, "", " ", "\n", "a ", "\n\nA", "a\nB"]
    enc = T.Encoder(T.vocabulary_path())
    whole = enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in enc.encode(texts)] == [x.ids for x in whole]
