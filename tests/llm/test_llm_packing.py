import random
import struct
import zlib
from collections import defaultdict

import pytest
from candlemill.llm import packing as P
from candlemill.llm.queries import tokenizer_path
from text_helpers import clash, docs, odd_rows, prose


@pytest.fixture(scope="module")
def encoder():
    return P.WordEncoder(tokenizer_path())


def test_words_encode_as_whole_texts(encoder):
    odd = ["a.b c,d 3.5 ..x, $$$. it's I'LL don't 'S x", "ÉÀ ß. œuvre, İstanbul ẞ. naïve", "a\x1cb c\x85d <|endoftext|> z<|startoftext|>,",
           "é ñ 漢字 かな, emoji 😀. x y", "Ab.Cd,Ef. 12,345.67", "", "   ", "᠎ a", "K Å ª º µ", "é x́.", "a.. b,. c"]
    draw = random.Random(4)
    letters = "abcXYZéÉßñ.,.,'!$ \n\t12  ́"
    for text in odd + ["".join(draw.choices(letters, k=60)) for _ in range(300)]:
        assert encoder.encode_all([text]) == [encoder.whole(text)], repr(text)


def test_memory_bound_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 50)
    small = P.WordEncoder(tokenizer_path())
    for k in range(5):
        some = [prose(100, k), prose(30, k + 50).upper()]
        assert small.encode_all(some) == [encoder.whole(t) for t in some] and len(small.known) <= 50


@pytest.mark.parametrize("seed", range(6))
def test_patterns(seed):
    draw = random.Random(seed)
    size = draw.choice([16, 64, 2048])
    hist = {draw.randint(1, size): draw.randint(1, 500) for _ in range(draw.randint(1, 60))}
    room, placed = defaultdict(lambda: 0), defaultdict(int)
    for length, rank, n, first, offset in P.shortest_pack_first(hist, size):
        assert rank == placed[length]
        placed[length] += n
        for p in range(first, first + n):
            assert room[p] == offset  # gapless
            room[p] += length
    assert dict(placed) == hist and max(room.values()) <= size
    assert sorted(room) == list(range(len(room)))


def test_longest_go_first_and_into_the_shortest_pack():
    steps = P.shortest_pack_first({6: 1, 5: 1, 3: 1, 2: 1}, 10)
    assert [(s[0], s[3]) for s in steps] == [(6, 0), (5, 1), (3, 1), (2, 0)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_every_id_is_in_one_piece(spark, encoder):
    rows = [(i, t) for i, (_, t, _) in enumerate(odd_rows())] + [(100 + i, prose(1 + 37 * i % 700, i)) for i in range(150)]
    ids = {i: list(struct.unpack(f"<{len(b) // 4}I", b)) + [1] for i, b in ((i, encoder.whole(t or "")) for i, t in rows)}
    table = clash(docs(spark, rows), "length", "_rank", "offset")
    found = rows_of(P.pack_documents(table, tokenizer_path()))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"]))
    for i, own in by_doc.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for offset, length, *_ in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(by_sequence)) > 0.9
    made = {r["sequence_id"]: r["ids"] for r in rows_of(P.sequences(docs(spark, rows), P.pack_documents(docs(spark, rows), tokenizer_path()), tokenizer_path()))}
    assert all(len(x) == 2048 for x in made.values()) and sum(1 for x in made.values() for i in x if i) == sum(map(len, ids.values())) - sum(x.count(0) for x in ids.values())


def test_repeated_and_nameless_rows(spark):
    found = rows_of(P.pack_documents(docs(spark, odd_rows()), tokenizer_path()))
    assert sum(r["length"] for r in found if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in found if r["doc_id"] == 5)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)
    assert P.pack_documents(docs(spark, []), tokenizer_path()).count() == 0
