"""SentencePiece, packing and FLAC: exactness, round trips, edge cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as PT
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import bytetokens, flac, packing, sentencepieces
from tests.llm.cases import documents, empty

PIECES, BYTES = PT.path("piece_bpe_32k.model"), PT.path("byte_bpe_50k.json")


def noise(alphabet, n, top):
    rng = random.Random(4)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, top))) for _ in range(n)]


def test_pieces_match_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", " ", "  a  b ", "▁x", "a\tb\n\nc", "<s>", "\x00a", " " * 70 + "x", "aaaaaaa", "abab" * 30, "日本é\U0001f642"] + noise("abcdeth  ▁é\n日1<|inon", 800, 120)
    m = sentencepieces.load(PIECES)
    ids, counts = m.encode(texts)
    first = np.cumsum(counts) - counts
    assert [ids[f : f + n].tolist() for f, n in zip(first, counts)] == [sp.encode(t) for t in texts]
    assert [b.decode() for b in m.decode(ids, counts)] == [sp.decode(sp.encode(t)) for t in texts]


def test_pieces_on_tables(spark):
    rows = sentencepieces.round_trip_digests(documents(spark), PIECES).collect()
    assert len(rows) == 15 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (2, 3))
    back = sentencepieces.decode_documents(sentencepieces.encode_documents(documents(spark), PIECES), PIECES)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in documents(spark).collect())
    assert sentencepieces.round_trip_digests(empty(spark), PIECES).count() == 0


def test_byte_tokens_match_the_library():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    texts = ["", "a's", " 's", "'re'rea", "don't", "x\u00a0 y", "日本 x", "<|endoftext|>", "a  b", "\r\n\n b"] + noise("abst're've'll'd'm'S  \n\t12\xa0\x85é.!,", 2000, 50)
    ids, counts = bytetokens.Encoder.of(BYTES).encode(pa.array(texts))
    first = np.cumsum(counts) - counts
    assert [ids[f : f + n].tolist() for f, n in zip(first, counts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_covers_every_id(spark):
    t = Tokenizer.from_file(BYTES)
    rows = packing.pack(documents(spark), BYTES, length=64, ranges=3).collect()
    want = sorted((r["doc_id"] or -1, tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in documents(spark).collect())
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(len(w[1]) for w in want)
    short = sum(1 for p in seqs.values() if sum(n for _, n in p) < 64)
    assert short <= 3
    one = [r for r in rows if r["doc_id"] == 6]
    ids = np.array(next(w[1] for w in want if w[0] == 6), "<u4")
    for r in one:
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    assert sum(r["length"] for r in one) == len(ids)
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_hilbert_visits_neighbours():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512)) and np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_flac_round_trip_and_damage():
    rng = np.random.RandomState(2)
    payloads = [bytes(rng.randint(0, 256, n, dtype=np.uint8)) for n in (64, 1024, 5000)] + [b"\0" * 64, b"abc " * 800, bytes(range(256)) * 9]
    streams = flac.encode_streams(payloads)
    for p, s in zip(payloads, flac.decode_streams(streams)):
        assert (s.samples + 128).astype(np.uint8).tobytes() == p and s.total == len(p)
    for at in (-1, -20, 30):
        bad = bytearray(streams[2])
        bad[at] ^= 8
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(bad)])
    long = flac.decode_streams(flac.encode_streams([bytes(rng.randint(0, 256, 40_000, dtype=np.uint8))]))[0]
    assert len(flac.blocks(long)) > 2 and any(p[0] > 0 for p in long.seek if p[0] != (1 << 64) - 1)
    long.seek[-1] = (long.seek[-1][0], long.seek[-1][1] + 1, 0)
    with pytest.raises(flac.FlacError):
        flac.blocks(long)
    first, at = flac.read_from(streams[5], 2000)
    assert first == 0 and streams[5][at : at + 2] == b"\xff\xf8"


def test_flac_reads_other_writers_frames():
    """A stereo mid/side 16-bit frame: fixed order 1, two partitions, one of them escaped."""
    mid, side = [10, 12, 11, 13, 300, -300, 5, 6], [2, 0, 2, 0, 2, 0, 2, 0]
    bits = ""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    for x, depth in ((mid, 16), (side, 17)):
        bits += put(8 | 1, 7) + "0" + put(x[0], depth) + "00" + put(1, 4)
        res = [b - a for a, b in zip(x, x[1:])]
        bits += put(2, 4)
        for r in res[:3]:
            z = (r << 1) ^ (r >> 31)
            bits += "0" * (z >> 2) + "1" + put(z, 2)
        bits += put(15, 4) + put(12, 5) + "".join(put(r, 12) for r in res[3:])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60 | 9, 0xA8, 0, 7])
    crc8 = 0
    for c in head:
        crc8 = int(flac.CRC8[crc8 ^ c])
    frame = head + bytes([crc8]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = 0
    for c in frame:
        crc = (crc << 8 & 0xFFFF) ^ int(flac.CRC16[crc >> 8 ^ c])
    left = [((m << 1 | s & 1) + s) >> 1 for m, s in zip(mid, side)]
    right = [((m << 1 | s & 1) - s) >> 1 for m, s in zip(mid, side)]
    pcm = b"".join(struct.pack("<hh", a, b) for a, b in zip(left, right))
    info = struct.pack(">HH", 16, 16) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 8).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    s = flac.decode_streams([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + struct.pack(">H", crc)])[0]
    assert s.samples.tolist() == [[a, b] for a, b in zip(left, right)]


def test_flac_tables(spark):
    stored = flac.store(documents(spark))
    rows = flac.read_back(stored).collect()
    assert len(rows) == 15
    for r in rows:
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"])
    want = {r["doc_id"]: hashlib.sha256(flac.payload(r["text"])[1]).hexdigest() for r in documents(spark).collect()}
    assert all(r["payload_sha256"] == want[r["doc_id"]] for r in rows if r["doc_id"])
    tails = {r["doc_id"]: zlib.crc32(flac.payload(r["text"])[1][-64:]) for r in documents(spark).collect()}
    assert all(r["tail_crc32"] == tails[r["doc_id"]] for r in rows if r["doc_id"])
    blocks = flac.pcm_blocks(stored.where("doc_id = 6")).orderBy("block").collect()
    assert [b["first_sample"] for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]
    assert flac.read_back(flac.store(empty(spark))).count() == 0
