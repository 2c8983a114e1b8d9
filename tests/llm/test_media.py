from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from findrift.llm import media

from .helpers import docs


def test_round_trip_and_contract(spark):
    texts = [None, "", "a", "b" * 192, "c" * 193, "é\U0001f600" * 500, "d" * 300_000, "a"]
    got = {r["doc_id"]: r for r in media.digest(media.store(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(data), len(payload))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[2].asDict() | {"doc_id": 0} == got[7].asDict() | {"doc_id": 0}
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert media.digest(media.store(docs(spark, texts).limit(0))).count() == 0


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_filters_undone(kind):
    payload = np.random.default_rng(kind).integers(0, 256, 192 * 9, np.uint8).tobytes()
    assert media.read_png(media.write_png(payload, kind)).tobytes() == payload


def test_average_and_paeth():
    rng = np.random.default_rng(3)
    plain = rng.integers(0, 256, (6, 12), np.uint8)
    for kind in (3, 4):
        rows = plain.copy()
        for y in range(6):
            for x in range(12):
                a = int(plain[y, x - 3]) if x >= 3 else 0
                b = int(plain[y - 1, x]) if y else 0
                c = int(plain[y - 1, x - 3]) if y and x >= 3 else 0
                p = a + b - c
                near = min((a, b, c), key=lambda v: abs(p - v))
                rows[y, x] = (int(plain[y, x]) - ((a + b) // 2 if kind == 3 else near)) % 256
        types = np.full(6, kind, np.uint8)
        assert (media.unfilter(types, rows, 3) == plain).all()


def test_damage_is_found():
    good = media.write_png(b"x" * 192)
    for at in (0, 18, 45, len(good) - 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(good[:-12])
    with pytest.raises(ValueError):
        media.read_png(good[:8] + struct.pack(">I", 9999) + good[12:])


def test_hash_is_stable_under_small_change():
    text = ("the quick brown fox jumps over the lazy dog. " * 90).encode()
    near = text.replace(b"fox", b"fix", 3)
    a, b = (media.cosine_hash(media.read_png(media.write_png(media.pad(t)))) for t in (text, near))
    other = media.cosine_hash(media.read_png(media.write_png(media.pad(bytes(range(32, 127)) * 40))))
    bits = lambda x, y: bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1")
    assert bits(a, b) < bits(a, other)


def test_ids_of_any_type_and_very_long_texts(spark):
    df = spark.createDataFrame([("a", "x", "m"), (None, None, "m"), ("a", "y" * 3_000_000, "m")], "name string, text string, media string")
    got = media.digest(media.store(df, "name"), "name").collect()
    assert sorted((r["name"] or "", r["n_bytes"]) for r in got) == [("", 0), ("a", 1), ("a", 3_000_000)]
