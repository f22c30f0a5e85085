"""Each query opN_ against a plain version of what it should return, on the smallest tables."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from siftwell.llm import ogg, packing, pii, repeats, setsketch, sharding, tokens
from test_dedup import components, removed
from test_training_data import library, stated

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op2(spark, texts):
    got = rows(sharding.op2_hypergeometric_sharding(spark, SF))
    assert got.keys() == texts.keys()
    assert all((got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items())
    sizes = np.bincount([r.shard for r in got.values()], minlength=8)
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for k in range(8):
        assert sorted(r.slot for r in got.values() if r.shard == k) == list(range(sizes[k]))


def test_op4(spark, texts):
    got, names = rows(setsketch.op4_setsketch_near_dedup(spark, SF)), sorted(texts)
    label, sizes = components([texts[i] for i in names], 3, 85)
    for at, i in enumerate(names):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[at], names[label[at]], label[at] == at)


def test_op5(spark, texts):
    got, start, t = rows(tokens.op5_simple8b_token_files(spark, SF)), 0, library("byte_bpe_50k.json")
    for i in sorted(texts):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6(spark, texts):
    for i, r in rows(pii.op6_semi_markov_pii(spark, SF)).items():
        base = stated(texts[i])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE_KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans) and r.n_spans == len(spans)


def pages(media):
    """(serial, granule, lacing values, body) of all pages, read step by step."""
    out, at = [], 0
    while at < len(media):
        assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
        n = media[at + 26]
        laces = list(media[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(laces)
        page = bytearray(media[at:end])
        stored, page[22:26] = int.from_bytes(page[22:26], "little"), bytes(4)
        crc = 0
        for byte in page:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        assert crc == stored
        out.append((int.from_bytes(page[14:18], "little"), int.from_bytes(page[6:14], "little", signed=True), laces, bytes(media[at + 27 + n : end])))
        at = end
    return out


def packets(media, serial):
    out, held = [], b""
    for own, _, laces, body in pages(media):
        if own == serial:
            at = 0
            for lace in laces:
                held += body[at : at + lace]
                at += lace
                if lace < 255:
                    out.append(held)
                    held = b""
    return out


def test_op7(spark, texts):
    got = rows(ogg.op7_ogg_media(spark, SF))
    assert got.keys() == texts.keys()
    for at, (i, t) in enumerate(sorted(texts.items())):
        data, r = t.encode(), got[i]
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), "")
        if at < 12 and len(data) < 20_000:  # a reader of its own, a bit at a time
            media = ogg.multiplexed(payload)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            sound = next(s for s, *_ in pages(media) if packets(media, s)[0].startswith(ogg.PCM_MAGIC))
            assert b"".join(packets(media, sound)[1:]) == payload
            assert max(g for s, g, *_ in pages(media) if s == sound) == len(payload)


def test_op8(spark, texts):
    got, t = packing.op8_vector_best_fit_packing(spark, SF).collect(), library("word_bpe_49k.json")
    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for i, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, lo in enumerate(range(0, len(ids), 2048)):
            r = pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (lo, len(ids[lo : lo + 2048]), zlib.crc32(ids[lo : lo + 2048].tobytes()))
    assert not pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048 and len(own) <= packing.MAX_DOCUMENTS
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 2048 + 1


def test_op9(spark, texts):
    got, names = rows(repeats.op9_bwt_merge_repeats(spark, SF)), sorted(texts)
    for i, (size, gone, spans, digest) in zip(names, removed([texts[i] for i in names], 400), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (size, gone, spans, digest.hex())
