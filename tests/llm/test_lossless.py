"""FLAC media, BPE and the token store: exact round trips and the libraries' own results."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixture
from tidemark.llm import flac_streams, op1_flac, op5_token_store, op9_byte_bpe
from tidemark.llm.segments import cuts


def payloads():
    rng = np.random.default_rng(1)
    raw = [b"", b"a" * 400, rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), b"\x00\xff" * 700, bytes(op1_flac.SYNC) * 300, b"a" * 191 + b"\xff" + b"a" * 383 + b"\x00", b"plain text " * 900]
    raw.append((127 * (1 + np.sin(np.arange(4000) / 9))).astype(np.uint8).tobytes())
    return [op1_flac.payload(r) for r in raw]


def test_flac_round_trip_uses_every_kind_of_frame():
    streams = op1_flac.encode_streams(payloads())
    assert op1_flac.decode_streams(streams) == payloads()
    kinds = set()
    for s in streams:
        h, a = op1_flac.header(s), np.frombuffer(s, np.uint8)
        for at in op1_flac.walk(a, h["frames"], h["samples"] // op1_flac.FRAME):
            kinds.add(int(a[at + 6]) >> 1 if a[at + 4] < 0x80 else -1)
    assert 0 in kinds and 1 in kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)


def test_flac_finds_broken_bytes():
    good = op1_flac.encode_streams(payloads()[:3])
    for at in (len(good[2]) - 30, len(good[2]) // 2, 30):
        bad = bytearray(good[2])
        bad[at] ^= 1
        assert op1_flac.decode_streams([good[0], bytes(bad), good[1]]) == [payloads()[0], None, payloads()[1]]
    assert op1_flac.decode_streams([b"", b"fLaC", good[1][:60]]) == [None, None, None]


@pytest.mark.parametrize("sample,count", [(0, 10), (191, 2), (700, 1000), (9000, 5000), (0, 10**6)])
def test_flac_seek(sample, count):
    p = payloads()[6]
    assert op1_flac.seek(op1_flac.encode_streams([p])[0], sample, count) == p[sample : sample + count]


def test_flac_long_numbers():
    p = b"xyz" * 64 * 3000  # frame numbers of two and three bytes
    assert op1_flac.decode_streams(op1_flac.encode_streams([p])) == [p]


def test_media_columns(spark):
    media = op1_flac.encode_media(fixture.documents(spark))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["state"]) for r in op1_flac.decode_media(media).collect())
    want = []
    for i, t in fixture.texts():
        p = op1_flac.payload(t.encode())
        want.append((i or -1, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), "intact"))
    assert got == sorted(want)
    blocks = op1_flac.pcm_blocks(media.filter("doc_id = 50"), 64).orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == op1_flac.payload(dict(fixture.texts())[50].encode())
    assert [b["sample_offset"] for b in blocks[:3]] == [0, 64 * 192, 128 * 192]
    assert op1_flac.decode_media(op1_flac.encode_media(fixture.empty(spark))).count() == 0


def feature_brute(p):
    x = [b - 128 for b in p]
    return f"sum={sum(x)};energy={sum(v * v for v in x)};turns={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))};peak={max(map(abs, x))}"


def test_media_columns_come_from_the_blocks(spark):
    media = op1_flac.encode_media(fixture.documents(spark)).cache()
    streams = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in media.collect()}
    texts = {(i, len(t.encode())): op1_flac.payload(t.encode()) for i, t in fixture.texts()}
    for r in op1_flac.decode_media(media).collect():
        p, m = texts[r["doc_id"], r["n_bytes"]], streams[r["doc_id"], r["n_bytes"]]
        assert (r["feature"], r["n_blocks"]) == (feature_brute(p), -(-len(p) // (64 * 192)))
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        samples = flac_streams.decode(m, op1_flac.header(m)).samples  # another decoder, frame by frame
        assert (samples[:, 0] + 128).astype(np.uint8).tobytes() == p
    for r in op1_flac.pcm_blocks(media.filter("doc_id IN (50, 51)")).collect():
        m = next(m for (i, _), m in streams.items() if i == r["doc_id"])
        assert op1_flac.seek(m, r["sample_offset"], r["samples"]) == bytes(r["pcm"])


# The first and the third example stream of RFC 9639's appendix D.
STEREO = "664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a"
PREDICTED = "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc28222280 57a3".replace(" ", "")


def test_streams_of_other_encoders(spark):
    opened = op1_flac.open_streams([bytes.fromhex(STEREO), bytes.fromhex(PREDICTED)])
    assert [s.state for s in opened] == ["intact", "intact"]
    assert (opened[0].channels, opened[0].bits, np.frombuffer(opened[0].blocks[0][1], "<i2").tolist()) == (2, 16, [25588, 10416])
    assert (opened[1].channels, opened[1].bits, len(opened[1].blocks[0][1])) == (1, 8, 24)
    bad = bytearray.fromhex(STEREO)
    bad[-4] ^= 1
    reserved = bytearray.fromhex(STEREO)
    reserved[45] |= 0x0F  # the sample rate code that is never valid
    assert [s.state for s in op1_flac.open_streams([bytes(bad), bytes(reserved)])] == ["broken", "unsupported"]
    rows = op1_flac.pcm_blocks(spark.createDataFrame([(1, bytes.fromhex(STEREO)), (2, bytes(bad)), (3, None)], "doc_id long, media binary")).collect()
    assert {(r["doc_id"], r["samples"], r["channels"], r["state"]) for r in rows} == {(1, 1, 2, "intact"), (2, 0, 0, "broken"), (3, 0, 0, "broken")}


def residual_bits(*fields):
    """Bytes of (value, width) fields."""
    text = "".join(f"{v & ((1 << n) - 1):0{n}b}" for v, n in fields if n)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_escaped_and_wide_rice_partitions():
    wide = residual_bits((1, 2), (1, 4), (31, 5), (6, 5), (-17, 6), (20, 6), (0, 5), (1, 1), (0, 1), (1, 1))
    assert flac_streams.residuals(flac_streams.Reader(wide, 0), 4, 0) == [-17, 20, 0, -1]
    plain = residual_bits((0, 2), (0, 4), (15, 4), (0, 5))
    assert flac_streams.residuals(flac_streams.Reader(plain, 0), 3, 1) == [0, 0]
    with pytest.raises(flac_streams.Unsupported):
        flac_streams.residuals(flac_streams.Reader(residual_bits((2, 2), (0, 4)), 0), 4, 0)


def test_a_wrong_seek_point_is_noticed():
    good = op1_flac.encode_streams([payloads()[6]])[0]
    bad = bytearray(good)
    at = 4 + 4 + 34 + 4 + 18 + 15  # the second point's place
    bad[at] ^= 1
    assert [s.state for s in op1_flac.open_streams([good, bytes(bad)])] == ["intact", "broken"]


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=op9_byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_pieces_are_encoded_like_whole_texts():
    import random

    encoding, rng = tiktoken_encoding(), random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for letters in ("aZé1'! \n\t .ñ$", "ab1'! \n.", "sS'tdmrevl \r\x0b\x1c　") for _ in range(1500)]
    raw = [t.encode() for t in texts]
    edges, first = cuts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    flat = b"".join(raw)
    for i, t in enumerate(texts):
        own = edges[first[i] : first[i + 1] + 1]
        assert [x for a, b in zip(own[:-1], own[1:]) for x in encoding.encode_ordinary(flat[a:b].decode())] == encoding.encode_ordinary(t), repr(t)


WIDE = [" ", "  ", "\n", "\u00a0", "\u3000", "\u2009", "\u2028", "\u0085", "\x1c", "\u180e", "\u200b", "a", "B", "é", "ß", "'", "'s", "12", "٣", "½", "!", "。", "日本", "e\u0301", "\u0301", "😀", "\u0378", "\ua7ca", "Ω", "<|endoftext|>"]


def test_pieces_at_white_space_and_classes_beyond_ascii():
    import random

    encoding, rng = tiktoken_encoding(), random.Random(4)
    for text in ("".join(rng.choice(WIDE) for _ in range(rng.randint(1, 14))) for _ in range(4000)):
        raw = text.encode()
        edges, _ = cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert [x for a, b in zip(edges[:-1], edges[1:]) for x in encoding.encode_ordinary(raw[a:b].decode())] == encoding.encode_ordinary(text), repr(text)


def test_one_wide_space_or_no_spaces_leave_the_pieces_small():
    def pieces(text):
        raw = text.encode()
        edges, _ = cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:])]

    assert pieces("plain words\u00a0here, Monsieur\u00a0!") == ["plain", " words", "\u00a0here", ",", " Monsieur", "\u00a0!"]
    assert pieces("今日は、晴れ。明日も") == ["今日は", "、", "晴れ", "。", "明日も"]


def test_byte_bpe_equals_library(spark):
    encoding = tiktoken_encoding()
    encoded = op9_byte_bpe.encode(fixture.documents(spark))
    got = sorted(((r["doc_id"] or -1, list(r["ids"])) for r in encoded.collect()), key=repr)
    assert got == sorted(((i or -1, encoding.encode_ordinary(t)) for i, t in fixture.texts()), key=repr)
    back = sorted((r["doc_id"] or -1, bytes(r["body"])) for r in op9_byte_bpe.decode(encoded).collect())
    assert back == sorted((i or -1, t.encode()) for i, t in fixture.texts())
    sums = op9_byte_bpe.decode(encoded, digests=True).filter("doc_id = 52").first()
    ids = encoding.encode_ordinary(dict(fixture.texts())[52])
    assert (sums["n_tokens"], sums["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert op9_byte_bpe.decode(op9_byte_bpe.encode(fixture.empty(spark))).count() == 0


def test_joined_checksums():
    a, b = b"some bytes" * 99, b"others" * 12345
    one = lambda x: np.array([x], np.uint64)
    assert int(op5_token_store.join_crc(one(zlib.crc32(a)), one(zlib.crc32(b)), np.array([len(b)]))[0]) == zlib.crc32(a + b)


def test_merkle_depends_on_order_and_number():
    m = op5_token_store.merkle
    assert len({m([]), m([b"a"]), m([b"a", b"b"]), m([b"b", b"a"]), m([b"a", b"b", b"c"])}) == 5


def test_token_store(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(P.path("word_bpe_49k.json")), str(tmp_path / "store")
    op5_token_store.write_store(fixture.documents(spark), folder)
    want = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for i, t in fixture.texts()]
    got = op5_token_store.verify(spark, folder).collect()
    assert all(r["verified"] for r in got) and len(got) == len(want)
    at = 0
    for i, ids in sorted(want, key=lambda x: (x[0] is not None, x[0] or 0)):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (i, at, len(ids), crc) in {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got}
        at += len(ids)
    read = sorted(((r["doc_id"] or -1, list(r["ids"])) for r in op5_token_store.read_ids(spark, folder).collect()), key=repr)
    assert read == sorted(((i or -1, ids) for i, ids in want), key=repr)
    chunks = op5_token_store.stored_items(spark, folder, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    op5_token_store.write_store(fixture.empty(spark), str(tmp_path / "none"))
    assert op5_token_store.verify(spark, str(tmp_path / "none")).count() == 0


def test_token_store_notices_a_changed_chunk(spark, tmp_path):
    folder = str(tmp_path / "store")
    op5_token_store.write_store(fixture.documents(spark).filter("doc_id IN (4, 10)"), folder)
    kinds = [op5_token_store.stored_items(spark, folder, kind).collect() for kind in ("chunk", "recipe")]
    change = lambda body: op5_token_store.pack_ids(op5_token_store.unpack_ids(bytes(body)) ^ 1)
    items = [(r["doc_id"], r["digest"], r["n"], change(r["body"]), r["copies"], r["kind"]) for r in kinds[0]] + [tuple(r) for r in kinds[1]]
    broken = spark.createDataFrame(items, "doc_id long, digest binary, n long, body binary, copies long, kind string")
    broken.write.partitionBy("kind").parquet(str(tmp_path / "broken/items"))
    for name in ("recipes", "manifests"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(str(tmp_path / f"broken/{name}"))
    assert {r["verified"] for r in op5_token_store.verify(spark, str(tmp_path / "broken")).filter("doc_id = 10").collect()} == {False}


def test_token_store_notices_changed_manifests_and_lost_recipes(spark, tmp_path):
    folder = str(tmp_path / "store")
    op5_token_store.write_store(fixture.documents(spark), folder)
    assert {r["intact"] for r in op5_token_store.verify_parts(spark, folder).collect()} == {True}

    def broken(name, manifests, recipes):
        spark.read.parquet(f"{folder}/items").write.partitionBy("kind").parquet(str(tmp_path / name / "items"))
        manifests.write.parquet(str(tmp_path / name / "manifests"))
        recipes.write.parquet(str(tmp_path / name / "recipes"))
        return op5_token_store.verify(spark, str(tmp_path / name)).collect(), op5_token_store.verify_parts(spark, str(tmp_path / name)).collect()

    manifests, recipes = spark.read.parquet(f"{folder}/manifests"), spark.read.parquet(f"{folder}/recipes")
    rows, _ = broken("roots", manifests.withColumn("root", F.lit(b"x" * 32)), recipes)
    assert len(rows) == len(fixture.rows()) and not any(r["verified"] for r in rows)
    part = recipes.filter("doc_id = 20").first()["part"]
    own = {r["doc_id"] for r in recipes.filter(F.col("part") == part).collect()}
    rows, parts = broken("lost", manifests, recipes.filter("doc_id IS NULL OR doc_id <> 20"))
    assert all(r["verified"] == (r["doc_id"] not in own) for r in rows) and {r["part"] for r in parts if not r["intact"]} == {part}
    rows, parts = broken("part", manifests, recipes.filter(F.col("part") != part))
    assert all(r["verified"] for r in rows) and {r["part"] for r in parts if not r["intact"]} == {part}


class Counting(op5_token_store.WordEncoder):
    def __init__(self, path):
        self.words = []
        super().__init__(path)
        self.words.clear()

    def __call__(self, word):
        self.words.append(word)
        return super().__call__(word)


def encoded(encoder, *texts):
    raw = [t.encode() for t in texts]
    ids, upto = op5_token_store.encode_slice(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), encoder)
    return [ids[a : b - 1].tolist() for a, b in zip(upto[:-1], upto[1:])]


def test_words_are_remembered_for_their_tokenizer_only(tmp_path):
    import json

    import public_tokenizers as P
    from tokenizers import Tokenizer

    spec = json.load(open(P.path("word_bpe_49k.json")))
    spec["model"]["merges"] = spec["model"]["merges"][:100]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    for path in (P.path("word_bpe_49k.json"), str(tmp_path / "other.json")):
        texts = ["plain words, Élan 42", "", "plain"]
        assert encoded(op5_token_store.WordEncoder(path), *texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_rare_words_do_not_drive_out_frequent_ones(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(op5_token_store, "CACHE_WORDS", 50)
    encoder = Counting(P.path("word_bpe_49k.json"))
    letters = "abcdefghij"
    for n in range(20):
        encoded(encoder, "often " + " ".join(f"rare{letters[n % 10]}{letters[n // 10]}{a}{b}" for a in letters[:3] for b in letters))
    assert encoder.words.count(b"often") == 1 and len(encoder.words) == 1 + 20 * 30


def test_packed_runs_equal_those_packed_alone():
    rng = np.random.default_rng(5)
    for most in (300, 1 << 16, 1 << 20):
        ids = rng.integers(0, most, 5000).astype("<u4")
        runs = [(0, 1), (1, 700), (700, 5000)]
        assert op5_token_store.pack_runs(ids, runs) == [op5_token_store.pack_ids(ids[a:b]) for a, b in runs]
        assert [op5_token_store.unpack_ids(p).tolist() for p in op5_token_store.pack_runs(ids, runs)] == [ids[a:b].tolist() for a, b in runs]
    assert op5_token_store.pack_runs(np.zeros(0, "<u4"), []) == []
