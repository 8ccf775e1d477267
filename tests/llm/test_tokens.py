import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from stratavec.llm.bpe_fst import BpeCodec, Transducer, Utf8Decoder, load_ranks, round_trip_public  # noqa: E402
from stratavec.llm.packing import Packer, PackSettings, pack_documents, pack_with_public  # noqa: E402
from stratavec.llm.token_count import count_tokens, count_tokens_afresh, open_cache  # noqa: E402
from stratavec.llm.tokenizer import ByteTokenizer, public_path  # noqa: E402

ALPHABETS = ["abcdeft hing", "aA1 .,\n\t  '", "аеиноключ日本語中한국😀é̈ß \x85\x1c\x00 ", "a", " ", "\n ", "0123456789", "the of and ing", "  x <|endoftext|>"]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        a = rng.choice(ALPHABETS)
        t = "".join(rng.choice(a) for _ in range(rng.choice([1, 2, 5, 13, 60, 400])))
        yield t + ("<|endoftext|>tail" if rng.random() < 0.05 else "")


@pytest.fixture(scope="module")
def tokenizer():
    return ByteTokenizer(public_path("byte_bpe_50k.json"))


def test_fast_way_equals_the_library(tokenizer):
    assert tokenizer.fast is not None
    for t in texts(1, 1500):
        want = tokenizer.library.encode(t, add_special_tokens=False).ids
        assert tokenizer.ids(t).tolist() == want and tokenizer.count(t) == len(want)


def test_counts_and_cache(spark, documents, odd, tokenizer, tmp_path):
    from conftest_rows import ODD

    got = count_tokens_afresh(odd).collect()
    want = sorted(((i, len((t or "").encode()), tokenizer.count(t or "")) for i, t in ODD), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    cache, path = str(tmp_path / "cache"), public_path("byte_bpe_50k.json")
    assert open_cache(spark, cache).count() == 0
    docs = documents([(i, f"text {i % 7}") for i in range(40)])
    first = sorted(map(tuple, count_tokens(docs, path, cache).collect()))
    assert spark.read.parquet(cache).count() == 7
    more = docs.unionByName(documents([(100, "new text")]))
    assert sorted(map(tuple, count_tokens(more, path, cache).where("doc_id < 100").collect())) == first
    assert spark.read.parquet(cache).count() == 8  # only the miss was encoded and appended
    assert count_tokens(docs.limit(0), path, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- transducer

@pytest.fixture(scope="module")
def multi():
    return load_ranks(public_path("byte_bpe_multi_50k.tiktoken"))


def test_codec_equals_the_library(multi):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=multi, special_tokens={})
    codec = BpeCodec(multi, public_tokenizers.PATTERN)
    for t in [*texts(2, 1500), "a" * 5000, " " * 5000, "ab" * 3000, "é" * 2000, "!?" * 2000]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert "".join(codec.decode(ids, 3 if len(t) < 200 else 512)) == t


def test_transducer_of_small_merges_by_brute_force():
    import itertools

    rng = random.Random(8)
    for _ in range(40):
        ranks, known = {bytes([c]): i for i, c in enumerate(b"abc")}, [b"a", b"b", b"c"]
        while len(ranks) < 14:
            t = rng.choice(known) + rng.choice(known)
            if t not in ranks and len(t) < 7:
                ranks[t] = len(ranks)
                known.append(t)
        machine = Transducer(ranks)
        for n in range(1, 7):
            for w in map(bytes, itertools.product(b"abc", repeat=n)):
                assert tuple(machine.encode(w)) == machine.merged(w)


def test_lookahead_is_bounded(multi):
    machine = Transducer(multi)
    for piece in (b"a" * 3000, b"ab" * 2000, b"=" * 3000, bytes(range(256)) * 10):
        state, longest = machine.root, 0
        for b in piece:
            _, state = state.arcs.get(b) or machine.arc(state, b)
            longest = max(longest, len(state.pending))
        assert longest <= 3 * machine.longest


def test_utf8_decoder_equals_the_standard_one():
    rng = random.Random(9)
    singles = {i: bytes([i]) for i in range(256)}
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xF4, 0x90, 0xE0]) for _ in range(rng.randrange(9)))
        decoder = Utf8Decoder(singles)
        assert "".join([*(decoder.feed([b]) for b in data), decoder.finish()]) == data.decode("utf-8", "replace")


def test_round_trip_odd_rows(odd):
    from conftest_rows import ODD

    got = sorted(((r["doc_id"], r["decoded_sha256"]) for r in round_trip_public(odd).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD), key=str)
    assert round_trip_public(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- packing

def check_pieces(rows, streams):
    """rows: pieces as dicts; streams: the ids of each document."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(streams)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(streams[i])
            assert r["ids_crc32"] == zlib.crc32(streams[i][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(streams[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and len({r["tier"] for r in parts}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, len(by_sequence)


def test_packing(documents, tokenizer):
    rng = random.Random(10)
    rows = [(i, "word " * rng.choice([0, 1, 30, 300, 1500, 5000])) for i in range(120)]
    rows[3] = (3, None)
    docs = documents(rows).repartition(3)
    streams = {i: np.append(tokenizer.ids(t or ""), 0).astype("<u4") for i, t in rows}
    got = [r.asDict() for r in pack_with_public(docs).collect()]
    padding, sequences = check_pieces(got, streams)
    assert padding <= 3 * 1024 and sequences >= sum(map(len, streams.values())) / 1024
    steps = {}
    for r in got:
        steps.setdefault(r["step_group"], set()).add((r["tier"], r["sequence_id"]))
    assert all(len({t for t, _ in s}) == 1 and len(s) * next(iter(s))[0] <= 65536 for s in steps.values())


def test_step_groups_are_balanced(documents):
    rng = random.Random(12)
    docs = documents([(i, "word " * rng.choice([10, 40, 90, 300, 1500])) for i in range(150)]).repartition(4)
    settings = PackSettings(step_tokens=4096)
    groups = {}
    for r in pack_with_public(docs, settings=settings).collect():
        groups.setdefault((r["tier"], r["step_group"]), set()).add(r["sequence_id"])
    assert len({g for _, g in groups}) == len(groups)
    assert len(groups) > 10
    for tier in settings.tiers:
        sizes = [len(s) for (t, _), s in groups.items() if t == tier]
        assert len(sizes) == -(-sum(sizes) * tier // 4096) and (not sizes or max(sizes) - min(sizes) <= 1)


def test_packing_with_ids_and_odd_rows(odd, tokenizer):
    from conftest_rows import ODD

    got = pack_documents(odd, public_path("byte_bpe_50k.json"), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert sum(r["length"] for r in got) == sum(len(tokenizer.ids(t or "")) + 1 for _, t in ODD)
    assert pack_with_public(odd.limit(0)).count() == 0


def test_packer_by_itself():
    rng = random.Random(11)
    for pool in (1, 8, 500):
        packer, out, sizes = Packer(PackSettings(pool=pool), 5), [], {}
        for i in range(400):
            sizes[i] = rng.choice([1, 2, 63, 64, 65, 200, 512, 1000, 1024, 1025, 3000])
            out += packer.add(i, sizes[i])
            assert packer.n <= max(pool, 1024) + 1
        out += packer.finish()
        streams = {i: np.arange(n, dtype="<u4") for i, n in sizes.items()}
        rows = [{"doc_id": d, "start": a, "length": n, "sequence_id": s, "offset": o, "tier": t, "doc_tokens": sizes[d], "ids_crc32": zlib.crc32(streams[d][a:a + n].tobytes())} for d, a, n, s, o, t, _ in out]
        padding, _ = check_pieces(rows, streams)
        assert padding < 1024
