import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing, token_files, tokens

from .fixtures import ODD, docs, empty, odd


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(tokens.vocabulary())
    return lambda t: [*made.encode(t or "", add_special_tokens=False).ids, 1]


STRANGE = ["\x01 y\x01z \x01", "<|endoftext|>a <|startoftext|>", "ΑΣ ΟΔΟΣ's I'm 12.5 don't", "\t\x0b\x1c q\x1dr", "İstanbul K ſ", "é ́a é", "a b　c", "x.,y ., a.. b,", "l', d'. 's,"]


def test_memo_equals_whole_texts(spark, sf, plain):
    texts = [t for _, t in ODD] + STRANGE + [r["text"] for r in docs(spark, sf).collect()]
    for _ in range(2):
        got = list(tokens.documents_ids(tokens.vocabulary(), texts, 1))
        assert all(np.array_equal(a, plain(t)) for a, t in zip(got, texts))


def test_memo_that_forgets(monkeypatch, plain):
    monkeypatch.setattr(tokens, "MEMO", 3)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10)
    encoder = tokens.Encoder(tokens.vocabulary())
    texts = ["one two three four one two.", "two five, six", "", "one seven eight nine ten"] * 3
    flat, n = encoder.ids(texts)
    assert flat.tolist() == [i for t in texts for i in plain(t)[:-1]] and n.tolist() == [len(plain(t)) - 1 for t in texts]


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49407)
    u, c = np.unique(ids, return_counts=True)
    table = token_files.Table(u, token_files.scaled(u, c))
    states, words, payload = token_files.encode(ids, table)
    assert np.array_equal(token_files.decode(n, states, words, payload, table), ids)
    if n > 2048:  # any block alone
        lo = int(words[:2].sum())
        assert np.array_equal(token_files.decode(1024, states[2:3], words[2:3], payload[lo : lo + int(words[2])], table), ids[2048:3072])


def test_files_say_what_was_encoded(spark, sf, plain):
    for table in (docs(spark, sf), odd(spark)):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = sorted(((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in token_files.tokenize_and_read(table).collect()), key=lambda x: x[0])
        at = 0
        for start, n, _, _ in got:
            assert start == at
            at += n
        assert [k for *_, k, _ in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
        want = sorted((str(k), len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes())) for k, t in rows)
        assert sorted((str(k), n, crc) for _, n, k, crc in got) == want
    assert token_files.tokenize_and_read(empty(spark)).count() == 0


def test_damage_is_seen(spark):
    u = np.arange(5)
    table = token_files.Table(u, token_files.scaled(u, np.ones(5)))
    frame = token_files._frame(0, 0, 0, [1], [np.array([1, 2, 3])], table)
    assert [x[2].tolist() for x in token_files.read_frame(frame, table)] == [[1, 2, 3]]
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.read_frame({**frame, "states": frame["states"][:2] + bytes([frame["states"][2] ^ 8]) + frame["states"][3:]}, table))


def check_packing(rows, got, plain, capacity=4096):
    bins, by_doc = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    want = sorted((str(k), p, lo, len(ids[lo : lo + capacity]), zlib.crc32(np.array(ids[lo : lo + capacity], "<u4").tobytes())) for k, t in rows for ids in [plain(t)] for p, lo in enumerate(range(0, len(ids), capacity)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    return len(bins), sum(r["length"] for r in got)


def test_packing(spark, sf, plain):
    table = docs(spark, sf)
    bins, total = check_packing([(r["doc_id"], r["text"]) for r in table.collect()], packing.pack(table).collect(), plain)
    assert bins <= 1.02 * total / 4096 + 2
    check_packing([(r["doc_id"], r["text"]) for r in odd(spark).collect()], packing.pack(odd(spark), group=4).collect(), plain)
    assert packing.pack(empty(spark)).count() == 0


def test_fullest_bin_closes_first():
    p = packing.Packer(10, 2)
    assert p.put(6) == (0, 0) and p.put(7) == (1, 0)
    assert p.put(5) == (2, 0)  # two are open; the one with 3 places left closes
    assert p.put(3) == (0, 6) and p.put(5) == (2, 5)


def test_few_open_bins_still_hold_all():
    p = packing.Packer(100, 3)
    rng = np.random.default_rng(0)
    used = {}
    for n in rng.integers(1, 101, 2000).tolist():
        b, at = p.put(n)
        assert used.get(b, 0) == at
        used[b] = at + n
    assert max(used.values()) <= 100


def test_packer_against_a_slow_best_fit():
    """Every open bin is looked at: the fullest that fits, of equally full ones the last filled; the fullest closes first."""
    rng = np.random.default_rng(12)
    for most in (1, 5, 64):
        packer, bins, made, stamp = packing.Packer(100, most), [], 0, 0
        for n in rng.integers(1, 101, 3000).tolist():
            fits = [b for b in bins if b[0] >= n]
            if fits:
                best = min(fits, key=lambda b: (b[0], -b[1]))
                bins.remove(best)
            else:
                if len(bins) == most:
                    bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
                best, made = (100, 0, made), made + 1
            want = (best[2], 100 - best[0])
            stamp += 1
            if best[0] > n:
                bins.append((best[0] - n, stamp, best[2]))
            assert packer.put(n) == want
