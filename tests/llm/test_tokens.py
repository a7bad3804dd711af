"""op2, op3 and op7 against the libraries and brute force."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import bitplanes, pieces, wordpiece, words
from tarnlake.llm.bytebpe import Encoder

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "the", " ", "  ", "\n", "é", "▁", "中", "🙂", "'s", "12", "!!", ".", "<s>", "<0x41>", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\t", "Ġ", "ﬁ", "é", "\x00", "word,"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=40).filter(lambda x: not any(0xD800 <= ord(c) < 0xE000 for c in x))


def apart(ids, sizes):
    ends = np.cumsum([0, *sizes]).tolist()
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_bytes_pair_encoding_by_words(texts):
    e = Encoder.of(BPE)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert apart(*e.encode(pa.array(texts, pa.string()))) == want
    assert apart(*e.encode(pa.array(texts, pa.string()), end=7)) == [[*w, 7] for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_pieces_are_those_of_the_library(texts):
    p = pieces.Pieces.of(MODEL)
    ids, sizes = p.encode(pa.array(texts, pa.string()))
    assert apart(ids, sizes) == p.library.encode(texts)
    assert p.decode(ids, sizes) == p.library.decode(p.library.encode(texts))


def test_the_agenda_alone():
    p = pieces.Pieces.of(MODEL)
    for text in ("hello world", "aaaaaaaaaaaaaaaa", "internationalization" * 50, "x" * 3000):
        assert p.merge(pieces.MARK + text.replace(" ", pieces.MARK)) == p.library.encode(text)


def test_agendas_of_many_words_are_those_of_each():
    p, rnd = pieces.Pieces.of(MODEL), random.Random(5)
    words = ["".join(rnd.choices("abcdeinorst▁éüß.,'-日ｱ🙂\t\n", k=rnd.randrange(16))) for _ in range(4000)] + ["x" * 60, "▁" * 50]
    want = [np.array(p.merge(w), "<u4").tobytes() for w in words]
    assert p.merge_all(words) == want == p.merge_all(words, at_once=7, few=1)


@pytest.mark.parametrize("name, broken", [("merge", lambda self, text: [5]), ("steps", lambda self, symbols: iter([(np.arange(len(symbols)), symbols)]))])
def test_a_broken_agenda_is_found_out(monkeypatch, name, broken):
    p = pieces.Pieces(MODEL)
    monkeypatch.setattr(pieces.Pieces, name, broken)
    with pytest.raises(ValueError, match="other ids"):
        p.encode(pa.array(["hello world", " ".join(f"pi{c}ces" for c in "abcdefghijklmnopqrstuvwxyzäöü")]))


def test_slices_hold_bounded_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ab", None, "x" * 50, "", "abc", "abcdef"])], ["k", "text"])
    assert [s.column(0).to_pylist() for s in words.slices(batch, 1, 9)] == [[0, 1], [2], [3, 4, 5]]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (7, 2), (1000, 50_257), (65_536, 1 << 31)])
def test_planes_round_trip(kind, n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind).tolist() == ids.tolist()


def order_of(text):
    """Rows of one doc_id stand in the order of a hash of their texts."""
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def ordered(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, order_of(r[1])))


@pytest.mark.parametrize("kind, block", [("bit", 64), ("byte", 1000), ("byte", 65_536)])
def test_files_round_trip(spark, odd, none, tmp_path, kind, block):
    bitplanes.write_documents(odd, str(tmp_path / "out"), BPE, block=block, kind=kind)
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in bitplanes.read_documents(spark, str(tmp_path / "out")).collect())
    encoder, want, at = Encoder.of(BPE).tokenizer, [], 0
    for d, t in ordered(odd):
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 2]
        want.append((at, d, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    index = spark.read.parquet(str(tmp_path / "out" / "index")).orderBy("shard", "block").collect()
    assert [r["start"] for r in index] == np.cumsum([0, *(r["n_ids"] for r in index)])[:-1].tolist()
    bitplanes.write_documents(none, str(tmp_path / "none"), BPE)
    assert bitplanes.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_op2(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = bitplanes.op2_token_planes(spark, str(tmp_path)).collect()
    encoder = Encoder.of(BPE).tokenizer
    texts = [t for _, t in ordered(odd)]
    want = [zlib.crc32(np.array([*encoder.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts]
    assert [r["ids_crc32"] for r in sorted(got, key=lambda r: r["start"])] == want


def test_op3(spark, odd, none):
    from hashlib import sha256

    library = pieces.Pieces.of(MODEL).library
    hexed = lambda x: sha256(x.encode()).hexdigest()
    want = []
    for d, t in ordered(odd):
        ids = library.encode(t)
        want.append((str(d), len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids))))
    got = [(str(r[0]), *r[1:]) for r in pieces.digest_documents(odd, MODEL).collect()]
    assert sorted(got) == sorted(want)
    full = pieces.encode_documents(odd, MODEL).collect()
    assert sorted((str(r["doc_id"]), hexed(r["decoded"])) for r in full) == sorted((w[0], w[3]) for w in want)
    assert pieces.encode_documents(none, MODEL).count() == pieces.digest_documents(none, MODEL).count() == 0


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        known = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return wordpiece.NONE
        at, n = end, n + 1
    return n


def test_automaton_against_greedy_matching():
    rnd = random.Random(3)
    word = lambda most: bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, most)))
    for _ in range(200):
        initial, continuing = ({word(5) for _ in range(rnd.randrange(1, 8))} for _ in range(2))
        words = [word(90 if rnd.random() < 0.1 else 9) for _ in range(40)]
        want = [greedy(w, initial, continuing) for w in words]
        automaton = wordpiece.Automaton(initial, continuing)
        assert automaton.count_all(b" \n".join(words))[1].tolist() == want == [automaton.count(w) for w in words]


def test_op7(odd, none):
    initial, continuing = map(set, wordpiece.vocabulary(BPE))
    once = functools.cache(lambda w: greedy(w, initial, continuing))
    want = []
    for d, t in ordered(odd):
        counts = [once(w) for w in t.encode().split()]
        want.append((str(d), (len(counts), sum(1 if c < 0 else c for c in counts), sum(c < 0 for c in counts))))
    got = [(str(r["doc_id"]), (r["n_words"], r["n_tokens"], r["n_unknown"])) for r in wordpiece.count_tokens(odd, BPE).collect()]
    assert sorted(got) == sorted(want)
    assert wordpiece.count_tokens(none, BPE).count() == 0


def test_every_byte_of_a_text_has_its_spelling():
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    byte_of = wordpiece.spelling()
    assert len(byte_of) == 256 and set(byte_of.values()) == set(range(256))
    seen = set()
    for c in map(chr, [*range(0x1000), *range(0x1000, 0xD800, 61), *range(0xE000, 0x110000, 61), 0x10FFFF]):
        (spelt, _), = spell(c)
        assert bytes(map(byte_of.__getitem__, spelt)) == c.encode()
        seen |= set(c.encode())
    assert seen == set(range(256)) - {0xC0, 0xC1, *range(0xF5, 0x100)}


def test_op7_on_hindi_and_thai(spark):
    import json

    # the file's pieces as they are spelt, texts spelt by the library
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    with open(BPE, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = set(spec["model"]["vocab"]) - special
    texts = ["नमस्ते दुनिया यह एक परीक्षा है", "สวัสดีชาวโลก นี่คือการทดสอบ", "(สวัสดีชาวโลก) “นี่คือการทดสอบ”", "தமிழ் বাংলা ລາວ བོད", "plain words मिश्रित here"]

    def cut(word):
        spelt, at, n = spell(" " + word)[0][0], 0, 0
        while at < len(spelt):
            # the first piece has more than the space
            end = next((e for e in range(len(spelt), at + (at == 0), -1) if spelt[at:e] in vocab), None)
            if end is None:
                return None
            at, n = end, n + 1
        return n

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in wordpiece.count_tokens(rows, BPE).collect()}
    for k, text in enumerate(texts):
        counts = [cut(w) for w in text.split()]
        assert (got[k]["n_words"], got[k]["n_tokens"], got[k]["n_unknown"]) == (len(counts), sum(c or 1 for c in counts), counts.count(None))
    # no initial piece starts Thai words, but "(" does
    assert [got[k]["n_unknown"] for k in (0, 1, 2)] == [0, 2, 0]
