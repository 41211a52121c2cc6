import random
import zlib

import numpy as np

from hopframe.llm import packing
from hopframe.llm.tokens import PieceEncoder, vocabulary


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocabulary()), PieceEncoder(vocabulary(), most=5)
    texts = ["", None, "a b", " a  b ", "x \n y\n\n z", "it's  I'll\t we've", "é ñ 漢字 　 x", "a <|endoftext|> b", "  ", "a ", "1,234 !! ok"]
    r = random.Random(3)
    texts += ["".join(r.choice("ab's \n\t é1. ") for _ in range(r.randint(0, 40))) for _ in range(400)]
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        for x, ids in zip(part, e.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_every_id_once_without_padding(spark):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(vocabulary()), random.Random(4)
    docs = [(i, " ".join(r.choice(["the", "Häuser", "xyz,", "of"]) for _ in range(r.choice((0, 3, 200, 1500)))), "z") for i in range(60)]
    docs += [(100, None, None), (101, "", "q"), (102, "word " * 9000, "w"), (5, "again", "dup")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, offset string").repartition(3)).collect()
    pieces, seqs = {}, {}
    for p in rows:
        assert p.length * 4 == len(p.ids) > 0
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, text, _ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(pieces[doc, len(ids)])
        assert np.frombuffer(b"".join(x for _, x in got), "<u4").tolist() == ids
        assert [s for s, _ in got] == np.cumsum([0] + [len(x) // 4 for _, x in got])[:-1].tolist()
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    got = packing.digest(packing.pack(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"))).collect()
    whole = packing.pack(spark.createDataFrame([(1, "hello there")], "doc_id long, text string")).collect()
    assert {(g.start, g.ids_crc32) for g in got} == {(w.start, zlib.crc32(bytes(w.ids))) for w in whole}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_starts_equal_the_tokenizers_offsets():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocabulary()), PieceEncoder(vocabulary(), spans=True)
    texts = ["héllo wörld 漢字漢字 it's  two\n x", "plain words, with  gaps ", "", "ñandú 🙂 🙂🙂 end"]
    for x, pieces in zip(texts, e.encode(texts), strict=True):
        got, at = [], 0
        for chars, starts in pieces:
            got += ((np.frombuffer(starts, "<u4") >> 1) + at).tolist()
            at += chars
        assert got == [a for a, _ in t.encode(x, add_special_tokens=False).offsets] and at == len(x)


def test_other_tokenizer_files_equal_tokenizers(tmp_path):
    """Files with another normaliser, prefix space, post-processor or model are not cut at spaces."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    told = json.load(open(vocabulary(), encoding="utf-8"))
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}, {"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}]
    paths = [public_tokenizers.path("word_bpe_49k.json")]
    for i, c in enumerate(changes):
        (tmp_path / f"{i}.json").write_text(json.dumps(told | c))
        paths.append(str(tmp_path / f"{i}.json"))
    texts = ["Hello World, it's HERE", "no lead", "", None, "Ä b  C\nD \U0001f642 end " * 3]
    for path in paths:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        ids, spans = PieceEncoder(path).encode(texts), PieceEncoder(path, spans=True).offsets([x or "" for x in texts])
        for x, got, (a, b) in zip(texts, ids, spans, strict=True):
            e = t.encode(x or "", add_special_tokens=False)
            assert np.frombuffer(got, "<u4").tolist() == e.ids, (path, x)
            assert list(zip(a.tolist(), b.tolist(), strict=True)) == e.offsets, (path, x)


def packed(lengths, capacity=1024):
    bins = packing.Bins(capacity, 0)
    rows = [r for i, n in enumerate(lengths) for r in bins.add((i, 0, bytes(4 * n), n))] + bins.close()
    got, seqs = {}, {}
    for seq, off, (doc, start, ids, total) in rows:
        got.setdefault(doc, []).append((start, len(ids) // 4))
        assert seqs.get(seq, 0) == off and total == lengths[doc]
        seqs[seq] = off + len(ids) // 4
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got[i]):
            assert start == at and k > 0
            at += k
        assert at == n
    assert all(n == capacity or (n < capacity and n & (n - 1) == 0) for n in seqs.values())
    fits = [i for i, n in enumerate(lengths) if n <= capacity]
    return sum(len(got[i]) == 1 for i in fits) / max(1, len(fits)), rows


def test_documents_stay_whole_in_bins_of_their_class():
    r = random.Random(2)
    mixed = [max(1, int(r.lognormvariate(6.2, 1.1))) for _ in range(4000)]
    whole, rows = packed(mixed)
    assert whole > 0.97
    seqs = {}
    for seq, _, (doc, *_rest) in rows:
        seqs.setdefault(seq, []).append(mixed[doc])
    assert sum(all(1024 // n == k for n in [x for x in ns if x <= 1024]) for ns in seqs.values() for k in [sum(x <= 1024 for x in ns)] if 0 < k <= 16) > 500
    for lengths in ([1] * 3000, [1024] * 9, [600] * 900, [700, 300] * 400, [5000] * 50, [1], [], [513] * 7 + [3], [r.randint(513, 1024) for _ in range(1500)]):
        packed(lengths)
    packed([r.randint(1, 40) for _ in range(500)], capacity=16)
    assert packing.counts(8) == [1, 2, 3, 4, 5, 6, 7, 8] and packing.counts(64)[-3:] == [16, 32, 64]
    assert packed([700, 300] * 400)[0] > 0.9
