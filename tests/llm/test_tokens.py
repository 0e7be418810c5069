import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from geoloom.llm import pieces, queries, segments, storage, token_counts, token_ids  # noqa: E402

ALPHABET = [*"ab  \n\n\tcé中 ▁x \r.,'s1İΣ́|*", "🎉", "the", "<|endoftext|>", " foo", "don't ", "Straße"]


def texts(n, seed, most=14):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]
    return [*out, "", " ", "\n", " \n ", "\x1f b", "\x00a", "a  b   c", "word " * 5000]


def test_counts_equal_the_library():
    path = queries.tokenizer_file("byte_bpe_50k.json")
    counter = token_counts.TokenCounter(path)
    found = texts(3000, 1)
    assert counter.count(pa.array(found, pa.large_string())).tolist() == counter.lengths(found)


def test_ids_equal_the_library():
    encoder = token_ids.WordEncoder(queries.tokenizer_file("word_bpe_49k.json"))
    assert encoder.direct
    found = texts(3000, 2)
    offsets, ids = encoder.encode(pa.array(found, pa.large_string()))
    expected = [e.ids for e in encoder.tokenizer.encode_batch(found, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected


def test_pieces_equal_the_library_and_spans_cover():
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"))
    assert model.cuttable
    found = texts(2000, 3)
    offsets, ids, begins, ends = model.encode(pa.array(found, pa.large_string()))
    for k, (text, expected) in enumerate(zip(found, model.library.encode(found))):
        at = slice(offsets[k], offsets[k + 1])
        assert ids[at].tolist() == expected
        _, b, e = model.one(text)
        assert begins[at].tolist() == b and ends[at].tolist() == e
        if expected:
            assert b[0] == 0 and e[-1] == len(text.encode()) and all(x <= y for x, y in zip(b, e))


def test_normaliser_equals_the_library():
    import sentencepiece

    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = dict(pieces.wire_fields(next(v for f, v in pieces.wire_fields(library.serialized_model_proto()) if f == 3)))
        own = pieces.Normaliser(bytes(spec[2]), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        rng = random.Random(4)
        for _ in range(500):
            text = "".join(rng.choice("ＡＢ①  　xé中ﬁ́e​\ttA½カﾞ") for _ in range(rng.randint(0, 9)))
            out, source = own(text.encode())
            assert out.decode() == library.normalize(text)
            assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all()


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def mapped_model(tmp_path_factory):
    """The public pieces behind a real character map, with and without the removal of blanks."""
    import sentencepiece

    plain = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model")).library.serialized_model_proto()
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    spec = next(v for f, v in pieces.wire_fields(rule) if f == 3)
    paths = []
    for squeeze in (0, 1):
        fields = [(f, spec + b"\x18\x01\x20" + bytes([squeeze]) if f == 3 else v) for f, v in pieces.wire_fields(plain)]
        path = tmp_path_factory.mktemp("models") / f"mapped{squeeze}.model"
        path.write_bytes(b"".join(bytes([f << 3 | 2]) + varint(len(v)) + v for f, v in fields))
        paths.append(str(path))
    return paths


def test_a_real_character_map_through_the_operator(spark, mapped_model):
    """Ids, decoded texts and spans where longest prefixes of the map replace several bytes at once."""
    rng = random.Random(6)
    found = ["".join(rng.choice("ＡＢ①  　xé中ﬁ́e​\ttA½カﾞ the") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["ﬁne ½ カﾞ", "  a  ", "", " "]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(found)], "doc_id long, text string, n_tokens string, ids int")
    for path in mapped_model:
        m = pieces.model(path)
        assert m.normaliser.trie and not m.cuttable
        out = {r.doc_id: r for r in pieces.encode_pieces(docs, path, keep=["doc_id"]).collect()}
        for k, text in enumerate(found):
            r, data = out[k], text.encode()
            assert r.ids == m.library.encode(text) and r.decoded == (m.library.decode(r.ids) if r.ids else "")
            assert all(0 <= b <= e <= len(data) for b, e in zip(r.begins, r.ends)) and r.begins == sorted(r.begins) and r.begins[1:] == r.ends[:-1]
            for b, e, piece in zip(r.begins, r.ends, m.library.id_to_piece(r.ids) if r.ids else []):  # a whole span normalises to its piece
                whole = data[b:e].decode("utf-8", "ignore")
                inside = data[e:].decode("utf-8", "ignore")[:1] in ("ﬁ", "½")  # a piece may end within what replaces these
                if whole.encode() == data[b:e] and whole.isascii() and whole.strip() and not inside and not piece.startswith("<0x"):
                    assert m.library.normalize(whole).lstrip("▁") == piece.lstrip("▁")


def test_spans_of_single_bytes():
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"))
    text = "a 𓀀b"  # no piece holds the sign, so its bytes are pieces
    offsets, ids, begins, ends = model.encode(pa.array([text], pa.large_string()))
    assert list(zip(begins.tolist(), ends.tolist())) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)] and ids.tolist() == model.library.encode(text)


def test_batches_follow_bytes():
    batch = pa.RecordBatch.from_pydict({"k": list(range(50)), "text": ["x" * (i % 9) for i in range(49)] + ["y" * 5000]})
    parts = list(segments.byte_balanced(iter([batch, batch.slice(0, 0), batch]), "text", 40))
    assert [k for p in parts for k in p.column("k").to_pylist()] == [*range(50), *range(50)]
    assert all(sum(map(len, p.column("text").to_pylist())) <= 40 or p.num_rows == 1 for p in parts)


def test_caches_are_bounded_by_bytes():
    calls = []
    cache = segments.SegmentCache(lambda part: calls.append(len(part)) or [x.encode() for x in part], 100_000)
    for k in range(300):
        texts_ = [f"w{k}-{j}" for j in range(20)] + ["x" * 5000, "again"]
        assert cache(texts_) == [t.encode() for t in texts_]
        held = sum(segments.ENTRY_BYTES + len(s) + len(v) for g in (cache.young, cache.old) for s, v in g.items())
        assert held <= 100_000 and not any(len(s) > segments.LONGEST_KEPT for g in (cache.young, cache.old) for s in g)
    assert sum(calls) <= 300 * 21 + 60  # "again" stays known through the generations
    cache = segments.SegmentCache(lambda part: [1] * len(part), 10_000)
    assert cache(["a", *(str(k) for k in range(500)), "a"]) == [1] * 502


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


ROWS = [(3, "b a", "x", 1), (1, None, "x", 1), (2, "", None, 1), (5, "long word " * 30000, "x", 1), (5, "long word " * 30000, "x", 1), (None, "null id", "x", 1), (4, "Ünï 中", "x", 1)]


def test_count_query_on_odd_rows(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    out = token_counts.token_counts(docs_of(spark, ROWS), path)
    assert out.columns == ["doc_id", "ids", "n_bytes", "n_tokens", "over_limit"]
    counter = token_counts.counter(path)
    expected = sorted((str(i), len((t or "").encode()), counter.lengths([t or ""])[0]) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == expected
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


def test_piece_operator(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = pieces.model(path).library
    out = pieces.encode_pieces(docs_of(spark, ROWS), path, keep=["doc_id"])
    by_id = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in ROWS:
        ids = library.encode(t or "")
        assert by_id[i].ids == ids and by_id[i].decoded == library.decode(ids)
    again = pieces.decode_pieces(out, path)
    assert all(r.decoded == by_id[r.doc_id].decoded for r in again.collect())
    digests = {r.doc_id: r for r in queries.piece_results(docs_of(spark, ROWS)).collect()}
    ids = library.encode("Ünï 中")
    assert digests[4].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encode_pieces(docs_of(spark, []), path, keep=["doc_id"]).count() == 0


def test_token_files(spark):
    path, tokenizer = storage.new_path(spark, "t"), queries.tokenizer_file("word_bpe_49k.json")
    token_ids.write_token_files(docs_of(spark, ROWS), path, tokenizer, end_ids=(2,))
    rows = sorted(token_ids.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5]
    library = token_ids.encoder(tokenizer).tokenizer
    at = 0
    known = {i: t for i, t, *_ in ROWS}
    for k, r in enumerate(rows):
        ids = [*library.encode(known[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == at and r.n_tokens == len(ids) and zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert token_ids.read_record(path, k)[1].tolist() == ids
        at += len(ids)
    empty = storage.new_path(spark, "t")
    token_ids.write_token_files(docs_of(spark, []), empty, tokenizer)
    assert token_ids.read_token_files(spark, empty).count() == 0


def test_spans_and_batches_of_token_files_follow_bytes(spark, monkeypatch):
    tokenizer = queries.tokenizer_file("word_bpe_49k.json")
    rows = [(k, f"word {k} " * (k % 40)) for k in range(300)] + [(300, "long word " * 3000), (301, None)]
    read = {}
    for span, size in ((token_ids.SPAN_BYTES, token_ids.READ_BYTES), (2_000, 500), (1, 1)):
        monkeypatch.setattr(token_ids, "SPAN_BYTES", span)
        monkeypatch.setattr(token_ids, "READ_BYTES", size)
        monkeypatch.setattr(token_ids.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})()))
        writer = token_ids.TokenWriter({"path": storage.new_path(spark, "t"), "tokenizer": tokenizer, "end_ids": "2"}, token_ids.T.StructType.fromDDL("doc_id long, text string"))
        batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
        writer.commit([writer.write(iter([batch]))])
        reader = token_ids.TokenReader({"path": writer.path})
        parts = [[b.to_pylist() for b in reader.read(p)] for p in reader.partitions()]
        flat = [r for part in parts for b in part for r in b]
        assert [r["doc_id"] for r in flat] == [i for i, _ in rows] and [r["start"] for r in flat] == [sum(r["n_tokens"] for r in flat[:k]) for k in range(len(flat))]
        read[span] = ([r["ids"] for r in flat], len(parts), max(len(b) for part in parts for b in part))
    assert len({tuple(x[0]) for x in read.values()}) == 1
    assert read[1][1:] == (302, 1) and 1 < read[2_000][1] < 302 and read[2_000][2] < 302 and read[64 << 20][1:] == (1, 302)


def test_frames_notice_damage():
    good = token_ids.frame(token_ids.pack(-7, np.array([1, 2, 70000])))
    payload, end = token_ids.unframe(good, 0)
    assert end == len(good) and token_ids.unpack(payload)[0] == -7 and token_ids.unpack(payload)[1].tolist() == [1, 2, 70000]
    for k in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises((ValueError, Exception)):
            token_ids.unframe(bytes(bad), 0)


def test_texts_with_odd_spaces_are_split_and_counted_right():
    import random

    from geoloom.llm import segments
    from geoloom.llm.token_counts import counter

    one = counter(queries.tokenizer_file("byte_bpe_50k.json"))
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\f", "\x0b", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", *segments.MARKS[:4], "a", "word", "'s", "12", "!?", "漢字", "e\u0301", "😀", "<|endoftext|>", "<|endoftext|"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(4000)]
    got = [n for k in range(0, len(texts), 40) for n in one.count(pa.array(texts[k : k + 40], pa.large_string()))]
    assert got == one.lengths(texts)
    seen = []
    lengths, one.cached.encode = one.cached.encode, lambda s: (seen.extend(map(len, s)), lengths(s))[1]
    page = "a\xa0page with <|endoftext|> and many words " * 20_000
    assert one.count(pa.array([page], pa.large_string()))[0] == lengths([page])[0] and max(seen, default=0) < 100
    one.cached.encode = lengths


def test_stores_that_tasks_cannot_write_to(spark):
    from geoloom.llm import storage

    assert storage.qualified(spark, "/some/where") == "file:/some/where"
    assert storage.open_fs("file:/some/where")[1] == "/some/where" == storage.open_fs("file:///some/where")[1]
    for uri in ("/bare/path", "viewfs://store/a", "nothing"):
        with pytest.raises(ValueError):
            storage.open_fs(uri)
