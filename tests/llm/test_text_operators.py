"""Chat formatting, personal data, tokens, packing, files, counts: against plain Python on small tables with odd rows."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import bitpack, bpe_fst, chat, common, packing, pii, queries, tokens, wordpiece
from lattica.llm.common import pattern, tokenizer_path

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
JSON, RANKS, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ODD = [
    (0, "The quick brown fox, jumps over the lazy dog."),
    (1, None),
    (2, ""),
    (3, "  two  blanks \n\n and\ttabs \r\n at the end  "),
    (4, "naïve café 日本語 😀 \u0000 <|endoftext|> ࢏ ꟎"),
    (5, "word " * 3000),
    (6, "x" * 5000),
    (7, "The quick brown fox, jumps over the lazy dog."),
    (8, "don't we'll 123 4567 !!! ... ---     z"),
    (None, "no id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use inside."""
    rows = [(i, t, "en", j, b"x", 1.0, 7) for j, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, piece binary, start double, sequence_id int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- chat


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", chat.F.lit(3))


def test_chat_round_trip_and_masks(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k} <|im_end|> <\\| <\\\\|x") for k in range(7)]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", None), (2, None, None, "a"), (None, 0, "user", "n"), (3, 0, "we<|ird\nrole", "<|im_start|>assistant\nok")]
    blocks = chat.format_conversations(conversations(spark, rows), block=2)
    back = {}
    for r in chat.read_back(blocks).orderBy("conv_id", "block").collect():
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    want = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    examples = chat.example_texts(blocks).where("conv_id = 1").orderBy("turn").collect()
    assert [e.turn for e in examples] == [1, 3, 5]
    for e in examples:
        assert chat_unescape(e.text[e.loss_start : e.loss_end]) == f"text {e.turn} <|im_end|> <\\| <\\\\|x"
        assert e.text.count(chat.START) == e.turn + 1 and e.text.endswith(chat.END)
    assert chat.format_conversations(conversations(spark, rows).limit(0)).count() == 0


def chat_unescape(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@here
@pytest.mark.parametrize("name", ["op2_chat_prefix_targets", "op5_pii"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("conversations", "documents"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = db.execute(queries.oracle_sql()[name]).df()[got.columns]
    key = [got.columns[0]]
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_no_python_in_native_plans(spark, docs):
    for df in (pii.find_pii(docs), pii.redact(docs), chat.read_back(chat.format_conversations(conversations(spark, [(1, 0, "user", "a")])))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- personal data


def luhn(s):
    return sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]
    return out


PIECES_OF_TEXT = ["a@b.c", "_d@e.fg", "@", ".", "x.y@z-1.co.uk", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", " ", "-", "é日", "+1 (555) 010-9999", "+", "12", "(", "\n", "😀"]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice(PIECES_OF_TEXT, rng.integers(0, 12)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "9" * 20000), (903, "a" * 50000 + "@"), (904, "1.2.3.4 " * 800)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.collect():
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in pii.BASE] == base_spans(r.text or ""), r.text


def test_checked_kinds_context_and_redaction(spark):
    texts = ["my IBAN GB82 WEST 1234 5698 7654 32.", "IBAN GB82 WEST 1234 5698 7654 33.", "SSN 123-45-6789", "part 123-45-6789", "mail é a@b.co, card 4111111111111111 x", None]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii_spans] for r in got] == [["iban"], [], ["ssn"], [], ["email", "card"], []]
    assert got[4].pii_spans[0].score > pii.PRIOR["email"]
    clean = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert clean[4].text == "mail é [EMAIL], card [CARD] x" and clean[0].text == "my IBAN [IBAN]." and clean[5].text is None


def test_more_kinds_and_context_on_either_side(spark):
    texts = [
        "iban BE68 5390 0754 7034 FROM bank", "219-09-9999 is my ssn", "order 219-09-9999 is my ssn, or serial", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é',
        "file 04dbebab91ab85687d33eeaaf9ac699e1188f962 of it", "BE68539007547034", "XX68 5390 0754 7034", "key abcdefghijklmnopqrstuvwxyz",
    ]
    df = spark.createDataFrame([(i, t, "user's own") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, pii_spans string")
    got = pii.find_pii(df.drop("pii_spans")).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.pii_spans] for r in got] == [[("iban", 5, 24)], [("ssn", 0, 11)], [], [("secret", 9, 49)], [], [("iban", 0, 16)], [], [], [("iban", 5, 24)]]
    clean = pii.redact(df)
    assert clean.columns == df.columns and {r.pii_spans for r in clean.collect()} == {"user's own"}
    assert clean.where("doc_id = 0").first().text == "iban [IBAN] FROM bank" and clean.count() == 9
    assert pii.redact(df.limit(0)).count() == 0 and pii.find_pii(df.limit(0)).count() == 0


def test_examples_carry_their_replies(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text <| {t}") for t in range(700)] + [(None, 0, "assistant", "x"), (2, None, "assistant", "a"), (2, -5, "user", "b")]
    blocks = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=16)
    found = chat.prefix_targets(blocks).withColumn("reply", chat.unescape(F.col("target"))).orderBy("conv_id", "loss_start").collect()
    assert [r.reply for r in found if r.conv_id == 1] == [f"text <| {t}" for t in range(1, 700, 2)]
    assert [r.reply for r in found if r.conv_id in (None, 2)] == ["x", "a"]
    assert all(r.loss_end - r.loss_start == len(r.target) and r.example_chars == r.loss_end + len(chat.END) for r in found)
    assert chat.prefix_targets(blocks.limit(0)).count() == 0


def test_slices_follow_rows_and_bytes():
    big = pa.RecordBatch.from_pydict({"i": list(range(40)), "t": ["x" * (3000 if k % 7 else 90_000) for k in range(39)] + [None]})
    parts = list(common.sliced([big], rows=16, size=50_000))
    assert sum(p.num_rows for p in parts) == 40 and max(p.num_rows for p in parts) <= 16
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(40))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("t").to_pylist()) <= 50_000 for p in parts)
    assert list(common.sliced([big.slice(0, 0)])) == []


def test_one_operators_state_in_a_worker():
    first = common.resident(("a",), lambda: [1])
    assert common.resident(("a",), lambda: [2]) is first
    assert common.resident(("b",), lambda: [3]) == [3] and common.resident(("a",), lambda: [4]) == [4]
    common.release()


def test_counts_and_files_of_odd_tables(spark, library):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wordpiece.count_tokens(none, PIECES).count() == 0
    same = spark.createDataFrame([(4, "a b"), (4, "a b"), (4, None), (1, "c")], "doc_id long, text string")
    back = bitpack.read_ids(bitpack.write_ids(same, JSON, pattern())).orderBy("start").collect()
    assert [r.doc_id for r in back] == [1, 4, 4, 4] and [np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in back] == [library("c"), [], library("a b"), library("a b")]


# ---------------------------------------------------------------- token ids


def small_memory(encoder, size=10_000):
    encoder.words.most = encoder.parts.most = size
    return encoder


def test_cached_encoder_equals_the_library(library):
    e = small_memory(tokens.CachedEncoder(JSON, pattern()), 3000)
    for _, text in ODD:
        assert np.frombuffer(e.encode(text or ""), "<u4").tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab th'ns.,0é日\n\t  <|>")), max_size=40))
def test_cached_encoder_fuzz(library, text):
    assert np.frombuffer(tokens.encoder(JSON, pattern()).encode(text), "<u4").tolist() == library(text)


def test_columns_of_texts_are_encoded_by_their_different_words(library, reference, monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 3)
    monkeypatch.setattr(tokens, "LONG", 10_000)
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert all(re.search(tokens.ODD_BLANK, f"a {c}b") for c in blanks) and re.search(tokens.ODD_BLANK, "a ") and not re.search(tokens.ODD_BLANK, "a b\n\u200bc")
    given = ["skipped", *(t for _, t in ODD), "été où, naïveté!! où", "\nstarts so", *(f"a {c}b{c} c" for c in blanks), *(f"ends so{c}" for c in blanks)]
    column = pa.array(given).slice(1)
    for encoder, expected in ((tokens.CachedEncoder(JSON, pattern()), library), (bpe_fst.Encoder(RANKS, pattern()), lambda x: reference.encode_ordinary(x or ""))):
        for _ in range(2):  # the second time from the cache
            assert [np.frombuffer(x, "<u4").tolist() for x in small_memory(encoder, 3000).encode_all(column)] == [expected(t) for t in given[1:]]
        assert encoder.encode_all(column.slice(0, 0)) == [] and encoder.encode_all(pa.array([None, ""], pa.string())) == [b"", b""]


def test_the_model_takes_new_parts_together():
    e, calls = tokens.CachedEncoder(JSON, pattern()), []
    whole, e.spelled = e.spelled, type("Counted", (), {"encode_batch_fast": lambda _, x, **k: calls.append(x) or whole.encode_batch_fast(x, **k)})()
    parts = [" fox", "s", ".\"", " été", "日本", "123", " <|endoftext|>"]
    assert e.new_parts(parts) == [e.whole(p) for p in parts[:-1]] + e.new_parts(parts[-1:]) and len(calls) == 2
    assert e.new_parts([]) == []


def test_pieces_and_packing(spark, docs, library):
    rows = packing.pack_documents(docs, JSON, pattern(), capacity=64, open_bins=3, window=4).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in ODD}
    for i, text in ODD:
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*library(text), 2]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.length == 64 for p in parts[1:]) and 0 < parts[0].length <= 64
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), JSON, pattern()).count() == 0


def test_texts_of_a_batch_are_looked_up_together(library, monkeypatch):
    calls, encode_all = [], tokens.CachedEncoder.encode_all
    monkeypatch.setattr(tokens.CachedEncoder, "encode_all", lambda self, column: calls.append(len(column)) or encode_all(self, column))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": pa.array([None, *(f"text {k} of a batch." for k in range(1, 1000))])})
    pieces = [x for b in packing._cut(JSON, pattern(), 1024, 2)(iter([batch])) for x in b.to_pylist()]
    assert calls == [1000] and [np.frombuffer(p["ids"], "<u4").tolist() for p in pieces] == [[*library(t), 2] for t in batch.column("text").to_pylist()]


def test_packing_is_near_the_bound(spark):
    lengths = np.random.default_rng(1).integers(1, 900, 5000)
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "k long, length long").repartition(5)
    packed = packing.pack(table)
    assert packed.count() == 5000
    n = packed.select("sequence_id").distinct().count()
    assert n <= 1.02 * lengths.sum() / 1024 + 1
    assert packing.sequences(packed.withColumn("ids", packing.F.lit(b"\0\0\0\0"))).agg(packing.F.max("length")).first()[0] <= 1024


def test_best_fit_chooses_the_tightest_bin_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert b.place(6)[:2] == (0, 0) and b.place(7)[:2] == (1, 0)
    assert b.place(3) == (1, 7, [1])  # a perfect fit closes
    assert b.place(5)[0] == 2
    assert b.place(8) == (3, 0, [0])  # no bin fits, two are open: the one with least space goes
    with pytest.raises(ValueError):
        b.place(11)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_bits_round_trip(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], "<u4")
    assert (bitpack.unpack_bits(bitpack.pack_bits(ids, bits), len(ids), bits) == ids).all()


def test_files_read_back_in_order(spark, docs, library, tmp_path):
    manifest = bitpack.write_ids(docs.repartition(3), JSON, pattern(), folder=str(tmp_path / "ids"), files=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in bitpack.read_ids(manifest).collect())
    at, want = 0, []
    for i, text in sorted((i, t) for i, t in ODD if i is not None):
        ids = np.array([*library(text), 2], "<u4")
        want.append((i, at, len(ids), ids.tobytes()))
        at += len(ids)
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == want
    first = bitpack.Reader(manifest.orderBy("file").first().path)
    whole = first.ids(0, first.n_ids)
    assert (first.ids(5, 11) == whole[5:11]).all() and first.bits == 16
    assert (first.document(first.n_docs - 1) == whole[-first.lengths[-1] :]).all()
    with pytest.raises(IndexError):
        first.ids(0, first.n_ids + 1)
    assert bitpack.read_ids(bitpack.write_ids(docs.limit(0), JSON, pattern(), files=2)).count() == 0


def test_blocks_of_a_file(tmp_path):
    w = bitpack.Writer(str(tmp_path / "x"), 13, block_ids=7)
    ids = [np.random.default_rng(k).integers(0, 1 << 13, k * 3).astype("<u4") for k in range(8)]
    for k, x in enumerate(ids):
        w.add(k - 3, x.tobytes())
    w.close()
    r = bitpack.Reader(str(tmp_path / "x"))
    assert r.docs.tolist() == list(range(-3, 5)) and all((r.document(k) == x).all() for k, x in enumerate(ids))


# ---------------------------------------------------------------- transducer


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return small_memory(bpe_fst.Encoder(RANKS, pattern()))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aeth n0é日'=-\n\t😀")), max_size=40))
def test_transducer_equals_tiktoken(machine, reference, text):
    assert np.frombuffer(machine.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_transducer_emits_before_a_parts_end():
    ranks = bpe_fst.read_ranks(RANKS)
    m = bpe_fst.Transducer(ranks)
    assert b"".join(m.token[t] for t in m.encode(b"ab" * 5000)) == b"ab" * 5000
    state, last = 0, [-1]
    for byte in b"the quick brown fox":  # what is certain lies less than the longest token behind
        state, ends = m._move(state, byte)
        last.append(next(t for t, n in ends if (b := last[len(last) - n] if n <= len(last) else -2) == -1 or (b >= 0 and m.may_follow(b, t))))
    assert m._certain(state, last) >= len(last) - 1 - max(map(len, ranks))
    assert m._back(last, m._certain(state, last)) == m.encode(b"the quick brown fox")[: len(m._back(last, m._certain(state, last)))]


def test_recent_keeps_what_is_asked_for_again():
    r = tokens.Recent(2 * (tokens.ENTRY + 3) * 4)
    for k in range(20):
        r.turn()
        new = r.missing({"a", chr(98 + k)})
        r.put(new, [x.encode() for x in new])
        assert r.young["a"] == b"a" and len(r.young) + len(r.old) <= 12


def test_transducer_on_long_parts_and_small_memory(reference):
    small = small_memory(bpe_fst.Encoder(RANKS, pattern()), 1000)
    small.machine.kept = 20
    for text in ("a" * 5000, "ab" * 3000, " " * 2000, "=" * 1500, *(t or "" for _, t in ODD)):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=8))
def test_streaming_decoder_equals_pythons(slices):
    d = bpe_fst.StreamDecoder(slices)
    got = "".join(d.feed([k]) for k in range(len(slices))) + d.end()
    assert got == b"".join(slices).decode("utf-8", "replace")


def test_bpe_table_round_trip(spark, docs, reference):
    found = bpe_fst.decode_ids(bpe_fst.encode_texts(docs, RANKS, pattern()), RANKS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in found) == sorted((-1 if i is None else i, t or "") for i, t in ODD)
    assert all(list(r.ids) == reference.encode_ordinary(r.text) for r in found)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(bpe_fst.round_trip(docs, RANKS, pattern()).collect(), key=key) == sorted(found, key=key)
    assert bpe_fst.round_trip(docs.limit(0), RANKS, pattern()).count() == 0


# ---------------------------------------------------------------- counts


def greedy(pieces, word):
    n = 0
    while word:
        size = max((k for k in range(1, len(word) + 1) if word[:k] in pieces), default=0)
        n += 1 if size else len(word[0].encode())
        word = word[size or 1 :]
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abcd", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcdé", max_size=20))
def test_automaton_counts_greedy_pieces(pieces, word):
    assert wordpiece.Automaton(sorted(pieces)).count(word) == greedy(pieces, word)


def test_counts_of_a_table(spark, docs):
    pieces = set(wordpiece.read_pieces(PIECES))
    got = {r.doc_id: (r.n_words, r.n_tokens, r.longest_word) for r in wordpiece.count_tokens(docs, PIECES).collect()}
    for i, text in ODD:
        each = [greedy(pieces, wordpiece.MARK + w) for w in (text or "").split()]
        assert got[i] == (len(each), sum(each), max(each, default=0))


@here
def test_digests_of_queries_follow_the_operators(spark, library):
    d = SF
    first = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").first()
    six = queries.op6_bpe_transducer(spark, d).where(f"doc_id = {first.doc_id}").first()
    assert six.decoded_sha256 == hashlib.sha256(first.text.encode()).hexdigest()
    assert six.ids_sha256 == hashlib.sha256(" ".join(map(str, library(first.text))).encode()).hexdigest()
    nine = queries.op9_packed_ids(spark, d).where(f"doc_id = {first.doc_id}").first()
    assert nine.ids_crc32 == zlib.crc32(np.array([*library(first.text), 2], "<u4").tobytes()) and nine.start == 0
