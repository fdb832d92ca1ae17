import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import encoding, lookalike, tokens

WORDS = "bölme duvar iç duvar dış duvar kapı yangın kapısı döşeme çerçeve süpürgelik YATAK ODASI GİRİŞ HOLÜ ÇALIŞMA ODASI şaft 12.50 m² ±3.20 стена перегородка τοίχος σκάλα ýmis frágangur þak brýr příčka štítová zeď"


@pytest.fixture(scope="module")
def corpus():
    return [WORDS] * 40 + ["", " ", "plain text"]


@pytest.fixture(scope="module")
def judge(spark, corpus):
    return encoding.Restorer(encoding.gather(spark.createDataFrame([(t,) for t in [*corpus, None]], "t string")))


@pytest.mark.parametrize("text,wrong,right", [("döşeme", "cp1252", "utf-8"), ("kapısı", "cp437", "utf-8"), ("стена", "cp1251", "utf-8"), ("GİRİŞ", "cp1252", "cp1254"), ("çerçeve", "cp1252", "cp857"), ("τοίχος", "cp1252", "cp1253"), ("перегородка", "cp1251", "koi8-r"), ("příčka", "cp1252", "cp1250"), ("süpürgelik", "cp1251", "cp1254")])
def test_restores(judge, text, wrong, right):
    table = encoding.DECODE[wrong]
    garbled = "".join(table[b] or chr(b) for b in text.encode(right))
    assert judge.text(f"x {garbled} y") == (True, f"x {text} y", True, "span" if right == "utf-8" else "single_byte")


@pytest.mark.parametrize("text", ["bölme", "MÜDÜR", "kapısı", "стена", "ŞAFT-12"])
@pytest.mark.parametrize("wrong", ["cp1252", "cp437", "cp1251"])
def test_garble_on_a_third_of_all_rows(text, wrong):
    table = encoding.DECODE[wrong]
    garbled = "".join(table[b] or chr(b) for b in text.encode())
    corpus = [WORDS, "MÜDÜR ŞAFT"] * 40 + [garbled] * 4000
    words = [w for t in corpus for w in encoding.BLANK.split(t)[::2]]
    counts = np.zeros(2 * encoding.SLOTS, np.float32)
    for w in words:
        shape = encoding._shape(w)
        for key in (*(shape[i : i + 3] for i in range(len(shape) - 2)), *shape):
            for k in encoding._slots(key):
                counts[k] += 1
    found = encoding.Restorer(encoding.Statistics(counts))
    assert found.text(garbled) == (True, text, True, "span")
    assert not any(found.text(t)[0] for t in (WORDS, "MÜDÜR ŞAFT"))
    assert not any(found._certain(a, b) for a, b in (("ΤΟΊΧΟΣ", "ΤϺΧΟΣ"), ("Δ\xadh=1470", "ĭh=1470"), ("X\xa0ÜBERSICHT", "XʆBERSICHT")))


def test_double_and_lost(judge):
    twice = "çerçeve".encode().decode("cp1252").encode().decode("cp1252")
    assert judge.text(twice) == (True, "çerçeve", True, "span")
    deep = "döşeme"
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    assert judge.text(deep) == (True, "döşeme", True, "span")
    assert judge.text("d�� duvar") == (True, "d�� duvar", False, "lost")


def test_sound_text_is_left(judge, corpus):
    for t in [*corpus, "YATAK ОDASI", "bölme\xa0duvar", "ｋａｐı", "a" * 200_000, "ö" * 50_000]:
        assert judge.text(t)[:2] == (False, t)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
def test_automaton_finds_what_a_decoder_accepts(raw):
    spans = encoding.multibyte_spans(list(raw))
    for a, b, point in spans:
        assert raw[a:b].decode() == chr(point) and b - a > 1
    covered = {i for a, b, _ in spans for i in range(a, b)}
    for a in range(len(raw)):
        for n in (2, 3, 4):
            part = raw[a : a + n]
            try:
                one = len(part) == n and len(part.decode()) == 1
            except UnicodeDecodeError:
                one = False
            if one:
                assert set(range(a, a + n)) <= covered


ROWS = "row_id long, value string, restored_ string, text string, layer string"


def test_restore_rows(spark, judge):
    garbled = "döşeme".encode().decode("cp1252")
    df = spark.createDataFrame([(1, garbled, "x", garbled, "kapı\u200b"), (2, None, "x", None, None), (3, "", "x", "", "k\xa0pencere"), (4, "kapı", "x", "kаpı", "kapı"), (1, garbled, "x", None, "ﬁtout")], ROWS)
    got = encoding.restore(df, "value", judge.stats).collect()
    assert [(r.row_id, r.restored, r.is_whole) for r in got] == [(1, "döşeme", True)] * 2
    assert {r.how for r in got} == {"span"}
    assert encoding.restore(df.limit(0), "value", judge.stats).count() == 0
    assert encoding.gather(df.limit(0).select("value")).table.sum() == 0


@pytest.mark.parametrize("raw,plain,why", [
    ("KAT PLANI", "KAT PLANI", ""),
    ("KAТ PLАNΙ", "KAT PLANI", "letter"),
    ("ЅΙĞΙΝΑΚ", "SIĞINAK", "letter"),
    ("ФАСAД", "ФАСАД", "letter"),
    ("ПЛАН 4 ЭТАЖА", "ПЛАН 4 ЭТАЖА", ""),
    ("ΚΟΥΖΙΝΑ 58.40 m²", "ΚΟΥΖΙΝΑ 58.40 m²", ""),
    ("Δh=650 kot farkı", "Δh=650 kot farkı", ""),
    ("U value λ 0.08", "U value λ 0.08", ""),
    ("ПЛАН\nKITCHEN", "ПЛАН\nKITCHEN", ""),
    ("ｋａｐı １２", "kapı 12", "form"),
    ("\u212aAT", "KAT", "form"),
    ("s\u0327aft", "şaft", "accent"),
    ("DURCHGА\u0308NGE", "DURCHGÄNGE", "accent,letter"),
    ("a\u200bb\xadc\ufeff", "abc", "invisible"),
    ("a\xa0b\u2009c\u3000d", "a b c d", "blank"),
    ("a\tb", "a b", "blank"),
    ("5 m² ±2 Ø16 30° 1.º", "5 m² ±2 Ø16 30° 1.º", ""),
    ("20 \u00b5m", "20 \u00b5m", ""),
    ("12 ㎡ ㎏", "12 m2 kg", "form"),
    ("½ ¾ x² ①", "½ ¾ x² 1", "form"),
    ("ﬁre ﬀ", "fire ff", "form"),
    ("ﹽ", "ـّ", "accent,form"),
    ("", "", ""),
    ("\u200b", "", "invisible"),
])
def test_spelling(raw, plain, why):
    assert lookalike.spelling(raw) == (plain, why)


def test_compare_keys():
    key = lookalike.compare_key
    assert key("ＫＡＰＩ\xa0 2") == key("kapı 2") == key("KAPI 2") == "kapi 2"
    assert key("Straße") == key("STRASSE")
    assert key("ﬁ ㎡ x² ½") == key("FI M2 X2 1⁄2")
    assert key("x" * 100_000) == "x" * 100_000


def test_spell_columns(spark):
    df = spark.createDataFrame([(1, "kаpı", None, "a"), (2, None, "", "b"), (2, None, "", "b")], "row_id long, text string, layer string, spelling string")
    got = sorted((r.row_id, r.field_name, r.spelling, r.odd) for r in lookalike.spell_columns(df, ["row_id"], ["text", "layer"]).collect())
    assert got == [(1, "text", "kapı", "letter"), (2, "layer", "", ""), (2, "layer", "", "")]


VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"


def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(4)
    alphabet = "abcçğışöü ABC  \n\t'012345.,;ßéя漢字😀\x00\x1c\x85\u200b\xa0aaaa"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(800)]
    texts += ["", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>", "it's I'LL we've", "\n\n \n", "x\u2028y"]
    got = [x.tolist() for part in tokens.Encoder(tokens.Pairs.read(VOCABULARY)).batches(texts) for x in part]
    assert got == reference()(texts)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 40)
    texts = [f"word{i % 7} and other{i} words" for i in range(60)]
    got = [x.tolist() for part in tokens.Encoder(tokens.Pairs.read(VOCABULARY)).batches(texts) for x in part]
    assert got == reference()(texts)


def test_token_rows(spark):
    df = spark.createDataFrame([(1, "hello  world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df, ["doc_id"]).collect())
    assert got == [(1, reference()(["hello  world"])[0]), (2, []), (3, []), (3, [])]
    assert sorted(r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()) == [0, 0, 0, 3]
    assert tokens.token_ids(df.limit(0), ["doc_id"]).collect() == []
    assert tokens.token_ids(df, ["doc_id"]).schema["ids"].dataType.simpleString() == "array<int>"


def test_empty_words():
    ids, ends = tokens.Pairs.read(VOCABULARY).encode([])
    assert len(ids) == 0 and len(ends) == 0 and isinstance(ids, np.ndarray)


LONG = [
    "a" * 3001,
    "ab" * 2000 + "ba" * 999,
    "ÇŞĞ" * 900,
    "".join(random.Random(5).choice("ACGT") for _ in range(6000)),
    "".join(chr(random.Random(i).randrange(0x4E00, 0x9000)) for i in range(2000)),
    "x " + "the" * 700 + " y",
]


def test_long_words_as_by_the_library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    got = tokens.Encoder(tokens.Pairs.read(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")).texts(LONG)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in LONG]


def test_a_megabyte_without_blanks_in_seconds():
    pairs = tokens.Pairs.read(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.process_time()
    ids = tokens.Encoder(pairs).texts([text])[0]
    assert time.process_time() - began < 15
    stands = tokens.id_bytes(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    assert b"".join(stands[i] for i in ids).decode() == text


def test_round_trip_of_rows(spark):
    rows = [(1, "Duvar ğüş 😀 <|endoftext|>"), (2, ""), (3, None), (3, "  \n x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.texts_of(tokens.token_ids(df, ["doc_id"]), ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted((i, t or "") for i, t in rows)
