import __spark_entry__ as e
import regex
from weftspark.llm.encode import PRE_TOKEN, encoder, DEFAULT_VOCABULARY

SF = "/root/testdata/sf0.001"


def naive(text):
    """Merges the first adjacent pair of least rank over a plain list, again and again."""
    enc = encoder(DEFAULT_VOCABULARY)
    ranks = dict(zip(enc.keys_, enc.ids))
    out = []
    for token in regex.findall(PRE_TOKEN, text or ""):
        parts = [bytes([b]) for b in token.encode()]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_every_document_has_its_ids(spark):
    found = {r.doc_id: r.ids for r in e.queries()["p6_ids"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        assert found[doc_id] == naive(text)


def test_ids_give_the_text_back(spark):
    enc = encoder(DEFAULT_VOCABULARY)
    key_of = dict(zip(enc.ids, enc.keys_))
    for text in ("", None, "a  b\r\n\n c<|endoftext|>", "\u200b\u0301 \U0001f600 \u4f60\u597d"):
        assert b"".join(key_of[i] for i in enc.encode(text)) == (text or "").encode()


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_perfect_hash_over_the_vocabulary_ends():
    hash_ = encoder(DEFAULT_VOCABULARY).hash
    assert sorted(hash_.slots) == list(range(hash_.n))


def test_duplicate_keys_raise_and_any_key_type_stays(spark, monkeypatch):
    import pytest
    from weftspark.llm import encode

    with pytest.raises(ValueError):
        encode.PerfectHash([b"a", b"b", b"a"])
    df = spark.createDataFrame([("x", "a b", "clash"), ("x", None, ""), (None, "", "")], "name string, text string, ids string")
    monkeypatch.setattr(encode, "FLUSH", 1)
    rows = [tuple(r) for r in encode.encode_ids(df, key="name").collect()]
    assert rows == [("x", naive("a b")), ("x", []), (None, [])]
    assert encode.encode_ids(df.limit(0), key="name").collect() == []
    assert [r.n_tokens for r in encode.token_counts(df, key="name").collect()] == [2, 0, 0]


def test_very_long_word():
    text = "ab" * 100_000
    ids = list(encoder(DEFAULT_VOCABULARY).encode(text))
    keys = dict(zip(encoder(DEFAULT_VOCABULARY).ids, encoder(DEFAULT_VOCABULARY).keys_))
    assert b"".join(keys[i] for i in ids).decode() == text
