"""Cases that were once missed: entities of odd form, clashing column names, words in digits, references cut by tags."""

import re

import numpy as np
import pyarrow as pa

from prosegauge.llm import htmltext, pieces, pii, suffix, toxicity

PROBES = {
    "josé@exemple.fr": "write to josé@exemple.fr today",
    "müller@web.de": "write to müller@web.de today",
    "3782 822463 10005": "card 3782 822463 10005 is mine",
    "0301234567": "call 0301234567 now",
    "555-1234": "call 555-1234 now",
    "JOHN SMITH": "signed JOHN SMITH here",
    "José García": "by José García alone",
    "O'Brien": "ask Ms O'Brien first",
    "McDonald": "ask Mr. McDonald first",
    "Dyke": "ask Dr. van Dyke first",
    "Quentin Abbott": "hello, my name is Quentin Abbott and",
    "hunter2": "password: hunter2 is set",
    "abc": "token = abc is set",
    "A1b2C3d4E5f6G7h8I9j0": "key ghp_A1b2C3d4E5f6G7h8I9j0 is set",
    "fe80::1": "host fe80::1 is up",
    "secretpw": "see http://user:secretpw@host for it",
}


def test_entities_of_odd_form(spark):
    rows = list(enumerate(PROBES.values()))
    clean = ["The secret: never give up", "chapter 12:30 of 100-2000 pages", "van Dyke is not named here", "a::b and 1.2.3", "in 2019-2020 we had 0.12345678 of it"]
    out = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame([*rows, *enumerate(clean, 100)], "doc_id long, text string")).collect()}
    for k, (entity, text) in enumerate(PROBES.items()):
        assert out[k].n_entities == 1 and entity not in out[k].text, text
        before, after = text.split(entity)
        assert out[k].text.startswith(before) and out[k].text.endswith(after) or " " in entity or "van " in text, (text, out[k].text)
    assert [out[100 + k].text for k in range(len(clean))] == clean


def plain_entities(text):
    """Addresses and card numbers as a plain reader finds them, character by character."""
    part = lambda c: c.isalpha() or c.isdigit() or c in "_.%+-"
    found = []
    for k, c in enumerate(text):
        if c == "@":
            a, b = k, k + 1
            while a and part(text[a - 1]):
                a -= 1
            while b < len(text) and (text[b].isalpha() or text[b].isdigit() or text[b] in "-."):
                b += 1
            host = text[k + 1 : b].rstrip(".")
            if a < k and re.fullmatch(r"[^.]+(\.[^.]+)+", host):
                found.append(text[a : k + 1] + host)
    return found


def test_addresses_against_a_plain_reader(spark):
    texts = ["a.b@c.de, x@y and é.è@ñandú.es!", "one@two.three.four. (five+six@seven-8.org)", "@no.one no@ one@.two ö@ä.ü", "ab@cd.ef@gh.ij"[:8]]
    want = sum(len(plain_entities(t)) for t in texts)
    got = pii.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.n_entities for r in got) == want
    for r in got:
        assert all(e not in r.text for e in plain_entities(texts[r.doc_id]))


def test_pieces_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "own", 2.0, "old"), (2, None, None, None, None)], "doc_id long, text string, _text string, `a``b` double, decoded string")
    out = pieces.encode_pieces(df)
    assert out.columns == ["doc_id", "text", "_text", "a`b", "decoded", "ids"]
    again = pieces.decode_pieces(out)
    rows = {r.doc_id: r for r in again.collect()}
    assert again.columns == ["doc_id", "text", "_text", "a`b", "ids", "decoded"]
    assert (rows[1].decoded, rows[1]._text, rows[1]["a`b"]) == ("some text", "own", 2.0) and rows[2].ids == []
    long = spark.createDataFrame([(1, "word wörd " * 400_000)], "doc_id long, text string")
    assert pieces.encode_pieces(long, decoded=True).where("decoded = text or decoded = rtrim(text)").count() == 1


def test_words_in_digits_are_decoded(spark):
    model = toxicity.CharModel.fit({"ass": 40, "hello": 50, "world": 30, "a": 5})
    assert toxicity.restore_words(["455"], model, {}) == {"ass"}
    assert "hello" in toxicity.restore("say h e-l l-o to", model, {})
    df = spark.createDataFrame([(1, "fine", 3)], "doc_id long, text string, `odd``name` int")
    assert toxicity.reject_toxic(df, toxicity.ToxicityModel(model)).columns == df.columns


def test_references_end_at_tags():
    text = lambda page: "\n".join(b.text for b in htmltext.read_blocks(page))
    assert text("<p>AT&<b>amp;</b>T &amp; co</p>") == "AT&amp;T & co"
    assert text("<p>x<math>a+b</math>y</p>") == "xa+by"


def test_repeats_whatever_the_order_of_rows():
    """A shuffle may hand a chunk's rows out in another order when they are read again."""
    tail = "the same passage of more than fifty bytes that stands at the end of each"
    rows = [(k, f"{'xyz'[k % 3] * (k * 7 + 1)} {tail[k % 5 :]}".encode()) for k in range(12)]

    def chunk(at: list[int]) -> pa.Table:
        ids, texts = zip(*(rows[k] for k in at), strict=True)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()), "chunk": pa.array([0] * len(ids), pa.int64())})

    def removed(again: list[int]) -> dict[int, bytes]:
        one = chunk(list(range(12)))
        by = lambda t: [t.take(np.flatnonzero(t.column("bucket").to_numpy() == k)) for k in np.unique(t.column("bucket").to_numpy())]
        flags = pa.concat_tables([suffix._answer(g, suffix.CROWD) for g in by(suffix._ask(one, 2, 50))])
        lows = pa.concat_tables([suffix._match(g, 50) for g in by(suffix._send(one, flags, 2, 50))])
        kind = lambda t, k: t.append_column("kind", pa.array([k] * t.num_rows, pa.int32()))
        told = pa.concat_tables([kind(flags, 0), kind(lows.append_column("crowded", pa.nulls(lows.num_rows, pa.binary())), 1)])
        return {r["doc_id"]: r["kept"] for r in suffix._cover(chunk(again), told, 2, 50).to_pylist()}

    straight = removed(list(range(12)))
    assert straight[0] == rows[0][1] and any(straight[k] != t for k, t in rows)
    assert removed([7, 2, 11, 0, 5, 9, 1, 10, 3, 8, 6, 4]) == straight
