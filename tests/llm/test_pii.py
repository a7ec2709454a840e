import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import pii


def brute(text):
    out = []
    for kind, pattern in {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-%+0123 59()é٣\n", max_size=60))
def test_base_matches_the_plain_patterns(text):
    assert sorted(pii.detect(text)) == sorted(brute(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a0+.-@ (atdo)one,twxхＡ​５", max_size=40))
def test_normalised_characters_map_back_in_order(text):
    for made in pii.normalise(text):
        spans = [made.source(i, i + 1) for i in range(len(made.text))]
        assert all(0 <= a < b <= len(text) for a, b in spans)
        assert spans == sorted(spans)
        for i, (a, b) in enumerate(spans):
            if b - a == 1 and text[a].isascii():
                assert text[a] == made.text[i] or not made.text[i].isalpha()


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.disguised(text, pii.detect(text))]


def test_disguises():
    assert spans("mail joe (at) site (dot) org now") == [("email", "joe (at) site (dot) org")]
    assert spans("mail joe at site dot org now") == [("email", "joe at site dot org")]
    assert spans("look at example.com please") == []
    assert spans("call plus one four one five five five five two six seven one ok") == [("phone", "plus one four one five five five five two six seven one")]
    assert spans("host １９２.168.0.1 x") == [("ip", "１９２.168.0.1")]
    assert pii.detect("jоe@example.org") == [("email", 2, 15)]
    assert spans("jоe@example.org") == [("email", "jоe@example.org")]  # wider than the base span, which stays
    assert spans("jane (аt) example (dоt) com") == [("email", "jane (аt) example (dоt) com")]
    assert spans("ｏｎｅ nine twо dоt one six eight dot оne dot one") == [("ip", "ｏｎｅ nine twо dоt one six eight dot оne dot one")]
    assert spans("a​4111 1111 1111 1111") == []


def test_short_and_mixed_spelled_digits():
    for kind, text in [
        ("ip", "one nine two dot one six eight dot one dot one"),
        ("ip", "192.168.one.one"),
        ("ip", "one zero.0.zero.12"),
        ("ip", "10 (dot) two (dot) three four (dot) 5"),
        ("ip", "１９２.168.one.1"),
        ("phone", "+49 151 23 four five 67 89"),
        ("phone", "plus four nine 151 23 45 67 89"),
        ("phone", "plus one (four one) five five - 5 5 5 two six seven"),
        ("card", "4111 one one 11 1111 one 111"),
        ("card", "four 111 1111 1111 11 one one"),
    ]:
        assert spans(f"see {text} ok") == [(kind, text)], text
    for prose in ["one of us, no one. Two of 3 came at one", "plus one", "no one.Two or 3.one", "in 2019 one of 12, one two.", "phone 5 one-way", "someone.com 1.2.3", ""]:
        assert spans(prose) == [], prose


def test_stage_masks_the_widest_span_and_needs_no_lengths(spark):
    rows = [(1, "mail jоe@example.org or joe@example.org now", 5), (None, None, 5), (2, "", None), (2, "", None), (3, "word " * 50_000 + "1.2.3.4", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = sorted(((r.doc_id or 0), r.text, r._row or 0) for r in pii.stage(spark, df, "").collect() if r.text is not None)
    assert got == [(1, "mail [EMAIL] or [EMAIL] now", 5), (2, "", 0), (2, "", 0), (3, "word " * 50_000 + "[IP]", 1)]
    assert pii.stage(spark, df, "").columns == df.columns and pii.stage(spark, df, "").count() == 5
    assert pii.stage(spark, df.where("false"), "").count() == 0


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co", "x"), (3, "a@b.co", "x"), (None, "1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.spans, r.base_sha256) for r in pii.find(df).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    assert [x[:4] for x in got] == [(0, 0, 1, "ip:0:7"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6")]
    assert got[1][4] == empty
    assert pii.find(df.where("false")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0]))))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_long_runs_of_digits_and_clashing_names(spark):
    texts = ["0" * 5000 + "1.2.3.4", "0" * 1_000_000 + ".0.0.255 and " + "9" * 5000 + ".1.1.1", "1" * 200_000, ".".join(["0" * 5000 + "256"] * 4), "a@b.c " * 5 + "\u0430@b.c"]
    df = spark.createDataFrame([(k, t, "kept", "too") for k, t in enumerate(texts)], "doc_id long, text string, _found string, n_card string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert [got[k].n_ip for k in range(5)] == [1, 1, 0, 0, 0] and all(r._found == "kept" for r in got.values())
    assert got[0].spans == "ip:0:5007" and got[4].spans.endswith("email:30:35")
    staged = {r.doc_id: r.text for r in pii.stage(spark, df, "").collect()}
    assert staged[0] == "[IP]" and staged[4] == "[EMAIL] " * 5 + "[EMAIL]"
