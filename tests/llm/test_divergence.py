"""The audit against plain counting, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import divergence as V
from tessera.llm import queries as Q

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n string, value string, part string, rank string, item string, chunk string, block string"


def frame(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, lang, source, 0, *"abcdefgh") for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def plain(rows, least=10, top=10):
    docs = [(TERM.findall((t or "").translate(FOLD)), lang or "", source or "") for t, lang, source in rows]
    df = defaultdict(Counter)
    for terms, lang, _ in docs:
        df[lang].update(set(terms))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=lambda t: t.encode()) for lang, c in df.items()}
    counts = defaultdict(Counter)
    for terms, lang, source in docs:
        counts[lang, source].update(t for t in terms if df[lang][t] >= least)
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def shares(c, lang):
        n, v = sum(c.values()), len(kept[lang])
        return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in counts.items()}
    q = {lang: shares(c, lang) for lang, c in whole.items()}

    def far(a, b):
        return (a - b) ** 2 // (a + b)

    out = set()
    for lang, source in counts:
        pairs = [(other, sum(far(p[lang, source][t], p[lang, other][t]) for t in kept.get(lang, []))) for ln, other in counts if ln == lang and other != source]
        own = [(t, far(p[lang, source][t], q[lang][t])) for t in kept.get(lang, []) if counts[lang, source][t] and p[lang, source][t] > q[lang][t]]
        for part, found in (("pair", pairs), ("term", sorted(own, key=lambda x: (-x[1], x[0].encode()))[:top])):
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())))}
    return out


def drawn(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "Éa", " x", "ŝ", "日本", "\U0001f600", "ﬀ"]
    rows = []
    for _ in range(n):
        lang, source = draw.choice(["en", "en", "de", ""]), f"s{draw.randrange(7)}"
        own = draw.sample(words, 40) if source == "s1" else words
        rows.append((" ".join(draw.choice(own).upper() if draw.random() < 0.2 else draw.choice(own) for _ in range(draw.randrange(60))), lang, source))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [
    (None, "en", "s1"), ("", None, None), (None, None, "x"), ("only words nobody else has", "xx", "a"), ("", "xx", "b"), (None, "xx", "c"),
    ("1 2 3 .,;", "en", "digits"), ("a\x00b\x1fc\x7fd `[@{", "en", "s2"), ("solo", "alone", "only"),
]


@pytest.mark.parametrize(("chunk", "block", "held", "rows"), [(4096, 256, 200_000, 65_536), (7, 2, 50, 20), (1, 1, 1, 1)])
def test_audit(spark, monkeypatch, chunk, block, held, rows):
    """Whatever the sizes of chunks, blocks and what tasks hold; with nulls, ties and groups without terms."""
    monkeypatch.setattr(V, "HELD", held)
    monkeypatch.setattr(V, "ROWS", rows)
    docs = drawn(260 if chunk > 1 else 90) + ODD
    assert got(V.audit(frame(spark, docs).repartition(3), chunk=chunk, block=block)) == plain(docs)


def test_repeated_rows_count(spark):
    docs = drawn(60, seed=3) * 4
    assert got(V.audit(frame(spark, docs))) == plain(docs)


def test_empty_and_single(spark):
    assert got(V.audit(frame(spark, []))) == set()
    assert got(V.audit(frame(spark, [("a a", "en", "s")] * 10))) == plain([("a a", "en", "s")] * 10) == set()
    assert got(V.audit(frame(spark, [("x", "en", "s"), ("y", "en", "t")]))) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(V, "PIECE", 5)
    text = ("Ab,cdé fghijklmnop " * 40).encode()
    assert sum(V.terms_of(text), []) == [t.encode() for t in TERM.findall(text.decode().translate(FOLD))]


def test_long_texts(spark):
    docs = [(("word%d lange texte " % (i % 3)) * 20_000 + "x" * 100_000, "en", f"s{i % 2}") for i in range(12)]
    assert got(V.audit(frame(spark, docs))) == plain(docs)


def test_shares_are_exact():
    import numpy as np

    draw = random.Random(2)
    for _ in range(2000):
        n, v = draw.randrange(10 ** draw.randrange(1, 16)), draw.randrange(1, 1000)
        c = draw.randrange(n + 1)
        assert V.share(np.array([c], np.int64), n, v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    answer = con.execute(Q.ORACLES["op13_source_divergence_audit"])
    names = [d[0] for d in answer.description]
    assert got(Q.op13_source_divergence_audit(spark, DATA)) == {tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in answer.fetchall()}
