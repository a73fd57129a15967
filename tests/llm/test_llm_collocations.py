import re
from collections import Counter

import pytest
from candlemill.llm.collocations import Words, collocations, frequent_phrases
from pyspark.sql import functions as F
from text_helpers import clash, odd_rows, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = {"filter_bits": 12, "block_bytes": 300}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    return f, n


def expected(rows, support, top):
    f, n = counted(rows)
    found = {}
    for (lang, w), a in f.items():
        if len(w) == 1 or a < support:
            continue
        longer = [x for (other, x), b in f.items() if other == lang and len(x) > len(w) and b >= support and 100 * b >= 80 * a
                  and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if longer:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, phrases in found.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts():
    rows = [(prose(120, s, 12) + ". New York, new york city; NEW\tYork City hall! über Maß\nüber Maß", ("en", "de", None, "und")[s % 4]) for s in range(24)]
    return rows + [(None, "en"), ("", "en"), (" \t\n.", None), ("a a a a a a a a", "en"), ("Ünd ünd\x0bünd \x0c the.end", "de"), ("x" * 5000 + " y", "en")]


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("shards", [1, 5])
def test_collocations(spark, shards):
    rows = texts()
    df = clash(table(spark, rows), "_w", "shard", "c", "phrase")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    for support, top in ((3, 10_000), (6, 4)):
        assert got(collocations(df, support, top, shard, **SMALL)) == expected(rows, support, top)


def test_counts_are_whole(spark):
    """Every phrase with the support, whatever shards and blocks it is spread over, even under a filter that is full."""
    rows = texts()
    f, n = counted(rows)
    want = sorted((lang, len(w), " ".join(w), a) for (lang, w), a in f.items() if a >= 5)
    for bits in (6, 20):
        phrases, words = frequent_phrases(table(spark, rows), 5, F.col("doc_id").cast("int") % 7, bits, 200)
        assert sorted(map(tuple, phrases.collect())) == want
        assert dict(map(tuple, words.collect())) == {k: v for k, v in n.items() if v}


def test_odd_rows(spark):
    rows = [(r[1], None) for r in odd_rows()]
    assert got(collocations(table(spark, rows), 30, 2000, filter_bits=16)) == expected(rows, 30, 2000)
    assert collocations(table(spark, []), filter_bits=8).count() == 0


def test_words():
    block = Words([b"A b,c", b"", b" D\te f!"])
    assert [block.words[i].as_py() for i in block.at] == [b"a", b"b", b"c", b"d", b"e", b"f"]
    found = {n: places.tolist() for n, places, _ in block.frequent(b"", 4, lambda n, h: h == h)}
    assert found == {1: [0, 1, 2, 3, 4, 5], 2: [0, 3, 4], 3: [3], 4: []}


def test_score_past_64_bits(spark):
    """2 000 000 a exceeds 2^63 for a phrase of 10^13 occurrences."""
    a, left = 10**13, 3 * 10**13
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(a).alias("r"))
    assert row.select(F.expr("(2000000 * cast(a as decimal(20,0))) div (l + r)").cast("long")).first()[0] == 2_000_000 * a // (left + a)
