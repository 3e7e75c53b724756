import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import language_id as li


def brute_prob(texts, queries, alphabet):
    """Plain interpolated Kneser-Ney over tuples, with the same discounts."""

    def grams(t):
        out, s = [], [0]
        for c in t.lower():
            if c.isalpha():
                s.append(ord(c))
            elif s[-1] != 0:
                s.append(0)
        for i in range(1, len(s)):
            ctx = []
            for k in range(1, 4):
                ctx.append(0 if i - k < 0 or (ctx and ctx[-1] == 0) else s[i - k])
            out.append((*reversed(ctx), s[i]))
        return out

    top = Counter(g for t in texts for g in grams(t))
    level = {4: top}
    for n in (3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    disc, tot, kinds = {}, defaultdict(float), Counter()
    for n, c in level.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[n] = min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5
        for g, v in c.items():
            tot[n, g[:-1]] += v
            kinds[n, g[:-1]] += 1

    def prob(g):
        p = 1 / (alphabet + 1)
        for n in (1, 2, 3, 4):
            h = g[4 - n : 3]
            if (n, h) in kinds:
                p = max(level[n].get(g[4 - n :], disc[n]) - disc[n], 0) / tot[n, h] + disc[n] * kinds[n, h] / tot[n, h] * p
        return p

    return [-sum(math.log(prob(g)) for g in grams(q)) / max(len(grams(q)), 1) for q in queries]


def model_of(texts):
    out = {}
    for name, ts in texts.items():
        g, _, _ = li.symbols(ts)
        _, at, n = np.unique(li.gram_hash(g, 4), return_index=True, return_counts=True)
        out[name] = (g[:, at], n)
    return li.Model(out)


TEXTS = {"aa": ["The cat and the dog.", "then they thanked the theatre"], "bb": ["Der Hund und die Katze!", "dass der Über-Weg dort"]}


def test_entropies_equal_plain_kneser_ney():
    model = model_of(TEXTS)
    alphabet = len({ord(c) for ts in TEXTS.values() for t in ts for c in t.lower() if c.isalpha()} | {0})
    queries = ["the hund", "x", "Zebra  übers 12 the", "und\x00und", "thethe", "日本 the"]
    h, _, _ = model.entropies(queries)
    for k, name in enumerate(model.languages):
        np.testing.assert_allclose(h[:, k], brute_prob(TEXTS[name], queries, alphabet), rtol=1e-5)


def test_held_out_accuracy_and_rejection(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = li.op10_language_id(spark, d).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 3


def test_edges(spark):
    rows = [(1, "the cat", "aa", "k"), (1, "the cat", "aa", "k"), (2, None, "aa", "k"), (3, "", "bb", "k"), (4, "123 !?", "bb", None), (5, "der hund und die", "bb", "k"), (6, "und " * 30000, None, "k"), (7, "日本語" * 40, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = li.fit(df, F.lit(True))
    got = {r.doc_id: r for r in li.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (2, 3, 4))
    assert got[1].lang_pred == "aa" and got[6].lang_pred == "bb" and got[7].rejected and not got[5].rejected
    none = li.fit(df, F.lit(False))
    assert {r.lang_pred for r in li.predict(df, none).collect()} == {"und"}
    assert li.predict(df.limit(0), model).count() == 0


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "xkcd qwrtz plmkj bvcxz zzgh wqrt kjhgf mnbvc pqwz xxrt vbnk lkjhq wrtp zxcvk hgfdw qzzx kplm nbvx rtqw",
]


def test_limits_come_from_other_texts_and_reject_what_is_foreign(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = li.fit(docs, F.lit(True))
    assert np.isfinite(model.limits).all()
    strange = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    assert all(r.rejected for r in li.predict(strange, model).collect())
    # one junk text in ten that is labelled as a language moves no limit far
    odd = docs.unionByName(spark.createDataFrame([(-k, FOREIGN[4], "en") for k in range(1, 4)], docs.schema))
    again = li.fit(odd, F.lit(True))
    assert np.abs(again.limits - model.limits).max() < 0.5


def test_query_equals_a_plain_argmin(spark):
    """The query's languages and scores against entropies of single texts under the fitted model."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = li.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in li.op10_language_id(spark, d).collect():
        t = texts[r.doc_id]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        h, n, _ = model.entropies([t])
        best = min(range(len(model.languages)), key=lambda k: h[0, k])
        other = sum(math.exp(-(x - h[0, best]) * min(n[0], li.EVIDENCE)) for x in h[0])
        assert r.lang_pred == model.languages[best] and abs(r.score - 1 / other) < 1e-6


def test_names_that_differ_in_case_are_replaced(spark):
    df = spark.createDataFrame([(1, "the cat", "aa", 3.0)], "doc_id long, text string, lang string, Score double")
    out = li.predict(df, li.fit(df, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected", "cross_entropy"] and out.select("score").count() == 1
