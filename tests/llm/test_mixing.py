import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from cloakframe.llm import mixing


def fill(budget, children):
    """Plain water-filling in whole tokens: children name -> (weight, capacity)."""
    given, left, open_ = {}, budget, {k: v for k, v in children.items() if v[0] > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if c * total <= left * w}
        if not full:
            return given | {k: left * w // total for k, (w, _) in open_.items()}
        for k, c in full.items():
            given[k] = c
            left -= c
            del open_[k]
    return given


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for i, t, path in rows:
        leaves[path].append((i, len(t.split()) if t else 0))
    w = lambda p: weights.get(p, 1)
    size = {p: sum(n for _, n in d) for p, d in leaves.items()}
    cap = lambda prefix: sum(size[p] * epochs for p in size if p[: len(prefix)] == prefix and all(w(p[: k + 1]) > 0 for k in range(3)))
    budget = {(): min(sum(size.values()) * share[0] // share[1], cap(()))}
    for n in range(3):
        for parent in [p for p in budget if len(p) == n]:
            kids = {p[: n + 1] for p in size if p[:n] == parent}
            budget |= fill(budget[parent], {k: (w(k), cap(k)) for k in kids})
    out = []
    for p, docs in leaves.items():
        given = budget.get(p, 0)
        full = min(given // size[p], epochs) if size[p] else 0
        rest = given - full * size[p]
        key = lambda i: hashlib.md5(f"{seed}:{full + 1}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        done, more = 0, set()
        for k in sorted({key(i) for i, _ in docs}):
            done += sum(n for i, n in docs if key(i) == k)
            if done > rest:
                break
            more.add(k)
        for i, _ in docs:
            out += [(i, *p, e + 1) for e in range(full + (rest > 0 and key(i) in more))]
    return sorted(out, key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, mixing.op7_mixing(spark, sf_dir).collect())) == sorted(con.sql(mixing.OP7_SQL).fetchall())


def test_brute_force_and_edges(spark):
    rows = [(i, "w " * (i * 7 % 23), ("d%d" % (i % 3), "l%d" % (i % 5 % 2), "s%d" % (i % 7))) for i in range(160)]
    rows += [(None, "x y", ("d0", "", "")), (5, None, ("d0", "", "")), (5, "a b c", ("d1", "l0", "s1")), (5, "a b c", ("d1", "l0", "s1")), (900, "long " * 40000, ("d2", "l1", "s0"))]
    df = spark.createDataFrame([(i, t, *(x or None for x in p), "z") for i, t, p in rows], "doc_id long, text string, dom string, lang string, source string, tokens string")
    weights = {("d0",): 7, ("d1", "l0"): 3, ("d1", "l1", "s1"): 5, ("d2", "l0"): 0}
    for share, epochs in (((1, 2), 1), ((1, 200), 3), ((1, 60), 2), ((5, 1), 2)):
        got = mixing.mix(df, F.col("dom"), weights, share, epochs, "s").select("_row.doc_id", *mixing.LEVELS, "epoch").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, weights, share, epochs, "s")
    assert mixing.mix(df.limit(0), F.col("dom"), weights).count() == 0
