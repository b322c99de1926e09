"""Operators in DataFrame functions against brute force."""

import random
import re

import pytest

from ambervec.llm import decontaminate, lines
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, first string, words int, item_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        last = now
    return last[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_bits(spark, t):
    rng = random.Random(t)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé日") for _ in range(rng.randint(t + 1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, t + 2)):
            k = rng.randrange(len(b) + 1)
            rng.choice([lambda: b.insert(k, rng.choice("abé日")), lambda: b.pop(min(k, len(b) - 1)) if len(b) > 1 else None, lambda: b.__setitem__(min(k, len(b) - 1), "a")])()
        rows.append((a, "".join(b)))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within("a", "b", t).alias("ok")).collect():
        assert r.ok == (edits(r.a, r.b) <= t), (r, edits(r.a, r.b))


def test_lines(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.randint(10, 60))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], ["z"], ["z", s[k]]])
            own.append("".join(s))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (103, rows[0][1]), (None, rows[1][1] or "q" * 30)]
    got = {}
    for r in lines.deduplicated_lines(frame(spark, rows), 2, 12).collect():
        got.setdefault((r.doc_id, r.text), []).append(r)
    last = 1 << 62
    occ = sorted({(i if i is not None else last, k, s) for i, t in rows for k, s in enumerate((t or "").split("\n")) if len(s) >= 12})
    gone = set()
    for x, (i, k, s) in enumerate(occ):
        if any(abs(len(s) - len(o[2])) <= 2 and (o[2] == s or edits(o[2], s) <= 2) for o in occ[:x]):
            gone.add((i, k))
    assert len(gone) > 30
    for i, t in rows:
        own = (t or "").split("\n")
        kept = "\n".join(s for k, s in enumerate(own) if (i if i is not None else last, k) not in gone)
        for r in got[(i, t)]:
            assert (r.n_lines, r.kept_text, r.first, r.words) == (len(own), kept, "x", 1)
    assert sum(map(len, got.values())) == len(rows)
    assert lines.deduplicated_lines(frame(spark, rows).limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([30, 20, 13, 14, 9, 5, 3, 40, 0, 12, 7, 6, 4, 2, 8])]
    items.append((60, "unusual"))
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 50))]
        if i % 2:
            src = items[rng.randrange(len(items))][1].split()
            a = rng.randint(0, max(0, len(src) - 13))
            part = src[a : a + rng.randint(11, 20)]
            for _ in range(rng.randint(0, 4)):
                if part:
                    part[rng.randrange(len(part))] = "Zz"
            w[3:3] = [x.upper() + "," for x in part]
        rows.append((i, " ".join(w)))
    rows += [(200 + k, f"so {' '.join(x)} so") for k, (_, t) in enumerate(items) if (x := t.split()) and k > 3]
    rows += [(300 + k, f"so {' '.join([*x[:2], 'Zz', *x[3:]])} so") for k, (_, t) in enumerate(items) if len(x := t.split()) > 2]
    rows += [(100, None), (101, ""), (None, items[0][1]), (None, "clean text"), (103, items[1][1]), (103, items[1][1])]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items] + [(50, None, "x")], "item_id long, text string, doc_id string")

    def words(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def holds(t):
        d, out = words(t), []
        for k, it in items:
            v = words(it)
            n = 13 if len(v) >= 13 else len(v)
            if n and any(sum(x != y for x, y in zip(d[a : a + n], v[b : b + n])) <= (2 if n == 13 else int(n > 6)) for a in range(len(d) - n + 1) for b in range(len(v) - n + 1)):
                out.append(k)
        return out

    assert {len(holds(t)) > 0 for i, t in rows if i and i >= 200} == {True, False} and holds("An UNUSUAL day") == [60]
    got = {}
    for r in decontaminate.flagged(frame(spark, rows), bench).collect():
        got.setdefault(r.doc_id, []).append(r)
    hits = 0
    for i, t in rows:
        want = holds(t)
        hits += bool(want)
        assert any(r.items == want and r.contaminated == bool(want) and r.n_items == len(want) for r in got[i]), (i, t, want, got[i])
    assert hits > 10 and sum(map(len, got.values())) == len(rows)
    kept = decontaminate.decontaminated(frame(spark, rows), bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, t in rows if not holds(t))
    assert decontaminate.decontaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.flagged(frame(spark, rows).limit(0), bench).count() == 0
    # items of few words can be left out, and a large benchmark gives the same by shuffling
    few = decontaminate.leaks(frame(spark, rows), bench, 5).select("doc_id", "items").collect()
    assert few and not any({6, 12, 13, 60} & set(r["items"]) for r in few)
    whole = {(r.doc_id, r.text_hash): r["items"] for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    was, decontaminate.BROADCAST_BYTES = decontaminate.BROADCAST_BYTES, 0
    try:
        assert whole == {(r.doc_id, r.text_hash): r["items"] for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    finally:
        decontaminate.BROADCAST_BYTES = was


def test_masks_lose_nothing():
    from itertools import combinations

    for bad in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not any(o + x in bad for x in m) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1]))
    for n in range(1, decontaminate.WINDOW):
        for bad in range(n) if n >= decontaminate.ONE_WRONG else [-1]:
            assert any(bad not in m for m in decontaminate.short_masks(n))


def test_leaks_and_sql_agree(spark, tmp_path):
    """The registered SQL and the query over items of all lengths."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(13)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 4, 6, 7, 8, 12, 13, 15, 40])] + [(90, None), (91, "")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    for i in range(60, 160):
        w = items[rng.randrange(10)][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((i, " ".join(["a", *w, "b"])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(decontaminate.SQL).fetchall())
    assert len(want) > 60 and want == sorted((r.doc_id, r.n_items, r["items"]) for r in decontaminate.query(spark, str(tmp_path)).collect())


def test_short_exact_repeats_go(spark):
    rows = [(1, "sixteen letters!\n}\nother line here"), (2, "sixteen letters!\n}\nsixteen lettersX"), (3, "日本語の文\n日本語の文\n}")]
    kept = {r.doc_id: (r.n_removed, r.kept_text) for r in lines.deduplicated_lines(frame(spark, rows)).collect()}
    assert kept == {1: (0, rows[0][1]), 2: (1, "}\nsixteen lettersX"), 3: (1, "日本語の文\n}")}


def near_earlier(texts):
    """Numbers of the lines that an earlier line is within two edits of."""
    got, by = set(), {}
    for k, s in enumerate(texts):
        if any(within_two(s, o) for n in range(len(s) - 2, len(s) + 3) for o in by.get(n, ())):
            got.add(k)
        by.setdefault(len(s), []).append(s)
    return got


def within_two(a, b, t=2):
    """Edit distance by the furthest places of the diagonals."""
    far = {0: 0}
    for e in range(t + 1):
        if e:
            far = {d: max(far.get(d, -9) + 1, far.get(d - 1, -9), far.get(d + 1, -9) + 1) for d in range(-e, e + 1)}
        for d, i in far.items():
            while 0 <= i < len(a) and 0 <= i + d < len(b) and a[i] == b[i + d]:
                i += 1
            far[d] = i
            if i >= len(a) and i + d >= len(b):
                return True
    return False


def crowds():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = word(90)

    def changed(s, times):
        s = list(s)
        for _ in range(times):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [s[k], rng.choice("xyz")]])
        return "".join(s)

    one_word = []
    for _ in range(500):
        k = rng.randrange(0, 80)
        one_word.append(base[:k] + word(8) + base[k + 8 :])
    return {
        "near": ["the same line number %04d of a long list of lines" % (k % 50 + 100 * (k // 50 % 40)) for k in range(2000)],
        "far": [base[:40] + word(50) for _ in range(2000)],
        "one word": one_word,
        "edits": [changed(base, rng.randint(0, 4)) for _ in range(700)],
        "short": [changed("abcabcabcabcabcabcabcabcabc", rng.randint(0, 4)) for _ in range(500)],
    }


@pytest.mark.parametrize("kind,most,crowd,large,block", [
    *((kind, 2000, lines.CROWD, lines.LARGE, lines.BLOCK) for kind in ("near", "far", "one word", "edits")),  # rows, blocks and finer holes
    *((kind, 200, 2, 4, 3) for kind in ("one word", "short")), ("edits", 300, 5, 1 << 20, 50),
])
def test_crowded_segments(spark, kind, most, crowd, large, block):
    texts = list(dict.fromkeys(crowds()[kind]))[:most]
    out = lines.deduplicated_lines(frame(spark, enumerate(texts)), crowd=crowd, large=large, block=block).where("n_removed > 0")
    long = [s for s in texts if len(s) >= lines.LEAST_CHARS]
    assert {texts[r.doc_id] for r in out.collect()} == {long[k] for k in near_earlier(long)}


def test_lines_of_one_segment_are_no_pairs(spark, monkeypatch):
    """30 different lines that share a segment make a row each, not one for each pair."""
    rows, staged = {}, lines.staged

    def counted(df, label):
        out = staged(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "staged", counted)
    rng = random.Random(8)
    texts = ["the same twenty chars" + "".join(rng.choices("abcdefghij", k=42)) for _ in range(30)]
    texts.append(texts[0][:-1] + "z")
    out = lines.deduplicated_lines(frame(spark, enumerate(texts))).where("n_removed > 0")
    assert [r.doc_id for r in out.collect()] == [30]
    assert rows["met"] < 200


def test_other_thresholds_in_crowds(spark):
    """Blocks give what pairs give; finer holes are for two edits."""
    texts = list(dict.fromkeys(crowds()["short"]))[:150]
    for t in (1,):
        want = {r.doc_id for r in lines.deduplicated_lines(frame(spark, enumerate(texts)), t, crowd=10**6).where("n_removed > 0").collect()}
        assert want and want == {r.doc_id for r in lines.deduplicated_lines(frame(spark, enumerate(texts)), t, crowd=1, block=20).where("n_removed > 0").collect()}


@pytest.mark.parametrize("t", [1, 2])
def test_near_long_lines(spark, t):
    """Lines of thousands of characters: edits at the ends, close together and far apart."""
    rng, rows = random.Random(t), []
    for n in [999, 1001, 1500, 4097, 20_000]:
        a = "".join(rng.choice("abé日 ") for _ in range(n))
        for places in ([], [0], [n - 1], [0, n - 1], [n // 3, n // 3 + 1], [5, n // 2], [1, 2, n - 3], [n // 2, n // 2 + 1, n // 2 + 2]):
            for kind in "sid":
                b = list(a)
                for k in sorted(places, reverse=True):
                    b[k : k + 1] = {"s": ["#"], "i": [b[k], "#"], "d": []}[kind]
                rows.append((a, "".join(b)))
        rows += [(a, a + "zz"), ("zz" + a, a), (a, a + "zzz"), (a, a[::-1])]
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    for r in df.select("a", "b", F.expr(lines.near_sql("a", "b", t)).alias("ok")).collect():
        assert r.ok == within_two(r.a, r.b, t), (len(r.a), len(r.b))


def test_null_texts_stay_null(spark):
    for columns in (["doc_id", "text"], ["doc_id", "text", "words"]):
        rows = lines.deduplicated_lines(frame(spark, [(1, None), (2, "")]).select(*columns)).collect()
        assert {r.doc_id: (r.text, r.n_lines, r.n_removed, r.kept_text) for r in rows} == {1: (None, 1, 0, ""), 2: ("", 1, 0, "")}
