"""The pipeline's stages over small tables."""

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    prose = [" ".join(f"w{(i * 37 + k * k) % 997}x" for k in range(60)) + "\n" + f"closing line number {i * 7919} of this text" for i in range(40)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(prose)]
    rows += [(100, prose[3], "en", "a", 1), (101, None, None, None, None), (102, "", "en", "a", 0), (103, prose[5] + " more", "en", "b", 2)]
    rows += [(200 + i, "### $$$ " * 40 + str(i), "en", "a", 5) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 100 or i >= 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose[7].split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns == list(cp.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(40))
    assert clean <= left[0] and not left[0] & set(range(200, 220))
    assert clean <= left[1] and 100 not in left[1]
    assert left[3] == left[2] - {7}
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[3]
    assert cp.run(spark, str(tmp_path)).count() == packed.count()


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", docs), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_extra_columns(spark, tmp_path):
    import corpus_pipeline as cp

    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(None, None, None, None, None, 1, "a"), (None, "", "en", "s", 0, 2, "b"), (5, long, "en", "s", 9, 3, "c"), (5, long, "en", "s", 9, 4, "d"), (6, "short", None, "s", None, 5, "e")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, key string"
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(r.score for r in out.collect()) == [1, 2, 3, 4, 5], name
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 5


def test_line_dedup_keeps_short_unique_lines(spark):
    import corpus_pipeline as cp

    header = "a header line of more than 24 characters"
    rows = [(1, header + "\nfirst verse"), (2, header + "\n日本語\nsecond verse"), (3, header + "\n \n\t"), (4, "first verse\n" + header), (5, ""), (6, header + "\nab")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("日本語\nsecond verse", 16), 5: ("", 0), 6: ("ab", 2)}


def test_stages_by_brute_force(spark):
    """Line dedup, near duplicates and decontamination on random documents, each stage
    on what the one before it kept, against plain Python."""
    import random
    import re

    import corpus_pipeline as cp
    from ambervec.llm import decontaminate, near_dedup
    from tests.llm.test_native_ops import edits

    rng = random.Random(31)
    pool = [" ".join(f"{rng.choice('abcdef')}{rng.randint(0, 30)}" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    texts = []
    for i in range(70):
        own = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + [f"line {i} {rng.random()} alone {' '.join(str(rng.random()) for _ in range(9))}"] * (i % 3 > 0)
        texts.append("\n".join(s.replace("1", "7", rng.choice([0, 0, 1, 3])) for s in own))
    body = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(200)) for _ in range(4)]
    for k in range(24):  # near copies line by line, too far for lines
        w = body[k % 4].split()
        w[rng.randrange(200)] = f"other{k}"
        texts.append(" ".join(w))
    texts += [None, "", texts[5], body[1] + " item " + " ".join(pool[3].split() + pool[4].split())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    items = [(1, " ".join(body[2].split()[3:20])), (2, "line 7 never"), (3, pool[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    occ = [(i, k, s) for i, t, *_ in rows for k, s in enumerate((t or "").split("\n"))]
    gone, seen = set(), {}
    for i, k, s in occ:
        near = len(s) >= 24 and any(edits(s, o) <= 2 for n in range(len(s) - 2, len(s) + 3) for o in seen.get(n, ()) if n >= 24)
        if len(s) >= 4 and (s in seen.get(len(s), ()) or near):
            gone.add((i, k))
        if len(s) >= 4:
            seen.setdefault(len(s), dict())[s] = True
    want = {}
    for i, t, *_ in rows:
        own = (t or "").split("\n")
        left = [s for k, s in enumerate(own) if (i, k) not in gone]
        if len(left) == len(own):
            want[i] = t
        elif any(x.strip() for x in left):
            want[i] = "\n".join(left)
    stage1 = cp.line_dedup(spark, docs, "").cache()
    assert {r.doc_id: r.text for r in stage1.collect()} == want and gone and len(want) < len(rows)

    sets = {}
    for i, t in want.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in want}
    for _ in want:
        for a in want:
            for b in want:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    stage2 = near_dedup.one_of_each(stage1).cache()
    kept = {i for i in want if least[i] == i}
    assert {r.doc_id for r in stage2.collect()} == kept and len(kept) < len(want) - 10

    def words(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def holds(t):
        d = words(t)
        for _, it in items:
            v = words(it)
            n, bad = (13, 2) if len(v) >= 13 else (len(v), int(len(v) > 6))
            if any(sum(x != y for x, y in zip(d[a : a + n], v[b : b + n])) <= bad for a in range(len(d) - n + 1) for b in range(len(v) - n + 1)):
                return True
        return False

    clean = {i for i in kept if not holds(want[i])}
    assert {r.doc_id for r in decontaminate.decontaminated(stage2, bench).collect()} == clean and len(clean) < len(kept)
